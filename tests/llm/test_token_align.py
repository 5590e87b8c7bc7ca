import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tastemap.llm import token_align as A
from tastemap.llm.catalogue import piece_file, tokenizer_files

FILES = {**tokenizer_files(), "model": piece_file()}


def plain_tables():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(FILES["tokenizer"])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES["model"])
    shown = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    sign = {x: chr(x) for x in shown}
    for x in range(256):
        if x not in sign:
            sign[x] = chr(256 + len(sign) - len(shown))
    back = {c: x for x, c in sign.items()}
    bytes_a = lambda i: bytes(back[c] for c in a.id_to_token(i))
    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()
    return a, b, bytes_a, bytes_b


def brute(docs):
    """Rows of (n_a, n_b, groups, links) and the corpus-wide link counts."""
    a, b, bytes_a, bytes_b = plain_tables()
    out, counts = [], Counter()
    for t in docs:
        groups = []
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        want = (" " + t).encode() if t else b""
        if b"".join(map(bytes_a, x)) != want or b"".join(map(bytes_b, y)) != want:
            x, y = [], []
        ends = [list(np.cumsum([len(f(i)) for i in ids])) for ids, f in ((x, bytes_a), (y, bytes_b))]
        i = j = 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
            groups.append((x[i:p], y[j:q]))
            counts[x[p - 1], y[q - 1]] += 1
            i, j = p, q
        out.append((len(x), len(y), groups))
    return out, counts


def agree(rows, docs):
    found, counts = brute([t for _, t in docs])
    best = defaultdict(int)
    for (x, y), n in counts.items():
        best[y] = max(best[y], n)
    want = Counter()
    for (doc_id, _), (n_a, n_b, groups) in zip(docs, found):
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want[doc_id, n_a, n_b, len(groups), len(links), sum(counts[k] == best[k[1]] for k in links),
             sum(counts[k] for k in links), text] += 1
    assert Counter(map(tuple, rows)) == want


def test_operator_on_odd_rows(spark, edge_docs, doc_rows):
    odd = ["<|endoftext|> x", "</s> <s> <0x41>", "a▁b", "▁", " ", "   lead", "tail  ", "\x00\x01", "a\x85b", "　"]
    more = spark.createDataFrame([(900 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    docs = edge_docs.select("doc_id", "text").unionByName(more)
    rows = A.token_links(docs, **FILES).collect()
    agree(rows, [(r["doc_id"], r["text"]) for r in doc_rows] + [(900 + i, t) for i, t in enumerate(odd)])
    zero = [r for r in rows if r.doc_id in (902, 903)]
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in zero) and len(zero) == 2


def test_query_equals_brute_force(spark):
    import __spark_entry__ as entry
    from tests.conftest import SF_SMALL
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows = entry.queries()["op12_token_align"](spark, SF_SMALL).collect()
    texts = {r.doc_id: r.groups for r in A.token_links(
        spark.read.parquet(f"{SF_SMALL}/documents.parquet"), **FILES).collect()}
    agree([(*r[:7], texts[r.doc_id]) for r in rows], docs)
    assert all(r.groups_sha256 == (hashlib.sha256(texts[r.doc_id].encode()).hexdigest() if r.n_groups else "")
               for r in rows)


@pytest.mark.parametrize("piece,block", [(1, 1), (2, 3), (7, 2), (256, 2048)])
def test_merge_path_pieces(piece, block):
    rng = random.Random(piece)
    for _ in range(200):
        n = rng.randrange(1, 120)
        a = np.array(sorted(rng.sample(range(1, n + 40), rng.randrange(0, n))), np.int64)
        b = np.array(sorted(rng.sample(range(1, n + 40), rng.randrange(0, n))), np.int64)
        both = set(a.tolist()) & set(b.tolist())
        got = A.common_ends(a, b, piece, block)
        assert [x.tolist() for x in got] == [[int(e) in both for e in s] for s in (a, b)]


def test_diagonals_cut_equal_work():
    rng = random.Random(9)
    both = np.array(rng.sample(range(10_000), 3_000))
    a, b = np.sort(both[:2_500]), np.sort(both[2_500:])
    i, j = A.diagonals(a, b, 100)
    assert (i + j == np.r_[np.arange(0, 3_000, 100), 3_000]).all()
    merged = np.sort(both)
    for x, y in zip(i, j):
        assert set(a[:x]) | set(b[:y]) == set(merged[:x + y])


def test_pair_slots_are_distinct():
    m = A.aligner(FILES["tokenizer"], FILES["ranks"], FILES["model"])
    by_bytes = defaultdict(list)
    for i, t in enumerate(m.tok_b.bytes):
        by_bytes[t].append(i)
    pairs = [(i, j) for i, t in enumerate(m.tok_a.bytes) if t for k in range(len(t)) for j in by_bytes.get(t[k:], ())]
    a_of = {t: i for i, t in enumerate(m.tok_a.bytes)}
    pairs += [(a_of[t[k:]], j) for j, t in enumerate(m.tok_b.bytes) for k in range(1, len(t)) if t[k:] in a_of]
    slot = m.slots(*np.array(pairs).T)
    assert len(set(slot.tolist())) == len(pairs) and slot.min() >= 0 and slot.max() < m.slots.size < 2_000_000


def test_empty_table(no_docs):
    assert A.token_links(no_docs, **FILES).count() == 0
