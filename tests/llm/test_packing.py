import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tastemap.llm.catalogue import tokenizer_files
from tastemap.llm.packing import Encoder, Rounds, pack


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_files()["tokenizer"])


def ids_of(exact, text):
    return np.array(exact.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_fast_ids_equal_the_tokenizer(exact):
    files = tokenizer_files()
    encode = Encoder(files["tokenizer"], files["ranks"])
    texts = ["Hello, world's  end\n\n\t x", "é ü ß ½ – …", "日本語 🎉", "a\x1cb\x85c\xa0d", "<|endoftext|> x", "", " " * 5000,
             "a" * 5000, "1234567890", "don't they'll I'm", "\r\n \n", "ﬁ ǆ ɐ Ω я", "a b­c", "x\x00y\x7fz"]
    for t in texts:
        assert encode(t).tolist() == exact.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("window,quantum,weights", [(2048, 64, None), (100, 7, None), (64, 1, {"s0": 5.0, "s1": 1.0})])
def test_every_id_once_and_sequences_without_gaps(edge_docs, doc_rows, exact, window, quantum, weights):
    rows = pack(edge_docs, **tokenizer_files(), window=window, min_quantum=quantum, weights=weights).collect()
    texts = {r["doc_id"]: ids_of(exact, r["text"]) for r in doc_rows}
    copies = Counter(r["doc_id"] for r in doc_rows)
    seen, seqs = defaultdict(Counter), defaultdict(list)
    for r in rows:
        ids = texts[r.doc_id][r.start:r.start + r.length]
        assert len(ids) == r.length > 0 and r.doc_tokens == len(texts[r.doc_id])
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and ids.tobytes() == bytes(r.ids)
        for i in range(r.start, r.start + r.length):
            seen[r.doc_id][i] += 1
        seqs[r.sequence_id].append(r)
    assert all(seen[d] == Counter({i: copies[d] for i in range(len(t))}) for d, t in texts.items())
    assert sorted(seqs) == list(range(len(seqs)))
    for w, pieces in seqs.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or w == len(seqs) - 1


def test_windows_hold_the_target_proportions():
    rng = np.random.default_rng(2)
    total = np.array([400_000, 90_000, 9_000, 700, 3], np.int64)
    rounds = Rounds.of(total, total.astype(float), 2048, 64)
    s, a, n, at = [], [], [], np.zeros(5, np.int64)
    while (at < total).any():
        i = int(rng.choice(np.flatnonzero(at < total)))
        k = min(int(rng.integers(1, 3000)), int(total[i] - at[i]))
        s.append(i), a.append(at[i]), n.append(k)
        at[i] += k
    s, a, n = map(np.array, (s, a, n))
    doc, start, length, seq, off = rounds.pieces(s, a, n)
    per = np.zeros((seq.max() + 1, 5))
    np.add.at(per, (seq, s[doc]), length)
    assert (per[:-1].sum(1) == 2048).all()
    want = 2048 * total / total.sum()
    assert np.abs(per[:-1] - want).max() <= max(64, 0.02 * 2048) + 1
    # a deficit is carried, never lost: cumulated tokens stay within a quantum of the target
    drift = np.cumsum(per[:-1], 0) - np.arange(1, len(per))[:, None] * want
    assert np.abs(drift).max() <= 2048 * 0.8 + 64
    # each task computes alone what all would compute together
    half = rounds.pieces(s[::2], a[::2], n[::2])
    whole = {(s[d], a[d] + x): (q, o) for d, x, q, o in zip(doc, start, seq, off)}
    assert all(whole[s[::2][d], a[::2][d] + x] == (q, o) for d, x, q, o in zip(half[0], half[1], half[3], half[4]))


def test_empty_table(no_docs):
    assert pack(no_docs, **tokenizer_files()).count() == 0


def test_ids_stay_out_of_the_second_python_pass(edge_docs):
    """Only places go through Python after tokenising; ids by the batch took too much memory."""
    plan = pack(edge_docs, **tokenizer_files())._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    assert "ids" not in plan.split("pieces(")[1].split(")")[0]


def test_second_pass_gives_the_encoders_memory_back():
    """What a worker holds after the ids are made: close to what it held before (checked in a process of its own)."""
    import os
    import subprocess
    import sys
    code = """
import random
import pyarrow as pa
from tastemap.llm import packing
from tastemap.llm.catalogue import tokenizer_files

def held():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 / 1e6

rng = random.Random(1)
files = tokenizer_files()
packing.release()
encode = packing.encoder(files["tokenizer"], files["ranks"])
for i in range(2000):
    encode(" ".join(str(rng.random()) for _ in range(100)) + chr(0x4e00 + i))
before = held()
del encode
packing.release()
assert not packing._encoders
print(before - held())
"""
    if not os.path.exists("/proc/self/statm"):
        pytest.skip("needs /proc")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert float(out.stdout) > 30


def test_second_tokenizer_is_loaded_when_a_text_needs_it():
    """Plain texts go through the rank file alone; the first other text loads the exact tokenizer."""
    from tastemap.llm.catalogue import tokenizer_files
    from tastemap.llm.packing import Encoder
    both = Encoder(*tokenizer_files().values())
    alone = Encoder(tokenizer_files()["tokenizer"], None)
    plain = "Plain words, été and 12 numbers.\n"
    assert both(plain).tolist() == alone(plain).tolist() and "exact" not in vars(both)
    for text in ("漢字 and words", "a <|endoftext|> inside"):
        assert both(text).tolist() == alone(text).tolist() and "exact" in vars(both)
