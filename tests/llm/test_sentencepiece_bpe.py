import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tastemap.llm import sentencepiece_bpe as S
from tastemap.llm.catalogue import piece_file
from tests.llm.conftest import edge_texts

ODD = [" ", "  ", " a", "a ", "▁", "▁▁a ▁ b", "<s>x</s>", "<0x41>", "a\x00b", "　x", " " * 5000, "ab" * 3000,
       " \n" * 2000, "\n" * 3000, "🎉日é\x01", "кириллица текст", "é" * 500]
ALPHABETS = ["abAB ", "the ing\n", "aeiou ", " \t\n", "日本語中文のは", "éèñü ab", "<>/=\"' ", "🎉é日a \x01",
             "".join(map(chr, range(32, 127))), "кирилца "]


@pytest.fixture(scope="module")
def lib():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=piece_file())


@pytest.fixture(scope="module")
def model():
    return S.PieceModel(piece_file())


def agree(model, lib, texts):
    ids, offs = model.encode(pa.array(texts, pa.string()), True)
    back = model.decode(ids, offs).to_pylist()
    for i, t in enumerate(texts):
        want = lib.encode(t or "", add_eos=True)
        assert ids[offs[i]:offs[i + 1]].tolist() == want, repr(t)[:200]
        assert back[i] == lib.decode(want), repr(t)[:200]


def test_odd_texts_equal_the_library(model, lib):
    agree(model, lib, edge_texts() + ODD)


def test_random_texts_equal_the_library(model, lib):
    rng = random.Random(3)
    for _ in range(300):
        a = rng.choice(ALPHABETS)
        agree(model, lib, ["".join(rng.choice(a) for _ in range(rng.randrange(1, 90))) for _ in range(4)])
    pieces = [lib.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    for _ in range(200):
        agree(model, lib, ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(4)])
    agree(model, lib, ["".join(rng.choice(pieces).strip() for _ in range(3000))])


def test_small_slices_and_the_serial_end_change_nothing(model, lib, monkeypatch):
    rng = random.Random(4)
    texts = edge_texts()[:12] + ["".join(rng.choice("ab é日 ") for _ in range(400)) for _ in range(20)]
    monkeypatch.setattr(S, "SLICE", 50)
    agree(model, lib, texts)
    words = [t.encode() for t in ("  " * 40, "xxxxabababab" * 9, "日本語" * 30, "the" * 50)]
    offs = np.cumsum([0, *map(len, words)])
    buf = np.frombuffer(b"".join(words), np.uint8)
    full = model.encode_words(buf, offs, max_rounds=10_000)
    for rounds in (0, 1, 3):
        some = model.encode_words(buf, offs, max_rounds=rounds)
        assert all((x == y).all() for x, y in zip(full, some))


def test_decoding_of_any_ids(model, lib):
    rng = random.Random(5)
    for _ in range(500):
        row = [rng.choice([rng.randrange(300), rng.randrange(32000)]) for _ in range(rng.randrange(12))]
        assert model.decode(np.array(row, np.int64), np.array([0, len(row)])).to_pylist() == [lib.decode(row)]
    with pytest.raises(ValueError):
        model.decode(np.array([32000]), np.array([0, 1]))


def test_operator_on_odd_rows(edge_docs, doc_rows, lib):
    rows = S.decode(S.encode(edge_docs, piece_file()), piece_file()).collect()
    assert len(rows) == len(doc_rows)
    texts = {r["doc_id"]: r["text"] or "" for r in doc_rows}
    for r in rows:
        want = lib.encode(texts[r.doc_id], add_eos=True)
        assert list(r.ids) == want and r.decoded == lib.decode(want)
    null = edge_docs.selectExpr("cast(null as bigint) as doc_id", "cast(null as string) as text").limit(1)
    assert S.decode(S.encode(null, piece_file()), piece_file()).collect()[0].ids == [2]
    null_ids = edge_docs.selectExpr("doc_id", "cast(null as array<int>) as ids").limit(1)
    assert S.decode(null_ids, piece_file()).collect()[0].decoded is None


def test_empty_table(no_docs):
    assert S.decode(S.encode(no_docs, piece_file()), piece_file()).count() == 0


def test_query_digests(spark, lib):
    import __spark_entry__ as entry
    from tests.conftest import SF_SMALL
    texts = dict(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = entry.queries()["op13_sentencepiece"](spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r.doc_id] or "", add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))
