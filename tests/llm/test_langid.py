import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tastemap.llm.catalogue import op5_langid
from tastemap.llm.langid import BITS, learn_profiles, predict

EN = "the quick brown fox jumps over the lazy dog and then the other thing happened with them "
FR = "le renard brun saute par dessus le chien paresseux et puis les autres choses sont arrivées "
DE = "der schnelle braune fuchs springt über den faulen hund und dann geschah die andere sache "


@pytest.fixture(scope="module")
def profiles(spark):
    rows = [(EN * 5, "en"), (FR * 5, "fr"), (DE * 5, "de"), (EN, None), (None, "fr"), ("", "de")]
    return learn_profiles(spark.createDataFrame(rows, "text string, lang string"))


def test_profiles_hold_every_language_once(profiles):
    assert profiles.langs == ["de", "en", "fr"]
    assert all((row < profiles.size).sum() <= profiles.size for row in profiles.ranks)


def test_predictions_and_undetermined(spark, profiles):
    texts = {1: "the dog and the fox", 2: "le chien et les renards", 3: "der hund und die füchse", 4: None, 5: "",
             6: "123 456 !!", 7: " \n", 8: DE * 3000, 9: "the dog and the fox", 10: "日本語"}
    docs = spark.createDataFrame([(k, v, "zz") for k, v in texts.items()], "doc_id long, text string, score string")
    out = {r.doc_id: r for r in predict(docs, profiles, ["doc_id"]).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3, 8)] == ["en", "fr", "de", "de"]
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (4, 5, 6, 7))
    assert out[9].score == out[1].score and out[10].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in out.values())


def test_no_training_rows(spark, edge_docs):
    none = learn_profiles(edge_docs.where("lang = 'xx'"))
    out = predict(edge_docs, none, ["doc_id"])
    assert out.where("lang_pred <> 'und'").count() == 0 and out.count() == edge_docs.count()


def test_odd_rows_and_empty_table(edge_docs, no_docs):
    p = learn_profiles(edge_docs)
    out = predict(edge_docs, p, ["doc_id"])
    assert out.count() == edge_docs.count() and out.where("score < 0 OR score > 1").count() == 0
    assert predict(no_docs, p, ["doc_id"]).count() == 0


def test_held_out_accuracy(spark):
    from tests.conftest import SF_CHECK
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang")
    out = op5_langid(spark, SF_CHECK).where("held_out").join(docs, "doc_id")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


M32 = (1 << 32) - 1


def plain_bins(text):
    """Bins of the 1- to 3-grams of one text, gram by gram (0 stands for a gap)."""
    codes = [0]
    for c in (text or "").lower():
        if c.isalpha():
            codes.append(ord(c))
        elif codes[-1]:
            codes.append(0)
    k1, k2, k3 = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D
    fin = lambda h: ((h ^ (h >> 13)) * k2 & M32) >> (32 - BITS)
    out = []
    for i, a in enumerate(codes):
        if a:
            out.append(fin(a * k1 & M32))
        if i + 1 < len(codes) and (a or codes[i + 1]):
            two = (((a * k1 & M32) ^ 0x5BD1E995) * k2 + codes[i + 1] * k3) & M32
            out.append(fin(two))
            if i + 2 < len(codes) and codes[i + 1]:
                out.append(fin(((two ^ (two >> 15)) * k1 + codes[i + 2] * k2) & M32))
    return out


def plain_ranks(counts, size):
    return {b: i for i, (b, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size])}


def test_ranks_and_distances_equal_plain_python(spark):
    """Profiles, predictions and scores against a version with dictionaries and loops."""
    rng = random.Random(14)
    odd = [None, "", "12 34", "a", "É1é--ß日本", "x " * 3000, "ab" * 5000]
    train = [(" ".join(rng.choice(t.split()) for _ in range(rng.randrange(1, 60))), lang)
             for t, lang in ((EN, "en"), (FR, "fr"), (DE, "de")) for _ in range(30)]
    train += [(t, lang) for t in odd for lang in ("en", "fr")] + [(EN, None)]
    size = 60
    counts = {}
    for text, lang in train:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(plain_bins(text))
    want = {lang: plain_ranks(c, size) for lang, c in counts.items()}
    p = learn_profiles(spark.createDataFrame(train, "text string, lang string"), size)
    assert p.langs == sorted(want)
    for lang, row in zip(p.langs, p.ranks):
        assert {int(b): int(row[b]) for b in (row < size).nonzero()[0]} == want[lang]
    texts = odd + [" ".join(rng.choice((EN + FR + DE).split()) for _ in range(rng.randrange(1, 80))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in predict(docs, p, ["doc_id"]).collect():
        mine = plain_ranks(Counter(plain_bins(texts[r.doc_id])), size)
        if not any(c.isalpha() for c in texts[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        away = {lang: sum(abs(ranks[b] - i) if b in ranks else size for b, i in mine.items())
                for lang, ranks in want.items()}
        best = min(sorted(away), key=away.get)
        assert r.lang_pred == best
        assert r.score == pytest.approx(1 - away[best] / (len(mine) * size))
