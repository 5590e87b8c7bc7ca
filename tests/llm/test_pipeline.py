import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark):
    from tastemap.llm.common import stored, table
    out, docs = {"documents": table(spark, SF_SMALL, "documents")}, table(spark, SF_SMALL, "documents")
    for name, stage in pipeline.STAGES:
        docs = out[name] = stored(stage(spark, docs, SF_SMALL), "test-stage")
    return out


def test_stages_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixing", "packing"]
    assert all(stages[n].columns == stages["documents"].columns for n, _ in pipeline.STAGES[:-1])
    assert all(stages[n].schema["doc_id"].dataType == stages["documents"].schema["doc_id"].dataType
               for n, _ in pipeline.STAGES)


def test_quality_rejects_junk_and_keeps_the_rest(spark, stages):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    kept = stages["quality"].select("doc_id")
    assert labels.where("quality = 1").join(kept, "doc_id", "left_anti").count() <= 2
    assert labels.where("quality = 0").join(kept, "doc_id").count() <= 2


def test_decisions_take_effect(stages):
    n = {k: v.count() for k, v in stages.items()}
    assert n["quality"] < n["documents"] and n["lines"] == n["quality"] and n["near_duplicates"] <= n["lines"]
    size = lambda d: d.agg(F.sum("n_chars")).first()[0]
    assert size(stages["lines"]) < size(stages["quality"])
    for k in ("quality", "lines", "near_duplicates", "mixing"):
        assert stages[k].where(F.char_length("text") != F.col("n_chars")).count() == 0
    packed = stages["packing"]
    assert packed.select("doc_id").distinct().count() == n["mixing"]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n < 2048").count() <= 1


def test_near_duplicates_leave_one_of_each_group(spark, stages):
    from tastemap.llm.jaccard_join import jaccard_groups
    groups = jaccard_groups(stages["lines"])
    kept = stages["near_duplicates"].join(groups, "doc_id")
    assert kept.count() == groups.select("class_id").distinct().count()


def test_texts_without_words_end_at_mixing(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(["", "", " \n", "\t", "some words of a text"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near = pipeline.near_duplicates(spark, docs, SF_SMALL)
    assert near.count() == 5
    assert {r.doc_id for r in pipeline.mixing(spark, near, SF_SMALL).collect()} == {4}


def test_texts_that_share_a_doc_id_are_judged_apart(spark):
    words = lambda name, n=60: [f"{name}{i}" for i in range(n)]
    texts = [(1, words("a")), (2, words("b")), (2, words("c")), (2, words("c")), (2, words("a") + ["end"]),
             (3, words("c") + ["end"]), (4, words("d")), (4, words("d") + ["end"]), (None, words("e"))]
    rows = [(i, " ".join(t), "en", "s", len(" ".join(t))) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.near_duplicates(spark, docs, SF_SMALL)
    assert out.columns == docs.columns
    kept = sorted((r.text.split()[0], r.doc_id) for r in out.collect())
    assert [k for k, _ in kept] == ["a0", "b0", "c0", "d0", "e0"]       # one row of each group, none lost
    assert ("a0", 1) in kept and ("b0", 2) in kept and ("e0", None) in kept


def test_stages_take_odd_rows_and_empty_tables(spark, edge_docs, no_docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (edge_docs.select(*columns), no_docs.select(*columns)):
        n = docs.count()
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, SF_SMALL)
            if name != "packing":
                assert out.columns == columns
            assert n or out.count() == 0
            out.write.format("noop").mode("overwrite").save()
