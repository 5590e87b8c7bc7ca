import random

import pytest

WORDS = "red green blue stone river cloud paper lamp house garden winter summer north south".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + str(rng.randrange(40)))
        if rng.random() < 0.1:
            out[-1] += "."
        if rng.random() < 0.06:
            out[-1] += "\n"
    return " ".join(out)


def edge_texts() -> list:
    """Null, empty, white space, one word, no newline, very long, ties and repeats."""
    rng = random.Random(5)
    long = prose(rng, 20_000)
    return [None, "", " \t\n ", "word", "\n\n\n", "a b c d", prose(rng, 30), long, long[:40_000] + " end",
            "same line of text\nsame line of text\nother", "same line of text", "é ü ß 日本語 🎉 ½", "x" * 50_000,
            "1 " * 5_000, "+" * 3_000, "@" * 3_000, "." * 3_000, "a.b@c.de " * 50]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Documents with every odd case: repeated rows, null columns, clashing extra columns."""
    texts = edge_texts()
    rng = random.Random(11)
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None])) for i, t in enumerate(texts)]
    rows += [(100 + i, prose(rng, rng.randrange(5, 300)), rng.choice(["en", "fr"]), f"s{i % 3}") for i in range(60)]
    rows += [(200 + i, rows[20 + i][1], "en", "s1") for i in range(5)]          # exact copies
    rows += [rows[25]]                                                          # a repeated row
    rows += [(300, "one row without a source here", None, None)]
    full = [(i, t, lang, s, None if t is None else len(t), "x", 1, 2, "y", 3.5) for i, t, lang, s in rows]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, "
              "pos string, size int, n int, `_text` string, score double")
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture(scope="session")
def doc_rows(edge_docs):
    return [r.asDict() for r in edge_docs.select("doc_id", "text", "lang", "source").collect()]
