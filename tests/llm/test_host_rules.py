import re
from collections import Counter

from tastemap.llm.host_rules import host_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if grams[tuple(words[i:i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_equal_brute_force(edge_docs, doc_rows):
    out = host_filter(edge_docs)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in out.collect())
    want = Counter()
    for r in doc_rows:
        c = counts(r["text"])
        want[(r["doc_id"], *c, c[0] < 20 or 100 * c[4] > 30 * c[0])] += 1
    assert got == want


def test_bad_hosts_lose_their_documents_and_small_ones_shrink(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, "bad", "too short" if i % 10 else good) for i in range(100)]
    rows += [(1000 + 100 * h + i, f"good{h}", good if i else "too short") for h in range(9) for i in range(50)]
    rows += [(5000, "single", "short"), (5001, None, good)]
    out = {r.doc_id: r for r in host_filter(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert not out[0].kept and not out[0].base_failed         # a sound document of a bad host
    assert out[1001].kept and not out[1000].kept
    assert 0 < out[5000].host_rate < 1                        # one failure of one is shrunk
    assert out[5001].kept


def test_interleaved_repeated_lines_fail(spark):
    # a short menu line after each unique line: no 8-word window repeats, most lines do
    def page(k, menu):
        return "\n\n".join(f"{m}\n{m}\nfirst{k}x{i} and last{k}x{i}" for i, m in enumerate(menu))
    menu = ["home about contact", "terms privacy help"]
    rows = [(i, "menus", page(i, menu * 4)) for i in range(30)]
    rows += [(100 + i, "prose", page(i, [f"line{k} of text" for k in range(8)])) for i in range(30)]   # a third repeats
    rows += [(200 + 50 * h + i, f"good{h}", " ".join(f"word{j}" for j in range(40))) for h in range(9) for i in range(50)]
    out = {r.doc_id: r for r in host_filter(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert (out[0].n_dup_lines, out[0].n_lines, out[0].n_words) == (14, 24, 72)
    assert not any(out[i].base_failed for i in out)
    assert all(out[i].host_rate > 0.5 and not out[i].kept for i in range(30))
    assert all(out[i].kept for i in out if i >= 100)


def test_empty_table(no_docs):
    assert host_filter(no_docs).count() == 0


def plain_verdicts(rows):
    """host -> (rate, worse, failed) of {host: (n, failures)}, by the method of moments."""
    raw = [f / n for n, f in rows.values()]
    m = sum(raw) / len(raw)
    v = sum((x - m) ** 2 for x in raw) / len(raw)
    s = max(2.0, m * (1 - m) / v - 1) if v > 0 else 2.0
    rate = {h: (f + m * s) / (n + s) for h, (n, f) in rows.items()}
    return {h: (r, r > m + 1e-9, r > 0.5) for h, r in rate.items()}


def test_verdicts_equal_a_plain_version_and_bite(spark):
    good = " ".join(f"word{i}" for i in range(40))
    symbols = " ".join(f"$%|x{i}" for i in range(40))             # fails a rule of the method only
    hosts = {"a": (50, 20), "b": (50, 2), "c": (40, 30), "d": (3, 1), "e": (60, 6), None: (30, 0)}
    rows, n = [], 0
    for h, (size, bad) in hosts.items():
        for i in range(size):
            rows.append((n, h, symbols if i < bad else good))
            n += 1
    out = host_filter(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    want = plain_verdicts(hosts)
    by_host = {r.source: r for r in out}
    assert all(abs(by_host[h].host_rate - want[h][0]) < 1e-12 for h in hosts)
    kept = Counter((r.source, r.kept) for r in out)
    for h, (size, bad) in hosts.items():
        _, worse, failed = want[h]
        assert kept[h, True] == (0 if failed else size - bad if worse else size), h
    assert {want[h][1:] for h in hosts} == {(True, True), (True, False), (False, False)}
    assert not any(r.base_failed for r in out)


def test_verdict_changes_rows_and_spares_good_documents(spark):
    """On the given tables: documents that fail a method rule on a worse host go, no document
    labelled good does."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    changed = host_filter(docs).where("NOT base_failed AND NOT kept").join(labels, "doc_id", "left")
    got = {r.quality: r["count"] for r in changed.groupBy("quality").count().collect()}
    assert sum(got.values()) > 50 and got.get(0, 0) > 10 and 1 not in got
