from tastemap.llm.catalogue import UNWANTED, URL_RULES
from tastemap.llm.url_filter import build_cascade, filter_urls, judge_listed
from pyspark.sql import functions as F


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host.translate(low), rest[:end]


def rule_of(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text)) if fits else None


URLS = [None, "", "no scheme", "http://A.Example.ORG/es/x", "http://example.org/en/12?q=/es/", "https://x.org",
        "ftp://u.com/fr/", "http://u.com/de/#a", "http://spam-farm.net/x", "http://notorg/", "http://éÀ.org/É",
        "a://b://c.com/de/", "http://x.com?u=http://y.org/", "http:///path", "http://u.com/de/", "http://u.com/en/",
        "http://" + "h" * 5000 + ".org/" + "p" * 5000]


def test_rules_hosts_and_paths(spark):
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    for r in filter_urls(pages, URL_RULES, UNWANTED).collect():
        host, path = split(URLS[r.page_id])
        assert (r.host, r.path) == (host, path)
        rule = rule_of(host, path)
        assert r.rule == (rule.text if rule else None)
        if rule:
            assert r.verdict == rule.verdict
        else:
            blocked = [rule_of(*split(u)) for u in URLS if split(u)[0] == host and rule_of(*split(u))]
            score = sum(1 if b.verdict == "block" else -1 for b in blocked)
            named = set(host.replace("-", ".").split(".")) & set(UNWANTED)
            assert r.verdict == ("block" if host and (named or score > 0) else "allow")


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = build_cascade(keys)
    assert len(cascade.levels) >= 2
    assert keys.where(cascade.listed(F.col("key")) != F.col("listed")).count() == 0


def test_groups_of_filters_are_exact(spark):
    keys = spark.range(3_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 3 == 0).alias("listed"))
    rows = keys.withColumnRenamed("listed", "truth")
    out = judge_listed(rows, keys, "key", max_words=200)
    assert out.count() == 3_000 and out.where("truth <> listed").count() == 0


def test_all_none_and_empty(spark):
    keys = spark.range(50).select(F.col("id").cast("string").alias("key"), F.lit(True).alias("listed"))
    assert keys.where(~build_cascade(keys).listed(F.col("key"))).count() == 0
    none = keys.withColumn("listed", F.lit(False))
    assert none.where(build_cascade(none).listed(F.col("key"))).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(pages, URL_RULES, UNWANTED).count() == 0
