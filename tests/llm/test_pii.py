import random
import re

from tastemap.llm.pii import KINDS, MATCH_BLOCK, classifier, joined, outside, pii_spans, scanned, vote_probabilities
from pyspark.sql import functions as F

PATTERNS = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def only(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(number)))) % 10 == 0


CHECKS = [lambda v: True, lambda v: all(int(p) <= 255 for p in v.split(".")),
          lambda v: 14 <= len(only(v)) <= 19 and luhn(only(v)), lambda v: 10 <= len(only(v)) <= 15]


def base(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(text or "")
                  if CHECKS[k](m.group()))


def got(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii_spans(docs).collect()}


def test_base_spans_of_odd_rows(edge_docs, doc_rows):
    want = {r["doc_id"]: base(r["text"]) for r in doc_rows}
    out = pii_spans(edge_docs).collect()
    assert len(out) == len(doc_rows)
    for r in out:
        mine = [tuple(s) for s in r.spans if s.kind < 4]
        assert mine == want[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in mine) for i in range(4)]


def test_base_spans_of_random_strings(spark):
    rng = random.Random(4)
    alphabet = "00123456789  --..++()@@aBé_%\n"
    parts = ["a@b.c_x@d.e", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1", "010.0.00.255", "4111 1111 1111 1111",
             "4111-1111-1111-1111 4111111111111111", "+1 (743) 555-3824", "+12.34.56", "x.y@z-.q-", "..@a.b",
             "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "12345678901234567890", "٣@x.y"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]
    texts += ["".join(rng.choice(parts + [" ", "-", "+", "é"]) for _ in range(5)) for _ in range(400)]
    for i, r in got(spark, texts).items():
        assert [tuple(s) for s in r.spans if s.kind < 4] == base(texts[i]), repr(texts[i])


def test_secrets_are_found_and_plain_long_words_left(spark):
    rng = random.Random(6)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    texts = [f"some words before token = \"{h}\" and after" for h in hexes]
    texts += [f"plain {'wordlike' * 3} text number {rng.randrange(10 ** 15, 10 ** 16)} here" for _ in range(200)]
    out = got(spark, texts)
    for i, h in enumerate(hexes):
        at = texts[i].index(h)
        assert (at, KINDS.index("secret"), at + 40) in [tuple(s) for s in out[i].spans]
    clean = [out[i] for i in range(60, 260)]
    assert sum(any(s.kind >= 4 for s in r.spans) for r in clean) == 0


def test_long_runs_do_not_recurse(spark):
    texts = ["1" * 200_000, "1 " * 100_000, "a" * 200_000 + "@", "a@" + "b." * 100_000, "+1" + "." * 100_000, "1." * 50_000]
    out = got(spark, texts)
    assert len(out) == 6


def test_joined_and_empty(spark, no_docs):
    r = pii_spans(spark.createDataFrame([(1, "x a@b.c 1.2.3.4")], "doc_id long, text string"))
    assert r.select(joined(F.col("spans"))).first()[0] == "email:2:7,ip:8:15"
    assert pii_spans(no_docs).count() == 0


def test_texts_of_many_matches(spark):
    """More matches than a block: places are those of the plain version, and taken spans count."""
    n = 2 * MATCH_BLOCK + 3
    texts = ["é a.b@c.de xx " * n, "a@b.cd " * MATCH_BLOCK, "a@b.cd " * (MATCH_BLOCK + 1),
             "x@y.zz 1.2.3.4 and 4111 1111 1111 1111, +1 (743) 555-3824\n" * n, "a.b@c.de " * 40_000]
    for i, r in got(spark, texts).items():
        assert [tuple(s) for s in r.spans if s.kind < 4] == base(texts[i])


def test_outside_equals_all_comparisons(spark):
    rng = random.Random(8)

    def spans(n, width):
        starts = sorted(rng.randrange(20_000) for _ in range(n))
        return [(a, a + rng.randrange(1, width)) for a in starts]
    rows = [(i, spans(a, 30), spans(b, 30)) for i, (a, b) in enumerate(
        [(0, 5), (5, 0), (1, 1), (MATCH_BLOCK, 40), (900, 700), (700, 900)])]
    span = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(rows, f"id int, s {span}, t {span}")
    for r in df.select("id", outside(F.col("s"), F.col("t")).alias("kept")).collect():
        _, s, t = rows[r.id]
        assert [tuple(x) for x in r.kept] == [x for x in s if not any(a < x[1] and x[0] < b for a, b in t)]


def planted(rng):
    """(text, private value or None): labelled numbers of many shapes, and plain numbers."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    makes = [lambda: ("SSN: ", f"{d(3)}-{d(2)}-{d(4)}"), lambda: ("IBAN ", f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}"),
             lambda: ("tel: ", f"({d(3)}) {d(3)}-{d(4)}"), lambda: ("account no. ", f"{d(4)}-{d(4)}-{d(2)}"),
             lambda: ("passport: ", d(9)), lambda: ("phone ", f"{d(3)}.{d(3)}.{d(4)}")]
    plain = [lambda: ("of ", "4080250821787626"), lambda: ("on the ", f"20{rng.randrange(10, 25)}-0{rng.randrange(1, 10)}-1{d(1)}"),
             lambda: ("cost ", f"{rng.randrange(1, 99)}.{d(3)}.{d(3)}"), lambda: ("about ", f"{rng.randrange(1, 99)} {d(3)} {d(3)}"),
             lambda: ("some ", d(8)), lambda: ("run of!! ", d(7) + "3")]
    out = []
    for i in range(600):
        private = i % 3 == 0
        before, value = rng.choice(makes if private else plain)()
        out.append((f"words of a text {before}{value} and more words", value, private))
    return out


def test_planted_numbers_of_many_shapes(spark):
    rows = planted(random.Random(3))
    out = got(spark, [t for t, _, _ in rows])
    right = wrong = missed = 0
    for i, (text, value, private) in enumerate(rows):
        at = text.index(value)
        hit = (at, KINDS.index("account"), at + len(value)) in [tuple(s) for s in out[i].spans]
        taken = any(s.kind < 4 for s in out[i].spans)
        right += hit and private
        wrong += private is False and any(s.kind == 5 for s in out[i].spans)
        missed += private and not hit and not taken
    assert right / (right + missed) > 0.95 and right / (right + wrong) > 0.95, (right, wrong, missed)


def em(counts, labelers, steps):
    """Plain expectation-maximisation over vote patterns (each vote 0, 1 or 2)."""
    prior, yes, no = 0.5, [[0.1, 0.2, 0.7]] * labelers, [[0.7, 0.2, 0.1]] * labelers

    def post(votes):
        a, b = prior, 1 - prior
        for i, v in enumerate(votes):
            a, b = a * yes[i][v], b * no[i][v]
        return a / (a + b)
    for _ in range(steps):
        p = {v: post(v) for v in counts}
        ys, ns = sum(n * p[v] for v, n in counts.items()), sum(n * (1 - p[v]) for v, n in counts.items())
        table = lambda f, total: [[(sum(f(v, n) for v, n in counts.items() if v[i] == k) + 0.5) / (total + 1.5)
                                   for k in range(3)] for i in range(labelers)]
        prior, yes, no = ((ys + 1) / (ys + ns + 2), table(lambda v, n: n * p[v], ys),
                          table(lambda v, n: n * (1 - p[v]), ns))
    return {v: post(v) for v in counts}


def test_em_and_classifier_equal_plain_python(spark):
    from collections import Counter
    from math import isclose, log
    from tastemap.llm.pii import EM_STEPS, LABELERS
    texts = [t for t, _, _ in planted(random.Random(9))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = scanned(docs)
    found = [c for r in rows.collect() for c in r.candidates]
    unpack = lambda v: tuple(v // 3 ** i % 3 for i in range(LABELERS))
    want = {}
    for kind in {c.kind for c in found}:
        p = em(Counter(unpack(c.votes) for c in found if c.kind == kind), LABELERS, EM_STEPS)
        want.update({(kind, v): x for v, x in p.items()})
    have = {(r.kind, unpack(r.votes)): r.p for r in vote_probabilities(rows).collect()}
    assert have.keys() == want.keys() and all(isclose(have[k], want[k], rel_tol=1e-6, abs_tol=1e-9) for k in want)
    yes, no = Counter(), Counter()
    for c in found:
        p = want[c.kind, unpack(c.votes)]
        for b in c.bins:
            yes[b] += p
            no[b] += 1 - p
    prior = log((sum(yes.values()) + 1) / (sum(no.values()) + 1))
    model = classifier(rows).first()
    assert isclose(model.prior, prior, rel_tol=1e-6)
    assert all(isclose(model.w[b], log((yes[b] + 0.5) / (no[b] + 0.5)) - prior, rel_tol=1e-5, abs_tol=1e-6) for b in yes)
