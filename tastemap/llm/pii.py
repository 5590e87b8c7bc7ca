"""Personal data: base patterns, and further spans by weak supervision.

The base kinds (email, ip, card, phone) are fixed patterns with checks.  The
method looks for two more kinds, ``secret`` (long tokens) and ``account`` (runs of 7
to 19 digits, whole or in groups joined by one space, dot, dash or bracket, and IBANs,
that no base pattern took):

1. Candidates come from a loose pattern.  Five labelers vote on each (private,
   not, or abstain): a strict pattern, a gazetteer of words before it, the
   punctuation around it, its mix of characters, and its variety of characters.
2. Votes are summed to at most 3 ** 5 patterns per kind.  Expectation-maximisation
   over these counts estimates how often each labeler votes which way on private
   and on other candidates, and so the probability of each vote pattern.
3. A final naive Bayes classifier over hashed span features (shape, length, words
   and marks around) is trained on those probabilities and decides each candidate.

DataFrame operators only.  The corpus is scanned once; spans and candidates of a
document stay one row without its text.  What the scoring pass reads is fixed in
size: the vote patterns and ``BINS`` weights.

The patterns are the contract's, written with possessive quantifiers and
look-behinds so that every text is scanned in linear time and without recursion.
The places of a text's matches are summed up in blocks, so that a text of very many
matches takes time in proportion to them.

Defined results: a null text counts as empty and has no span; repeated rows get
equal results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored

# Fixed patterns of the base kinds.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
KINDS = ["email", "ip", "card", "phone", "secret", "account"]

# Loose patterns of the method's kinds.
SECRET = r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}+"
_IBAN = "[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){2,7}+(?:[ -]?[A-Z0-9]{1,3}+)?+"
_GROUPS = r"\(?+[0-9]{1,6}(?:\) ?|[ .-])[0-9]{2,6}+(?:[ .-][0-9]{2,6}+){0,6}+"
ACCOUNT = rf"(?<![0-9A-Za-z])(?:{_IBAN}|[0-9]{{7,19}}+|{_GROUPS})(?![0-9A-Za-z])"
SEVEN_DIGITS = r"[0-9](?:(?:\) ?|[ .-])?[0-9]){6}"

# Gazetteers: words that announce a private value.
SECRET_WORDS = "token|secret|password|passwd|key|apikey|bearer|credential|auth"
ACCOUNT_WORDS = "card|account|iban|ssn|tel|phone|fax|mobile|passport|id"
_NUMBER_WORD = r"(?:\W{1,3}(?:no|nr|num|number))?+"

LABELERS = 5
EM_STEPS = 25
BINS = 4096
MIN_PROBABILITY = 0.5
MATCH_BLOCK = 256


def found(text: Column, pattern: str, likely: Column) -> Column:
    """array<struct<start, end, value, before, after>> of the matches, leftmost first, in
    code points; ``likely`` is a cheap necessary condition."""
    p = F.lit(pattern)
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"),
                     F.regexp_extract_all(text, p, F.lit(0)).alias("hits"))
    kind = "array<struct<start:int,end:int,value:string,before:string,after:string>>"

    def walk(z: Column, bases: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            gap, hit = F.get(z["gaps"], i), F.get(z["hits"], i)
            start = acc["at"] + F.char_length(gap)
            end = start + F.char_length(hit)
            one = F.struct(start.alias("start"), end.alias("end"), hit.alias("value"),
                           F.right(gap, F.lit(24)).alias("before"),
                           F.left(F.get(z["gaps"], i + 1), F.lit(8)).alias("after"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        def block(b: Column) -> Column:
            last = F.least((b + 1) * MATCH_BLOCK, F.size(z["hits"])) - 1
            zero = F.struct(F.get(bases, b).alias("at"), F.array().cast(kind).alias("out"))
            return F.aggregate(F.sequence(b * MATCH_BLOCK, last), zero, step, lambda acc: acc["out"])
        return F.flatten(F.transform(_blocks(F.size(z["hits"])), block))

    def block_starts(z: Column) -> Column:
        """Code points before each block of matches."""
        def length(parts: Column, b: Column) -> Column:
            return F.aggregate(F.slice(parts, b * MATCH_BLOCK + 1, F.lit(MATCH_BLOCK)), F.lit(0),
                               lambda n, x: n + F.char_length(x))
        return F.aggregate(_blocks(F.size(z["hits"])), F.array(F.lit(0)), lambda acc, b: F.concat(
            acc, F.array(F.element_at(acc, -1) + length(z["gaps"], b) + length(z["hits"], b))))

    some = let(parts, lambda z: F.when(F.size(z["hits"]) > 0, let(block_starts(z), lambda at: walk(z, at))))
    return F.coalesce(F.when(likely, some), F.array().cast(kind))


def _blocks(n: Column) -> Column:
    """Numbers of the blocks of n > 0 entries."""
    return F.sequence(F.lit(0), F.floor((n - 1) / MATCH_BLOCK).cast("int"))


def outside(spans: Column, taken: Column) -> Column:
    """The spans that overlap none of ``taken``.  A block of spans is held against the part
    of ``taken`` that reaches into it."""
    def block(b: Column) -> Column:
        mine = F.slice(spans, b * MATCH_BLOCK + 1, F.lit(MATCH_BLOCK))
        reach = let(mine, lambda m: F.struct(
            F.array_min(F.transform(m, lambda c: c["start"])).alias("lo"),
            F.array_max(F.transform(m, lambda c: c["end"])).alias("hi")))
        near = let(reach, lambda r: F.filter(taken, lambda t: (t["start"] < r["hi"]) & (r["lo"] < t["end"])))
        return let(near, lambda near: F.filter(mine, lambda c: ~F.exists(
            near, lambda t: (t["start"] < c["end"]) & (c["start"] < t["end"]))))
    return F.when((F.size(spans) == 0) | (F.size(taken) == 0), spans).otherwise(
        F.flatten(F.transform(_blocks(F.greatest(F.size(spans), F.lit(1))), block)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def term(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d >= 5, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)
    each = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), term)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind."""
    email = found(text, EMAIL, F.contains(text, F.lit("@")))
    ip = F.filter(found(text, IP, F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]"))),
                  lambda m: F.rlike(m["value"], F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")))
    card = F.filter(found(text, CARD, F.rlike(text, F.lit(CARD))), lambda m: luhn(digits(m["value"])))
    phone = F.filter(found(text, PHONE, F.contains(text, F.lit("+"))),
                     lambda m: F.char_length(digits(m["value"])).between(10, 15))
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def _vote(yes: Column, no: Column) -> Column:
    """2 private, 0 not, 1 abstain."""
    return F.when(F.coalesce(yes, F.lit(False)), 2).when(F.coalesce(no, F.lit(False)), 0).otherwise(1)


def _variety(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(F.lower(value), "")))


def secret_votes(m: Column) -> list[Column]:
    v, n = m["value"], F.char_length(m["value"])
    n_digits = F.char_length(digits(v))
    return [
        _vote(F.rlike(v, F.lit("^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|[A-Z0-9]{20}|(?:sk|pk|gh[a-z])_[A-Za-z0-9]{16,})$")),
              F.rlike(v, F.lit("^[A-Za-z_]+$"))),
        _vote(F.rlike(F.lower(m["before"]), F.lit(rf"(?:{SECRET_WORDS})\W{{0,6}}$")), F.lit(False)),
        _vote(F.rlike(m["before"], F.lit(r"[=:]\s?[\"'`]?$")), F.rlike(m["before"], F.lit(r"(?:^|[^=:\s]\s)$"))),
        _vote((n_digits * 8 >= n) & (n_digits < n), n_digits == 0),
        _vote((_variety(v) >= 10) & (n_digits >= 4), _variety(v) <= 6)]


def account_votes(m: Column) -> list[Column]:
    v, d = m["value"], digits(m["value"])
    n, whole = F.char_length(d), F.rlike(m["value"], F.lit("^[0-9]+$"))
    date = r"(?:(?:19|20)[0-9]{2}[ .-][0-9]{2}[ .-][0-9]{2}|[0-9]{2}[ .-][0-9]{2}[ .-](?:19|20)[0-9]{2})"
    amount = r"[0-9]{1,3}(?:[ .][0-9]{3})+"
    return [
        _vote(F.rlike(v, F.lit(rf"^(?:{_IBAN}|[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}})$")) | ((n >= 13) & luhn(d)),
              F.rlike(v, F.lit(rf"^(?:{date}|{amount})$")) | (whole & (n >= 13))),
        _vote(F.rlike(F.lower(m["before"]), F.lit(rf"\b(?:{ACCOUNT_WORDS}){_NUMBER_WORD}\W{{0,6}}$")),
              F.rlike(m["before"], F.lit(r"\p{L}\W{0,6}$"))),
        _vote(F.rlike(m["before"], F.lit(r"\p{L}\.?\s?[:#]\s?$")),
              F.rlike(m["before"], F.lit(r"[^:#\s]\s*$")) | F.rlike(m["after"], F.lit(r"^\s?[$€£%]"))),
        _vote(F.rlike(v, F.lit(r"^(?:[A-Z]{2}|\()|[0-9]-[0-9]")), whole & (n >= 13)),
        _vote(_variety(d) >= 5, _variety(d) <= 3)]


def features(kind: str, m: Column) -> Column:
    """Hashed bins of a candidate's discrete features."""
    v = m["value"]
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]+", "9"), "[a-z]+", "a"), "[A-Z]+", "A")
    parts = [
        F.when(F.rlike(v, F.lit("^[0-9]+$")), "digits").when(F.rlike(v, F.lit("^[0-9a-fA-F]+$")), "hex")
        .when(F.rlike(v, F.lit("^[A-Za-z]+$")), "letters").otherwise("mixed"),
        F.least(F.char_length(v), F.lit(64)).cast("string"),
        F.when(F.char_length(shape) <= 8, shape).otherwise("long"),
        F.lower(F.regexp_extract(m["before"], r"([A-Za-z]+)\W*$", 1)),
        F.regexp_extract(m["before"], r"(\W*)$", 1),
        F.left(m["after"], F.lit(1))]
    return F.array(*[F.pmod(F.xxhash64(F.lit(kind), F.lit(i), p), F.lit(BINS)).cast("int")
                     for i, p in enumerate(parts)])


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, one array<struct<start, end>> per base kind, candidates): one scan of the texts."""
    text = F.coalesce("text", F.lit(""))
    span = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))

    def candidates(kind: int, matches: Column, votes) -> Column:
        def one(m: Column) -> Column:
            pattern = sum((v * 3 ** i for i, v in enumerate(votes(m))), F.lit(0))
            return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
                            pattern.cast("int").alias("votes"), features(KINDS[kind], m).alias("bins"))
        return F.transform(matches, one)

    secret = candidates(4, found(text, SECRET, F.rlike(text, F.lit(SECRET))), secret_votes)
    runs = F.filter(found(text, ACCOUNT, F.rlike(text, F.lit(SEVEN_DIGITS))), lambda m: F.rlike(
        m["value"], F.lit("^[A-Z]")) | F.char_length(digits(m["value"])).between(7, 19))
    account = candidates(5, runs, account_votes)
    base = {k: F.transform(v, span).alias(k) for k, v in base_spans(text).items()}
    rows = stored(docs.select("doc_id", *base.values(), F.concat(secret, account).alias("candidates")), "pii-scan")
    return rows.withColumn("candidates", outside(F.col("candidates"), F.concat(*KINDS[:4])))


def vote_probabilities(rows: DataFrame) -> DataFrame:
    """(kind, votes, p): expectation-maximisation over the counts of the vote patterns, one
    row of at most 3 ** LABELERS counts per kind."""
    counts = rows.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes").agg(
        F.count(F.lit(1)).alias("n"))
    per_kind = counts.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("obs"))
    vote = lambda o, i: F.pmod(F.floor(o["votes"] / F.pow(F.lit(3.0), i)), F.lit(3)).cast("int")
    labelers = F.sequence(F.lit(0), F.lit(LABELERS - 1))
    table = lambda *v: F.array(*[F.lit(x) for _ in range(LABELERS) for x in v])
    start = F.struct(F.lit(0.5).alias("prior"), table(0.1, 0.2, 0.7).alias("yes"), table(0.7, 0.2, 0.1).alias("no"))

    def posterior(st: Column, o: Column) -> Column:
        like = lambda side: F.aggregate(
            labelers, F.lit(1.0), lambda acc, i: acc * F.get(side, i * 3 + vote(o, i)))
        return let(F.struct((st["prior"] * like(st["yes"])).alias("y"),
                            ((1 - st["prior"]) * like(st["no"])).alias("n")), lambda z: z["y"] / (z["y"] + z["n"]))

    def step(st: Column, _: Column) -> Column:
        weighted = F.transform("obs", lambda o: F.struct(o["votes"].alias("votes"), o["n"].alias("n"),
                                                         posterior(st, o).alias("p")))

        def update(w: Column) -> Column:
            total = lambda f: F.aggregate(w, F.lit(0.0), lambda a, o: a + f(o))
            side = lambda f: F.transform(
                F.sequence(F.lit(0), F.lit(3 * LABELERS - 1)),
                lambda k: (total(lambda o: F.when(vote(o, F.floor(k / 3)) == F.pmod(k, F.lit(3)), f(o))
                                 .otherwise(0.0)) + 0.5) / (total(f) + 1.5))
            yes, no = (lambda o: o["n"] * o["p"]), (lambda o: o["n"] * (1 - o["p"]))
            return F.struct(((total(yes) + 1) / (total(yes) + total(no) + 2)).alias("prior"),
                            side(yes).alias("yes"), side(no).alias("no"))
        return let(weighted, update)

    state = F.aggregate(F.sequence(F.lit(1), F.lit(EM_STEPS)), start, step)
    fitted = stored(per_kind.select("kind", "obs", state.alias("st")), "pii-reliabilities")
    return fitted.select("kind", "st", F.explode("obs").alias("o")).select(
        "kind", F.col("o.votes").alias("votes"), posterior(F.col("st"), F.col("o")).alias("p"))


def _dense(rows: DataFrame, at: str, values: list[str], n: int) -> DataFrame:
    """One row: an array of length ``n`` per value column, 0 where no row has that index."""
    every = rows.sparkSession.range(n).join(rows.select(F.col(at).cast("long").alias("id"), *values), "id", "left")
    named = F.struct("id", *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])
    one = every.agg(F.sort_array(F.collect_list(named)).alias("a"))
    return stored(one.select(*[F.col(f"a.{v}").alias(v) for v in values]), "pii-table")


def classifier(rows: DataFrame) -> DataFrame:
    """One row: ``w``, the log odds that each feature bin adds, and ``prior``, the classes'."""
    size = 3 ** LABELERS
    p = vote_probabilities(rows).withColumn("at", F.col("kind") * size + F.col("votes"))
    table = _dense(p, "at", ["p"], len(KINDS) * size)
    soft = rows.select(F.explode("candidates").alias("c")).select(
        "c.bins", F.get(table.select("p").scalar(), F.col("c.kind") * size + F.col("c.votes")).alias("p"))
    sums = soft.select(F.explode("bins").alias("bin"), "p").groupBy("bin").agg(
        F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    both = _dense(sums, "bin", ["yes", "no"], BINS)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    prior = F.log((total("yes") + 1) / (total("no") + 1))
    both = stored(both.select("yes", "no", prior.alias("prior")), "pii-sums")
    w = F.transform(F.arrays_zip("yes", "no"),
                    lambda b: F.log((b["yes"] + 0.5) / (b["no"] + 0.5)) - F.col("prior"))
    return stored(both.select(w.alias("w"), "prior"), "pii-classifier")


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<start, kind, end>>, sorted; n_email, n_ip, n_card, n_phone);
    ``kind`` is an index into ``KINDS``, and the first four are the base kinds."""
    rows = scanned(docs)
    model = classifier(rows)
    rows = rows.withColumn("_w", model.select("w").scalar()).withColumn("_prior", model.select("prior").scalar())
    odds = lambda c: F.aggregate(c["bins"], F.col("_prior"), lambda a, b: a + F.get("_w", b))
    added = F.transform(F.filter("candidates", lambda c: 1 / (1 + F.exp(-odds(c))) >= MIN_PROBABILITY),
                        lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))

    def marked(kind: int) -> Column:
        return F.transform(KINDS[kind], lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"),
                                                           m["end"].alias("end")))
    base = [marked(i) for i in range(4)]
    return rows.select("doc_id", F.sort_array(F.concat(*base, added)).alias("spans"),
                       *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
