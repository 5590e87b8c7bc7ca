"""Column -> Column building blocks.  All are built-in Spark expressions, so
they stay inside the JVM (no Python UDF anywhere in the library)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tastemap.config import BEHAVIOUR_WEIGHTS, BUCKETS, LOG_TIME_FORMAT


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- time -------------------------------------------------------------------

def parse_log_time(s) -> Column:
    """Strict parse of a ``yyyy-MM-dd HH:mm:ss`` string; NULL when malformed
    (hour 25, missing clock part, garbage) so the row can be quarantined.
    The result is a wall-clock timestamp (timestamp_ntz), independent of the
    session time zone."""
    # parsed as UTC and taken back to a wall clock in UTC: no daylight-saving gap
    # of the session zone can move it
    utc = F.try_to_timestamp(F.concat(_c(s), F.lit(" +0000")), F.lit(LOG_TIME_FORMAT + " xx"))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), utc.cast("timestamp_ntz"))


def in_zone(ts, start: str, end: str) -> Column:
    """Inclusive clock-range test on the HH:mm:ss part of a timestamp."""
    clock = F.date_format(_c(ts), "HH:mm:ss")
    return clock.between(F.lit(start), F.lit(end))


def time_bucket(ts) -> Column:
    """Time-of-day bucket label of a timestamp; NULL for NULL input.

    Bucket ranges must be whole hours that follow each other (checked), so the test
    is done on ``hour(ts)`` (cheaper than formatting a string per row) and agrees
    with ``in_zone``.
    """
    starts = [int(end[:2]) + 1 for _, _, end in BUCKETS[:-1]]
    if (any(not end.endswith(":59:59") for _, _, end in BUCKETS)
            or [s for _, s, _ in BUCKETS] != ["00:00:00", *(f"{h:02d}:00:00" for h in starts)]):
        raise ValueError("time buckets must cover the day in whole hours")
    ts = _c(ts)
    h = F.hour(ts)
    expr = None
    for label, _start, end in BUCKETS:
        cond = h <= int(end[:2])
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.when(ts.isNotNull(), expr)


# -- behaviour --------------------------------------------------------------

def behaviour_weight(code, weights: dict | None = None) -> Column:
    """Weight of a behaviour code; NULL for an unknown code (quarantined)."""
    weights = weights or BEHAVIOUR_WEIGHTS
    code = _c(code)
    expr = None
    for k, w in weights.items():
        cond = code == F.lit(int(k))
        expr = F.when(cond, F.lit(float(w))) if expr is None else expr.when(cond, F.lit(float(w)))
    return expr


# -- vectors (array<double>) ------------------------------------------------

def dot(a, b) -> Column:
    """Dot product; positions missing in the shorter array count as 0."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x * x))


def normalise(a) -> Column:
    """Unit vector; NULL for a zero or empty vector."""
    a = _c(a)
    n = l2_norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n))


def cosine(a, b) -> Column:
    """Cosine similarity; 0.0 when either vector has zero norm."""
    na, nb = l2_norm(a), l2_norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def pad(a, n) -> Column:
    """Zero-pad an array to length n (arrays already that long are unchanged)."""
    a = _c(a)
    n = F.lit(n) if isinstance(n, int) else _c(n)
    missing = F.greatest(n - F.size(a), F.lit(0))
    return F.concat(a, F.array_repeat(F.lit(0.0), missing))


def unscale(a, count) -> Column:
    """Mean -> sum: multiply every element by the article count."""
    return F.transform(_c(a), lambda x: x * _c(count))


def merge_mean(new_sum, old_mean, old_cnt, n) -> Column:
    """Running-mean merge ``(new_sum + old_mean*old_cnt) / (old_cnt + n)``.

    A missing old profile counts as count 0; old positions missing from a
    shorter old array count as 0 (and vice versa)."""
    old_cnt = F.coalesce(_c(old_cnt), F.lit(0)).cast("double")
    new_sum = F.coalesce(_c(new_sum), F.array().cast("array<double>"))
    old_mean = F.coalesce(_c(old_mean), F.array().cast("array<double>"))
    denom = old_cnt + F.coalesce(_c(n), F.lit(0)).cast("double")
    return F.zip_with(new_sum, old_mean,
                      lambda s, o: (F.coalesce(s, F.lit(0.0)) + F.coalesce(o, F.lit(0.0)) * old_cnt) / denom)


# -- sets / scores ----------------------------------------------------------

def jaccard(a, b) -> Column:
    """Jaccard of two arrays with set semantics; 0.0 when both are empty."""
    a, b = F.array_distinct(_c(a)), F.array_distinct(_c(b))
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def blend_score(sim_t, sim_k, sigma: float, beta: float) -> Column:
    """Combined score ``(simT*sigma + simK*beta) / sqrt(sigma^2 + beta^2)``."""
    denom = (sigma * sigma + beta * beta) ** 0.5
    return (_c(sim_t) * F.lit(sigma) + _c(sim_k) * F.lit(beta)) / F.lit(denom)
