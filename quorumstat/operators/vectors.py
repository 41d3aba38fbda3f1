"""Row-local functions on array columns and decibel arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import col, div

# Probe-tone key profiles (major, minor) and interval consonance weights.
KEY_MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
KEY_MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
CONSONANCE = [1.00, 0.10, 0.30, 0.60, 0.70, 0.80, 0.05, 0.90, 0.60, 0.70, 0.30, 0.15]


def vsum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` (lambdas do not share
    subexpressions)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(c) -> Column:
    return F.transform(col(c), lambda x: x.cast("double"))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two vectors."""
    return F.sqrt(vsum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def to_db(x, eps: float = 1e-8) -> Column:
    """amplitude to decibels."""
    return 20.0 * F.log10(col(x) + F.lit(eps))


def from_db(d) -> Column:
    """decibels to gain."""
    return F.pow(F.lit(10.0), col(d) / 20.0)


# Share of the log range removed at each dose.
SHRINK = {0: 0.0, 1: 0.4, 2: 0.7, 3: 0.9}


def shrink_range(df: DataFrame, by: list[str], x: str, dose: str, out: str = "gain") -> DataFrame:
    """gain that pulls the log level of a series towards its mean by dose."""
    db = to_db(x)
    mean = df.groupBy(*by).agg(F.avg(db).alias("_mean"))
    strength = F.create_map(*[F.lit(v) for kv in SHRINK.items() for v in kv])[F.col(dose)]
    j = df.join(mean, by)
    target = F.col("_mean") + (db - F.col("_mean")) * (1.0 - strength)
    return j.withColumn(out, from_db(target - db)).drop("_mean")


def _unit_template(t: list[float], k: int) -> list[float]:
    r = [t[(j - k) % len(t)] for j in range(len(t))]
    m = sum(r) / len(r)
    n = math.sqrt(sum((x - m) ** 2 for x in r))
    return [(x - m) / n for x in r]


def template_match(c) -> Column:
    """correlation of a 12-bin vector with both key profiles at all 12 shifts.

    Rotating the profile instead of the vector makes every score one dot product.
    """
    v = doubles(c)
    mean = vsum(v) / F.size(v)
    norm = F.sqrt(vsum(F.transform(v, lambda x: (x - mean) * (x - mean))))

    def scores(t):
        lits = F.array(*[F.array(*[F.lit(x) for x in _unit_template(t, k)]) for k in range(12)])
        return F.transform(lits, lambda r: F.coalesce(div(dot(v, r), norm), F.lit(0.0)))

    major, minor = scores(KEY_MAJOR), scores(KEY_MINOR)
    return F.struct(major.alias("major"), minor.alias("minor"))


def key_summary(df: DataFrame, c: str) -> DataFrame:
    """F7 summary: best scores, tonic, mode score and clarity."""
    d = df.withColumn("_m", template_match(c))
    bj, bn = F.array_max("_m.major"), F.array_max("_m.minor")
    best = F.when(bj >= bn, F.array_position("_m.major", bj)).otherwise(F.array_position("_m.minor", bn))
    every = F.concat("_m.major", "_m.minor")
    return d.withColumns({
        "major_strength": bj, "minor_strength": bn, "tonic": (best - 1).cast("int"),
        "mode_score": bj - bn, "clarity": F.array_max(every) - vsum(every) / 24.0}).drop("_m")


def circular_form(c, weights: list[float] = CONSONANCE) -> Column:
    """F8: sum over bin pairs of share_i * share_j * weight[(j - i) mod n]."""
    v = doubles(c)
    n = len(weights)
    w = F.array(*[F.lit(x) for x in weights])
    idx = F.sequence(F.lit(0), F.lit(n - 1))
    total = let(F.greatest(vsum(v), F.lit(1e-12)), lambda s: s * s)
    return vsum(F.transform(idx, lambda d: F.get(w, d) * vsum(
        F.transform(idx, lambda i: F.get(v, i) * F.get(v, (i + d) % n))))) / total


def entropy(c) -> Column:
    """entropy of a non-negative vector after normalising its sum."""
    v = doubles(c)
    return -let(F.greatest(vsum(v), F.lit(1e-12)), lambda s: vsum(
        F.transform(v, lambda x: (x / s) * F.log(x / s + 1e-12))))


def band_share(c, lo: int, hi: int) -> Column:
    """share of the total in bins [lo, hi)."""
    v = doubles(c)
    return div(vsum(F.slice(v, lo + 1, hi - lo)), vsum(v))


def loglog_slope(c, lo: int, hi: int, min_n: int = 8) -> Column:
    """OLS slope of log10(value) on log10(bin) over positive bins of [lo, hi)."""
    v = doubles(c)
    pts = F.filter(
        F.transform(F.sequence(F.lit(lo), F.lit(hi - 1)), lambda i: F.struct(i.alias("i"), F.get(v, i).alias("p"))),
        lambda s: s["p"] > 0)
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "x", "y", "xy", "xx")])

    def add(a, s):
        x, y = F.log10(s["i"].cast("double")), F.log10(s["p"])
        return F.struct((a["n"] + 1.0).alias("n"), (a["x"] + x).alias("x"), (a["y"] + y).alias("y"),
                        (a["xy"] + x * y).alias("xy"), (a["xx"] + x * x).alias("xx"))

    return F.aggregate(pts, zero, add, lambda a: F.when(
        a["n"] >= min_n, div(a["n"] * a["xy"] - a["x"] * a["y"], a["n"] * a["xx"] - a["x"] * a["x"])))


def row_z(c) -> Column:
    """z-score of a vector with population SD, floored at 1e-9."""
    def centred(v):
        return let(vsum(v) / F.size(v), lambda m: F.transform(v, lambda x: x - m))

    def scaled(v):
        sd = F.greatest(F.sqrt(vsum(F.transform(v, lambda x: x * x)) / F.size(v)), F.lit(1e-9))
        return let(sd, lambda s: F.transform(v, lambda x: x / s))

    return let(doubles(c), lambda v: let(centred(v), scaled))


def similarity(a: Column, b: Column) -> Column:
    """dot product over n of two z-scored vectors."""
    return let(a, lambda x: let(b, lambda y: dot(x, y) / F.size(x)))


def log_asymmetry(a, b, floor: float = 1e-20) -> Column:
    """difference of floored natural logs."""
    return F.log(F.greatest(col(a), F.lit(floor))) - F.log(F.greatest(col(b), F.lit(floor)))
