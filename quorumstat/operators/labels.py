"""Label building, filters, column discovery and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import col, nan_to_null, with_row
from .ordered import quantiles


def extreme_labels(df: DataFrame, axis: str, floor_col: str, sd_cols: list[str], lo: float, hi: float,
                   floor: float, cap: float) -> DataFrame:
    """Two ends of one axis, the middle dropped; uncertain rows dropped first.

    Low end (label 1) also needs ``floor_col`` at or above ``floor``.
    """
    keep = F.lit(True)
    for c in sd_cols:
        keep = keep & (F.col(c) <= cap)
    pos = (F.col(axis) <= lo) & (F.col(floor_col) >= floor)
    d = df.filter(keep).withColumn("label", F.when(pos, 1).when(F.col(axis) >= hi, 0))
    return d.filter(F.col("label").isNotNull()).withColumn(
        "category", F.when(F.col("label") == 1, "low").otherwise("high"))


def category_labels(df: DataFrame, c: str, pos: list[str], neg: list[str]) -> DataFrame:
    """Label 1 / 0 by category set; rows outside both sets are dropped."""
    return df.filter(F.col(c).isin(*pos, *neg)).withColumn("label", F.col(c).isin(*pos).cast("int"))


def missing_categories(df: DataFrame, c: str, wanted: list[str]) -> DataFrame:
    """P2 check: wanted categories that the table does not contain."""
    have = df.filter(F.col(c).isin(*wanted)).agg(F.collect_set(c).alias("_h"))  # at most len(wanted)
    return have.select(F.explode(F.array_except(F.array(*[F.lit(w) for w in wanted]), "_h")).alias(c))


def rescale(c, lo: float, hi: float) -> Column:
    """Linear map of [lo, hi] to [-1, 1]."""
    return (col(c) - (lo + hi) / 2.0) / ((hi - lo) / 2.0)


def group_key(c, regex: str, fallback) -> Column:
    """Group 1 of the pattern, or the fallback where nothing matches."""
    return F.coalesce(F.nullif(F.regexp_extract(col(c), regex, 1), F.lit("")), col(fallback))


def feature_cols(tables: list[DataFrame], label_tables: list[DataFrame]) -> list[str]:
    """P5: numeric columns in every table and in no label table (schemas only)."""
    numeric = [{f.name for f in d.schema.fields if isinstance(f.dataType, T.NumericType)} for d in tables]
    labels = {c for d in label_tables for c in d.columns}
    return sorted(set.intersection(*numeric) - labels)


def leak_columns(df: DataFrame, item: str, cols: list[str]) -> DataFrame:
    """Columns that are constant inside every item."""
    s = df.groupBy(item).agg(*[F.stddev_samp(c).alias(c) for c in cols])
    m = s.agg(*[F.max(F.coalesce(c, F.lit(0.0))).alias(c) for c in cols])
    return m.unpivot([], cols, "feature", "max_sd").withColumn("leak", F.col("max_sd") < 1e-9)


def drop_noise(df: DataFrame, rules: list[Column]) -> DataFrame:
    """Drop rows that match any rule; a rule that is NULL does not match."""
    for r in rules:
        df = df.filter(~F.coalesce(r, F.lit(False)))
    return df


def min_support(df: DataFrame, by: str, m: int, distinct: str | None = None) -> DataFrame:
    """Keep groups with at least m rows, or m distinct values of a column."""
    n = F.count(F.lit(1)) if distinct is None else F.countDistinct(distinct)
    keep = df.groupBy(by).agg(n.alias("_n")).filter(F.col("_n") >= m).select(by)
    return df.join(keep, by, "left_semi")


def tag_features(c, patterns: list[tuple[str, str]], default: str = "other") -> Column:
    """First matching pattern of an ordered list names the family."""
    out = None
    for pat, fam in patterns:
        out = F.when(col(c).rlike(pat), fam) if out is None else out.when(col(c).rlike(pat), fam)
    return out.otherwise(default)


def suffix_tag(c, suffixes: list[str], default: str = "raw") -> Column:
    out = None
    for s in suffixes:
        hit = col(c).endswith("_" + s)
        out = F.when(hit, s) if out is None else out.when(hit, s)
    return out.otherwise(default)


def spread_columns(df: DataFrame, stems: list[str], low: str = "p05", high: str = "p95", avg: str = "avg") -> DataFrame:
    """P10: one spread column (high - low percentile) per stem beside its level column."""
    return df.withColumns({f"{s}_range": F.col(f"{s}_{high}") - F.col(f"{s}_{low}") for s in stems
                           if {f"{s}_{high}", f"{s}_{low}"} <= set(df.columns)})


def constituent_set(c, prefix: str = "mix_") -> Column:
    """``mix_<kind>_<category>.._<n>-<take>..`` to the sorted set ``category#n``.

    Kind ``within`` names its single category once for all numbers.
    """
    tok = F.split(F.regexp_replace(col(c), f"^{prefix}", ""), "_")
    num = r"^\d+-\d+$"
    nums = F.transform(F.filter(tok, lambda x: x.rlike(num)), lambda x: F.split_part(x, F.lit("-"), F.lit(1)))
    cats = F.filter(F.slice(tok, 2, F.greatest(F.size(tok) - 1, F.lit(0))), lambda x: ~x.rlike(num))
    cats = F.when(tok[0] == "within", F.array_repeat(cats[0], F.size(nums))).otherwise(cats)
    k = F.least(F.size(nums), F.size(cats))
    both = F.transform(F.sequence(F.lit(1), k), lambda i: F.concat(F.element_at(cats, i), F.lit("#"), F.element_at(nums, i)))
    return F.when(col(c).startswith(prefix), F.array_sort(both)).otherwise(F.array().cast("array<string>"))


def fill(df: DataFrame, cols: list[str], how: str, train: Column | None = None) -> DataFrame:
    """``zero`` sends NaN, infinities and NULL to 0; ``median`` imputes with the
    median of the training rows."""
    if how == "zero":
        return df.withColumns({c: F.coalesce(nan_to_null(c), F.lit(0.0)) for c in cols})
    t = df.filter(train) if train is not None else df
    out = df
    for c in cols:
        out = with_row(out, quantiles(t.filter(F.col(c).isNotNull()), [], c, {f"_m_{c}": 0.5}))
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in cols}).drop(*[f"_m_{c}" for c in cols])


def stim_key(*cols: str) -> Column:
    """Composite stimulus key."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


# sets ------------------------------------------------------------------------

def with_variants(variants: dict[str, DataFrame], shared: list[DataFrame] = ()) -> DataFrame:
    """Tagged variants, each completed by the parts that do not change."""
    out = None
    for tag, d in variants.items():
        for part in (d, *shared):
            p = part.withColumn("variant", F.lit(tag))
            out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def common(dfs: list[DataFrame], key: str) -> DataFrame:
    """Keys present in every table."""
    out = dfs[0].select(key).distinct()
    for d in dfs[1:]:
        out = out.join(d.select(key), key, "left_semi")
    return out


def missing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of a that b does not have."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def first_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """U4: one row per key, the first in the order (map-side combined)."""
    rest = [c for c in df.columns if c != key]
    s = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return s.select(key, "_r.*")
