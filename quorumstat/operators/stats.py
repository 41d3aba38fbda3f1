"""Aggregations, agreement scores, effect sizes and summary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.core import col, corr, div, norm_p_two_sided, with_row
from . import packed, ranged
from .ordered import avg_ranks, few, fits, quantiles, scan, sizes, squash


def item_means(df: DataFrame, item: list[str], unit: str, cols: list[str]) -> DataFrame:
    """A1: mean of each column per item and the number of distinct units."""
    return df.groupBy(*item).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in cols],
        F.countDistinct(unit).alias("n_units"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def frame_summary(df: DataFrame, by: list[str], idx: list[str], pos, x: str) -> DataFrame:
    """A2: mean, population SD, p10/p50/p90 and mean absolute first difference."""
    small = fits(df, by)
    d = scan(df, by, idx, pos, {"_prev": ("lag", x)}, small=small)
    base = d.groupBy(*by).agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
        F.avg(F.abs(F.col(x) - F.col("_prev"))).alias("dmean"),
    )
    return base.join(quantiles(df, by, x, {"p10": 0.1, "p50": 0.5, "p90": 0.9}, small), by)


def mean_std(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """A3: mean and sample SD of every metric column over folds."""
    return df.groupBy(*by).agg(
        *[e for c in cols for e in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))]
    )


def weighted_corr(df: DataFrame, by: list[str], x: str, y: str, w: str, out: str = "rho",
                  n: str = "n") -> DataFrame:
    """Pearson correlation of counted rows, NULL if either side is constant."""
    a, b, c = F.col(x), F.col(y), F.col(w)
    s = df.groupBy(*by).agg(
        F.sum(c).alias(n),
        F.sum(c * a).alias("_x"), F.sum(c * b).alias("_y"), F.sum(c * a * b).alias("_xy"),
        F.sum(c * a * a).alias("_xx"), F.sum(c * b * b).alias("_yy"),
        ((F.min(a) == F.max(a)) | (F.min(b) == F.max(b))).alias("_flat"),
    )
    m = F.col(n)
    cov = F.col("_xy") - F.col("_x") * F.col("_y") / F.nullif(m, F.lit(0))
    vx = F.col("_xx") - F.col("_x") * F.col("_x") / F.nullif(m, F.lit(0))
    vy = F.col("_yy") - F.col("_y") * F.col("_y") / F.nullif(m, F.lit(0))
    return s.select(*by, n, F.when(~F.col("_flat"), F.round(
        cov / F.nullif(F.sqrt(vx * vy), F.lit(0.0)), 10)).alias(out))


def spearman(df: DataFrame, by: list[str], x: str, y: str, out: str = "rho", n: str = "n",
             small: bool | None = None) -> DataFrame:
    """A4: Pearson on average ranks inside ``by``, snapped to 10 places.

    Groups that fit a slice are ranked whole behind one shuffle (``packed``), larger ones by one
    sort of one side (``ranged``). For other types, and a small table as one group, equal (x, y)
    pairs are counted first, so ties shrink the data before any shuffle.
    """
    if ranged.plain(df, by, x, y):
        tasks = None
        if small is None:
            small, tasks = sizes(df, by)
        if small and by:
            return packed.spearman(df, by, x, y, out, n, tasks)
        if not small:
            return ranged.spearman(df, by, {out: x}, y).select(*by, F.col("n").alias(n), out)
    p = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(
        F.count(F.lit(1)).alias("_w")
    )
    r = avg_ranks(p, by, {"_rx": x, "_ry": y}, weight="_w", small=small)
    return weighted_corr(r, by, "_rx", "_ry", "_w", out, n)


def reg_score(df: DataFrame, by: list[str], y: str, yhat: str) -> DataFrame:
    """A5: Spearman, Pearson, R2, MAE; NULL below 3 rows or for a flat prediction."""
    d = df.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    small = fits(d, by)
    s = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), corr(y, yhat).alias("pearson"),
        F.sum((F.col(y) - F.col(yhat)) * (F.col(y) - F.col(yhat))).alias("_sse"),
        F.var_pop(y).alias("_vy"),
        F.avg(F.abs(F.col(y) - F.col(yhat))).alias("_mae"),
        (F.min(yhat) == F.max(yhat)).alias("_flat"),
    )
    ok = (F.col("n") >= 3) & ~F.col("_flat")
    s = s.select(
        *by, "n", F.when(ok, F.col("pearson")).alias("pearson"),
        F.when(ok, 1 - div("_sse", F.col("n") * F.col("_vy"))).alias("r2"),
        F.when(ok, F.col("_mae")).alias("mae"), ok.alias("_ok"),
    )
    rho = spearman(d, by, y, yhat, "spearman", "_n2", small)
    j = s.join(rho, by, "left") if by else with_row(s, rho)
    return j.select(*by, "n", F.when(F.col("_ok"), F.col("spearman")).alias("spearman"),
                    "pearson", "r2", "mae")


def partial_spearman(df: DataFrame, by: list[str], x: str, y: str, z: str, form: str) -> DataFrame:
    """Rank correlation of x and y given z.

    ``form="pearson"`` correlates the rank residuals, ``form="spearman"`` ranks the
    residuals (rounded to 6 places) once more.
    """
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    small = fits(d, by)
    d = avg_ranks(d, by, {"_rx": x, "_ry": y, "_rz": z}, small=small)
    if form == "pearson":
        s = d.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"), corr("_rx", "_ry").alias("_xy"),
            corr("_rx", "_rz").alias("_xz"), corr("_ry", "_rz").alias("_yz"),
        )
        den = F.sqrt((1 - F.col("_xz") * F.col("_xz")) * (1 - F.col("_yz") * F.col("_yz")))
        return s.select(*by, "n", div(F.col("_xy") - F.col("_xz") * F.col("_yz"), den).alias("rho"))
    fit = d.groupBy(*by).agg(
        F.regr_slope("_rx", "_rz").alias("_bx"), F.regr_intercept("_rx", "_rz").alias("_ax"),
        F.regr_slope("_ry", "_rz").alias("_by"), F.regr_intercept("_ry", "_rz").alias("_ay"),
    )
    e = d.join(fit, by).select(
        *by,
        F.round(F.col("_rx") - F.col("_ax") - F.col("_bx") * F.col("_rz"), 6).alias("_ex"),
        F.round(F.col("_ry") - F.col("_ay") - F.col("_by") * F.col("_rz"), 6).alias("_ey"),
    )
    return spearman(e, by, "_ex", "_ey", small=small)


def cohens_d(df: DataFrame, by: list[str], x: str, flag) -> DataFrame:
    """Difference of two arms over the pooled sample SD (each arm >= 2 rows)."""
    f, v = col(flag), F.col(x)
    a, b = F.when(f, v), F.when(~f, v)
    s = df.groupBy(*by).agg(
        F.count(a).alias("n1"), F.count(b).alias("n0"), F.avg(a).alias("_m1"), F.avg(b).alias("_m0"),
        F.var_samp(a).alias("_v1"), F.var_samp(b).alias("_v0"),
    )
    pooled = F.sqrt(div((F.col("n1") - 1) * F.col("_v1") + (F.col("n0") - 1) * F.col("_v0"),
                        F.col("n1") + F.col("n0") - 2))
    return s.select(*by, "n1", "n0", F.when((F.col("n1") >= 2) & (F.col("n0") >= 2),
                                           div(F.col("_m1") - F.col("_m0"), pooled)).alias("d"))


def one_sample_d(df: DataFrame, by: list[str], d: str) -> DataFrame:
    """Mean over sample SD of paired differences."""
    return df.groupBy(*by).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean"), div(F.avg(d), F.stddev_samp(d)).alias("d")
    )


def class_score(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """AUC by rank sum, accuracy, precision and recall at 0.5, flipped AUC."""
    g = df.groupBy(*by, p, y).agg(F.count(F.lit(1)).alias("_w"))
    r = avg_ranks(g, by, {"_r": p}, weight="_w")
    w, pos, hit = F.col("_w"), F.col(y) == 1, F.col(p) >= 0.5
    cnt = lambda c: F.sum(F.when(c, w).otherwise(0))
    s = r.groupBy(*by).agg(
        cnt(pos).alias("n1"), cnt(~pos).alias("n0"), F.sum(F.when(pos, w * F.col("_r"))).alias("_rs"),
        cnt(pos & hit).alias("_tp"), cnt(~pos & hit).alias("_fp"), cnt(~pos & ~hit).alias("_tn"),
    )
    n1, n0 = F.col("n1"), F.col("n0")
    auc = div(F.col("_rs") - n1 * (n1 + 1) / 2.0, n1 * n0)
    return s.select(
        *by, "n1", "n0", auc.alias("auc"),
        div(F.col("_tp") + F.col("_tn"), n1 + n0).alias("accuracy"),
        F.coalesce(div("_tp", F.col("_tp") + F.col("_fp")), F.lit(0.0)).alias("precision"),
        F.coalesce(div("_tp", "n1"), F.lit(0.0)).alias("recall"),
        F.greatest(auc, 1 - auc).alias("auc_flipped"),
    )


def variance_shares(df: DataFrame, unit: str, item: str, value: str) -> DataFrame:
    """Share of the total sum of squares between units and between items."""
    n = F.count(F.lit(1))

    def between(k):
        c = df.groupBy(k).agg(n.alias("_n"), F.sum(value).alias("_s"))
        return c.agg(F.sum(F.col("_s") * F.col("_s") / F.col("_n")).alias(f"_b_{k}"))

    t = df.agg(n.alias("n"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_ss"))
    j = with_row(with_row(t, between(unit)), between(item))
    g = F.col("_s") * F.col("_s") / F.col("n")
    tot = F.col("_ss") - g
    u, i = div(F.col(f"_b_{unit}") - g, tot), div(F.col(f"_b_{item}") - g, tot)
    return j.select("n", u.alias("unit_share"), i.alias("item_share"), (1 - u - i).alias("residual_share"))


def agreement(df: DataFrame, unit: str, item: str, value: str, min_items: int) -> DataFrame:
    """Spearman of each unit against the item means, summarised over units."""
    means = df.groupBy(item).agg(F.avg(value).alias("_pop"))
    r = spearman(df.join(means, item), [unit], value, "_pop", small=fits(df, [unit]))
    r = r.filter((F.col("n") >= min_items) & F.col("rho").isNotNull())
    q = quantiles(r, [], "rho", {"median": 0.5, "p10": 0.1, "p90": 0.9}, few(df, unit))
    s = r.agg(F.count(F.lit(1)).alias("n_units"), F.avg("rho").alias("mean"),
              F.avg((F.col("rho") < 0).cast("int")).alias("frac_negative"))
    return with_row(s, q)


def effect_spread(df: DataFrame, unit: str, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Mean, population SD, sign agreement and p10/p90 of per-unit Spearman."""
    by = by or []
    r = spearman(df, [*by, unit], x, y).filter(F.col("rho").isNotNull())
    m = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n_units"), F.avg("rho").alias("mean_rho"),
                           F.stddev_pop("rho").alias("sd_rho"),
                           F.avg((F.col("rho") > 0).cast("int")).alias("_p"),
                           F.avg((F.col("rho") < 0).cast("int")).alias("_m"))
    q = quantiles(r, by, "rho", {"p10": 0.1, "p90": 0.9}, few(df, unit))
    j = m.join(q, by) if by else with_row(m, q)
    same = F.when(F.col("mean_rho") > 0, F.col("_p")).when(F.col("mean_rho") < 0, F.col("_m"))
    return j.withColumn("frac_same_sign", same).drop("_p", "_m")


def sign_consistency(df: DataFrame, by: list[str], v: str) -> DataFrame:
    """The larger of the positive and the negative share."""
    return df.filter(F.col(v).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"),
        F.greatest(F.avg((F.col(v) > 0).cast("int")), F.avg((F.col(v) < 0).cast("int"))).alias("frac_same_sign"),
    )


def direction_agreement(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Same sign in both effect tables, and the weaker of the two effects."""
    j = a.select(*key, F.col("d").alias("d_a")).join(b.select(*key, F.col("d").alias("d_b")), key)
    return j.withColumns({
        "same_direction": F.signum("d_a") == F.signum("d_b"),
        "min_abs_d": F.least(F.abs("d_a"), F.abs("d_b")),
    })


def topk_frequency(df: DataFrame, model: str, feature: str, imp: str, perf: str, eps: float, k: int) -> DataFrame:
    """Share of near-best models that have the feature among their top k."""
    best = df.agg(F.max(perf).alias("_best"))
    near = with_row(df, best).filter(F.col(perf) >= F.col("_best") - eps)
    n = near.agg(F.countDistinct(model).alias("_m"))
    w = W.partitionBy(model).orderBy(F.col(imp).desc(), feature)
    top = near.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k)
    return (with_row(top.groupBy(feature).agg(F.count(F.lit(1)).alias("n_top")), n)
            .select(feature, "n_top", (F.col("n_top") / F.col("_m")).alias("frequency")))


def consensus(df: DataFrame, model: str, feature: str, imp: str, k: int) -> DataFrame:
    """Features in the top k of every model, with their mean rank."""
    w = W.partitionBy(model).orderBy(F.col(imp).desc(), feature)
    r = df.withColumn("_rk", F.row_number().over(w))
    m = df.agg(F.countDistinct(model).alias("_m"))
    top = r.filter(F.col("_rk") <= k).groupBy(feature).agg(
        F.countDistinct(model).alias("n_models"), F.avg("_rk").alias("mean_rank")
    )
    return with_row(top, m).filter(F.col("n_models") == F.col("_m")).drop("_m")


def chain_count(df: DataFrame, feature: str, chain: str) -> DataFrame:
    """Number of distinct evidence chains that name a feature, on every row."""
    n = df.groupBy(feature).agg(F.countDistinct(chain).alias("n_chains"))
    return df.join(n, feature)


def oof_diversity(df: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """Correlation of every pair of prediction columns and its pair type.

    ``names`` maps prediction column to representation. All pairs come out of one
    aggregate over the wide table.
    """
    cs = sorted(names)
    pairs = [(a, b) for i, a in enumerate(cs) for b in cs[i + 1:]]
    s = df.agg(*[corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    kind = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                     F.lit("within" if names[a] == names[b] else "across").alias("kind"),
                     F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs]
    return s.select(F.explode(F.array(*kind)).alias("p")).select("p.*")


def mode_min(df: DataFrame, by: list[str], v: str) -> DataFrame:
    """Most frequent value, smallest value first on ties."""
    c = df.groupBy(*by, v).agg(F.count(F.lit(1)).alias("_n"))
    return c.groupBy(*by).agg(F.max("_n").alias("n"),
                              F.max_by(v, F.struct(F.col("_n"), -F.col(v))).alias("mode"))


def pivot_wide(df: DataFrame, ids: list[str], name: str, values: list, value: str) -> DataFrame:
    """Long to wide with a fixed list of names (no discovery job)."""
    return df.groupBy(*ids).pivot(name, values).agg(F.avg(value))


def share_dispersion(df: DataFrame, position: str, family: str, families: list) -> DataFrame:
    """SD over positions of each family share against its binomial expectation."""
    c = df.groupBy(position).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(F.when(F.col(family) == f, 1)).alias(f"_f{i}") for i, f in enumerate(families)],
    )
    t = c.agg(
        F.sum("_n").alias("_tot"), F.avg(1.0 / F.col("_n")).alias("_inv"),
        *[F.stddev_samp(F.col(f"_f{i}") / F.col("_n")).alias(f"_sd{i}") for i in range(len(families))],
        *[F.sum(f"_f{i}").alias(f"_t{i}") for i in range(len(families))],
    )
    k = len(families)
    obs = sum((F.col(f"_sd{i}") for i in range(k)), F.lit(0.0)) / k
    exp = F.lit(0.0)
    for i in range(k):
        p = F.col(f"_t{i}") / F.col("_tot")
        exp = exp + F.sqrt(p * (1 - p) * F.col("_inv"))
    exp = exp / k
    return t.select(obs.alias("observed"), exp.alias("expected"), div(obs, exp).alias("ratio"))


def duplicate_structure(df: DataFrame, set_col: str, group: str) -> DataFrame:
    """Distinct sets, clips per set, share in multi-clip sets, group degeneracy."""
    s = df.groupBy(set_col).agg(F.count(F.lit(1)).alias("_n"))
    a = s.agg(
        F.sum("_n").alias("n_clips"), F.count(F.lit(1)).alias("n_sets"), F.avg("_n").alias("mean_per_set"),
        F.max("_n").alias("max_per_set"),
        F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("n_in_multi"),
    )
    g = df.agg(F.countDistinct(group).alias("n_groups"))
    return with_row(a, g).select(
        "*", (F.col("n_in_multi") / F.col("n_clips")).alias("share_in_multi"),
        (F.col("n_groups") == F.col("n_clips")).alias("group_is_row"),
    )


def _sign_share(v: str, centre: str):
    return F.avg((F.signum(v) == F.signum(centre)).cast("int"))


def dose_response(df: DataFrame, by: list[str], source: str, dose: str, y: str) -> DataFrame:
    """Median over sources of the within-source Spearman with dose, and the
    share of sources with the median's sign."""
    r = spearman(df, [*by, source], dose, y).filter(F.col("rho").isNotNull())
    med = quantiles(r, by, "rho", {"median_rho": 0.5}, few(df, source))
    j = r.join(med, by) if by else with_row(r, med)
    return j.groupBy(*by, "median_rho").agg(
        F.count(F.lit(1)).alias("n_sources"), _sign_share("rho", "median_rho").alias("consistency"))


def dose_slopes(df: DataFrame, by: list[str], source: str, dose: str, y: str, min_rows: int = 3) -> DataFrame:
    """Per-source OLS slope on dose: median, mean, sign consistency."""
    s = df.groupBy(*by, source).agg(F.regr_slope(y, dose).alias("slope"), F.count(F.lit(1)).alias("_n"),
                                    F.stddev_samp(y).alias("_sd"))
    s = s.filter((F.col("_n") >= min_rows) & (F.col("_sd") >= 1e-12) & F.col("slope").isNotNull())
    med = quantiles(s, by, "slope", {"median_slope": 0.5}, few(df, source))
    j = s.join(med, by) if by else with_row(s, med)
    return j.groupBy(*by, "median_slope").agg(
        F.count(F.lit(1)).alias("n_sources"), F.avg("slope").alias("mean_slope"),
        _sign_share("slope", "median_slope").alias("consistency"))


def specificity(df: DataFrame, source: str, dose: str, lo, hi, features: list[str], target: str) -> DataFrame:
    """Mean absolute 0-to-max shift of every feature in SD units, the target's
    rank and its ratio to the largest other shift."""
    sd = df.agg(*[F.stddev_samp(f).alias(f"_sd_{f}") for f in features])
    per = df.groupBy(source).agg(
        *[e for f in features for e in (
            F.avg(F.when(F.col(dose) == lo, F.col(f))).alias(f"_a_{f}"),
            F.avg(F.when(F.col(dose) == hi, F.col(f))).alias(f"_b_{f}"))])
    shift = with_row(per, sd).agg(
        *[F.avg(F.abs(F.col(f"_b_{f}") - F.col(f"_a_{f}")) / F.nullif(F.col(f"_sd_{f}"), F.lit(0.0))).alias(f)
          for f in features])
    others = [f for f in features if f != target]
    top = F.greatest(*[F.col(f) for f in others])
    rank = sum(((F.col(f) > F.col(target)).cast("int") for f in others), F.lit(1))
    return shift.select(
        F.col(target).alias("target_shift"), top.alias("max_other"), div(target, top).alias("ratio"),
        rank.cast("int").alias("target_rank"))


def interaction(df: DataFrame, group: str, x: str, y: str, floor: float, min_rows: int) -> DataFrame:
    """Subgroup effects of both signs with at least one above the floor."""
    r = spearman(df, [group], x, y).filter(F.col("n") >= min_rows)
    pooled = spearman(df, [], x, y, "pooled_rho", "_n")
    s = r.agg(F.min("rho").alias("min_rho"), F.max("rho").alias("max_rho"),
              F.max(F.abs("rho")).alias("max_abs"), F.count(F.lit(1)).alias("n_groups"))
    return with_row(s, pooled.drop("_n")).withColumn(
        "interaction", (F.col("min_rho") < 0) & (F.col("max_rho") > 0) & (F.col("max_abs") >= floor))


def gates(df: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """A list of gates (name, value, threshold), passed when value <= threshold."""
    gs = F.array(*[
        F.struct(F.lit(n).alias("name"), (v <= t).alias("passed"), v.cast("double").alias("value"),
                 t.cast("double").alias("threshold")) for n, v, t in rules])
    return df.withColumn("gates", gs).withColumn("accepted", F.forall("gates", lambda g: g["passed"]))


def gate_rates(df: DataFrame) -> DataFrame:
    """A33 summary: pass rate per gate and the overall acceptance rate."""
    e = df.select("accepted", F.explode("gates").alias("g"))
    return e.groupBy(F.col("g.name").alias("gate")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("g.passed").cast("int")).alias("pass_rate"),
        F.avg(F.col("accepted").cast("int")).alias("accept_rate"))


def transfer_loss(df: DataFrame, value: str, within, by: list[str] | None = None) -> DataFrame:
    """1 - median cross / median within over score rows (one row per cell)."""
    by = by or []
    w = col(within)
    a = quantiles(df.filter(w), by, value, {"within": 0.5})
    b = quantiles(df.filter(~w), by, value, {"cross": 0.5})
    j = a.join(b, by, "full") if by else with_row(a, b)
    return j.withColumn("loss", 1 - div("cross", "within"))


def recovered(df: DataFrame, pair: list[str], k: str, rho: str, zero: str, ceiling: str) -> DataFrame:
    """Recovered fraction per k, over all pairs and over pairs present at max k."""
    f = df.withColumn("_f", div(F.col(rho) - F.col(zero), F.col(ceiling) - F.col(zero)))
    kmax = df.agg(F.max(k).alias("_kmax"))
    keep = with_row(df, kmax).filter(F.col(k) == F.col("_kmax")).select(*pair).distinct()
    bal = f.join(keep, pair, "left_semi")
    small = fits(df, [k])
    n = lambda d, c: d.groupBy(k).agg(F.count(F.lit(1)).alias(c))
    a = n(f, "n_all").join(quantiles(f, [k], "_f", {"median_all": 0.5}, small), k, "left")
    b = n(bal, "n_balanced").join(quantiles(bal, [k], "_f", {"median_balanced": 0.5}, small), k, "left")
    return a.join(b, k, "left")


def signal_quality(df: DataFrame, unit: str, x: str) -> DataFrame:
    """Range, SD and the smallest step between sorted distinct values."""
    d = scan(df.select(unit, x).distinct(), [unit], [x], squash(x), {"_p": ("lag", x)})
    step = d.groupBy(unit).agg(F.min(F.col(x) - F.col("_p")).alias("min_step"),
                               F.count(F.lit(1)).alias("n_levels"))
    s = df.groupBy(unit).agg((F.max(x) - F.min(x)).alias("range"), F.stddev_pop(x).alias("sd"))
    return s.join(step, unit)


def rollup_scores(df: DataFrame, group: str, value: str) -> DataFrame:
    """Median and count per subgroup plus the row "All".

    Counts come from one rollup; medians from the sorted histogram where groups are huge.
    """
    n = df.rollup(group).agg(F.count(F.lit(1)).alias("n"), F.grouping(group).alias("_g")).select(
        F.when(F.col("_g") == 1, F.lit("All")).otherwise(F.col(group).cast("string")).alias(group), "n")
    g = df.select(F.col(group).cast("string").alias(group), value)
    m = quantiles(g, [group], value, {"median": 0.5}).unionByName(
        quantiles(df, [], value, {"median": 0.5}).withColumn(group, F.lit("All")))
    return m.join(n, group).select(group, "median", "n")


def threshold_sweep(df: DataFrame, axis: str, sd: str, cuts: list[float], caps: list[float]) -> DataFrame:
    """Rows in both ends for every (cut, cap) pair, counted in a single pass."""
    cells = [(c, s) for c in cuts for s in caps]
    v, ok = F.col(axis), F.col(sd)
    aggs = []
    for i, (c, s) in enumerate(cells):
        aggs.append(F.count_if((v <= c) & (ok <= s)).alias(f"_l{i}"))
        aggs.append(F.count_if((v >= 1 - c) & (ok <= s)).alias(f"_h{i}"))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("cut"), F.lit(s).alias("cap"), F.col(f"_l{i}").alias("n_low"),
                 F.col(f"_h{i}").alias("n_high")) for i, (c, s) in enumerate(cells)])).alias("r")).select("r.*")


def profile(df: DataFrame, by: list[str], c: str, qs: dict[str, float]) -> DataFrame:
    """Exact quantile profile."""
    return quantiles(df, by, c, qs)


def verdicts(df: DataFrame, value: str, rules: list[tuple[str, Column, float]]) -> DataFrame:
    """Mean of a subset against a preset threshold, one row per rule."""
    one = df.agg(*[F.avg(F.when(c, F.col(value))).alias(f"_m{i}") for i, (_, c, _) in enumerate(rules)])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(f"_m{i}").alias("mean"), F.lit(float(t)).alias("threshold"),
                 (F.col(f"_m{i}") >= t).alias("passed")) for i, (n, _, t) in enumerate(rules)])).alias("r")).select("r.*")


def rank_shift(a: DataFrame, b: DataFrame, key: str, v: str, k: int) -> DataFrame:
    """Rank of every item in two runs, the shift, and who stays in the top k."""
    def ranked(d, out):
        n = scan(d.withColumn("_m", -F.col(v)), [], ["_m", key], squash("_m"), {out: ("row", None)})
        return n.select(key, out)

    j = ranked(a, "rank_a").join(ranked(b, "rank_b"), key)
    return j.withColumns({"shift": F.col("rank_b") - F.col("rank_a"),
                          "stays": (F.col("rank_a") <= k) & (F.col("rank_b") <= k)})


def with_p(df: DataFrame, z: str = "z", out: str = "p") -> DataFrame:
    """Two-sided normal p of a z column, as a vectorised UDF on aggregated rows."""
    return df.withColumn(out, norm_p_two_sided(F.col(z)))
