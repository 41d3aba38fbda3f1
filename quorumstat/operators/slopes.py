"""Per-unit slopes and their spread between units."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.core import chi2_95, div, normal, replicates, spread, u01, with_row
from ..sources.sinks import cut
from .ordered import avg_ranks, few, keyed_order, quantiles
from .resample import permute, perm_p, signflip
from .stats import spearman, weighted_corr


def slope_se(df: DataFrame, by: list[str], x: str, y: str, extra: int = 0) -> DataFrame:
    """M3: OLS slope and standard error per group, df = n - 2 - extra.

    NULL below 4 rows, below 2 degrees of freedom or for a flat x. One aggregate.
    """
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.regr_sxx(y, x).alias("_sxx"), F.regr_sxy(y, x).alias("_sxy"),
        F.regr_syy(y, x).alias("_syy"))
    n, dof = F.col("n"), F.col("n") - 2 - extra
    b = div("_sxy", "_sxx")
    sse = F.greatest(F.col("_syy") - b * F.col("_sxy"), F.lit(0.0))
    ok = (n >= 4) & (dof >= 2) & (F.col("_sxx") / n >= 1e-18)
    return s.select(*by, "n", F.when(ok, b).alias("b"), F.when(ok, F.sqrt(div(sse, dof) / F.col("_sxx"))).alias("se"),
                    F.when(ok, F.sqrt(sse / n)).alias("resid_sd"), (F.col("_sxx") / n).alias("var_x"),
                    (F.col("_syy") / n).alias("var_y"))


def slope_split_half(df: DataFrame, unit: str, x: str, y: str, key: str, n_split: int, n_perm: int, seed,
                     min_rows: int) -> DataFrame:
    """M4: agreement of the slopes from two random halves of every unit's rows, with an
    identity-shuffle p (slopes of the last split dealt to other units)."""
    size = df.groupBy(unit).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows)
    d = df.select(unit, key, x, y).join(size, unit)
    r = keyed_order(replicates(d, n_split, "split"), ["split", unit], u01(seed, "split", key), key, "_rn", base=df, base_by=[unit])
    first = F.col("_rn") <= F.floor(F.col("_n") / 2)
    yy = lambda c: F.when(c, F.col(y))
    s = r.groupBy("split", unit).agg(F.regr_slope(yy(first), F.when(first, F.col(x))).alias("_a"),
                                     F.regr_slope(yy(~first), F.when(~first, F.col(x))).alias("_b"))
    s = s.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    small = few(df, unit)
    per = spearman(s, ["split"], "_a", "_b", small=small)
    obs = per.agg(F.avg("rho").alias("obs"))
    last = s.filter(F.col("split") == n_split - 1)
    rk = avg_ranks(last, [], {"_ra": "_a", "_rb": "_b"}, small=small).select(unit, "_ra", "_rb").withColumn("_w", F.lit(1))
    null = weighted_corr(permute(rk, unit, ["_rb"], n_perm, f"{seed}-null"), ["rep"], "_ra", "_rb", "_w", "v", "_n")
    p = perm_p(obs, null.select("rep", "v"), [])
    return with_row(p, last.agg(F.count(F.lit(1)).alias("n_units")))


def personalisation_gain(df: DataFrame, unit: str, x: str, y: str, min_rows: int, n: int, seed) -> DataFrame:
    """M5: squared error of the population slope (this unit left out) minus that of the
    unit's own slope (this row left out), per unit, with a sign-flip p.

    Both leave-one-outs are closed forms of moment sums: total minus own.
    """
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        unit, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    X, Y = F.col("_x"), F.col("_y")

    def sums(g, p):
        return g.agg(F.count(F.lit(1)).alias(f"{p}n"), F.sum(X).alias(f"{p}x"), F.sum(Y).alias(f"{p}y"),
                     F.sum(X * X).alias(f"{p}xx"), F.sum(X * Y).alias(f"{p}xy"))

    own, tot = sums(d.groupBy(unit), "u"), sums(d.groupBy(), "t")
    u = with_row(own.filter(F.col("un") >= min_rows), tot)
    rest = {k: F.col(f"t{k}") - F.col(f"u{k}") for k in ("n", "x", "y", "xx", "xy")}
    pop = div(rest["n"] * rest["xy"] - rest["x"] * rest["y"], rest["n"] * rest["xx"] - rest["x"] * rest["x"])
    u = u.withColumn("_pop", pop).filter(F.col("_pop").isNotNull())
    j = d.join(u.select(unit, "_pop", "un", "ux", "uy", "uxx", "uxy"), unit)
    m = F.col("un") - 1
    mx, my = (F.col("ux") - X) / m, (F.col("uy") - Y) / m
    sxx, sxy = F.col("uxx") - X * X, F.col("uxy") - X * Y
    slope = div(m * sxy - (F.col("ux") - X) * (F.col("uy") - Y), m * sxx - (F.col("ux") - X) * (F.col("ux") - X))
    j = j.withColumns({"_s": slope, "_dy": Y - my, "_dx": X - mx}).filter(F.col("_s").isNotNull())
    e = lambda b: (F.col("_dy") - b * F.col("_dx")) * (F.col("_dy") - b * F.col("_dx"))
    g = j.groupBy(unit).agg(F.count(F.lit(1)).alias("_k"), F.round(F.avg(e(F.col("_pop"))) - F.avg(e(F.col("_s"))), 9).alias("gain"))
    g = g.filter(F.col("_k") >= min_rows - 2)
    return signflip(g, [], "gain", unit, n, seed, "greater")


def tau_profile(df: DataFrame, by: list[str], b: str = "b", se: str = "se", reml: bool = True, grid: int = 400,
                min_units: int = 5) -> DataFrame:
    """M6: between-unit SD of slopes by profile likelihood with a 95 % interval.

    Every unit meets every grid variance in a generator; four sums per grid point combine
    map-side. The grid is even in log variance; the peak is the vertex of the parabola
    through the best point and its neighbours, unless these are level. The interval is read
    off the grid by linear interpolation.
    """
    d = df.filter(F.col(b).isNotNull() & (F.col(se) > 0)).select(*by, F.col(b).alias("_b"), (F.col(se) * F.col(se)).alias("_v"))
    c = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_units"), F.greatest(F.var_samp("_b") * 20, F.lit(1e-6)).alias("_hi"))
    c = c.filter(F.col("n_units") >= min_units)
    j = spread(d.join(F.broadcast(c), by) if by else with_row(d, c)).select("*", F.explode(F.sequence(F.lit(0), F.lit(grid))).alias("_j"))
    lo = math.log(1e-10)
    t2 = F.when(F.col("_j") == 0, F.lit(0.0)).otherwise(
        F.exp(F.lit(lo) + (F.col("_j") - 1) / F.lit(float(grid - 1)) * (F.log("_hi") - F.lit(lo))))
    w = F.lit(1.0) / (F.col("_v") + F.col("_t"))
    s = j.withColumn("_t", t2).withColumn("_w", w).groupBy(*by, "_j").agg(
        F.first("_t").alias("_t"), F.first("n_units").alias("n_units"), F.sum("_w").alias("_sw"),
        F.sum(F.col("_w") * F.col("_b")).alias("_swb"), F.sum(F.col("_w") * F.col("_b") * F.col("_b")).alias("_swbb"),
        F.sum(F.log("_w")).alias("_slw"))
    q = F.col("_swbb") - F.col("_swb") * F.col("_swb") / F.col("_sw")
    ll = F.lit(0.5) * F.col("_slw") - F.lit(0.5) * q
    if reml:
        ll = ll - F.lit(0.5) * F.log("_sw")
    s = s.withColumn("_ll", F.round(ll, 9))
    keys = by or ["_all"]
    if not by:
        s = s.withColumn("_all", F.lit(0))
    wj = W.partitionBy(*keys).orderBy("_j")  # grid + 1 rows per cell
    top = s.groupBy(*keys).agg(F.max("_ll").alias("_mx"), F.max_by("_j", F.struct("_ll", -F.col("_j"))).alias("_jh"))
    s = s.join(top, keys).withColumn("_g", 2 * (F.col("_mx") - F.col("_ll")) - F.lit(chi2_95))
    s = s.withColumns({"_pg": F.lag("_g").over(wj), "_pt": F.lag("_t").over(wj), "_bend": F.lag("_ll").over(wj) - 2 * F.col("_ll") + F.lead("_ll").over(wj),
                       "_tilt": F.lag("_ll").over(wj) - F.lead("_ll").over(wj), "_nt": F.lead("_t").over(wj)})
    steps = F.when((F.col("_j") >= 2) & (F.col("_bend") < -1e-4), 0.5 * div("_tilt", "_bend") * F.log(div("_nt", "_t")))
    s = s.withColumn("_peak", F.col("_t") * F.exp(F.coalesce(steps, F.lit(0.0))))
    cross = F.col("_pt") + (F.col("_t") - F.col("_pt")) * div("_pg", F.col("_pg") - F.col("_g"))
    at = lambda x: F.max(F.when(F.col("_j") == F.col("_jh"), F.col(x)))
    r = s.groupBy(*keys).agg(
        F.max("n_units").alias("n_units"), at("_peak").alias("_th"), (at("_swb") / at("_sw")).alias("beta"),
        F.max(F.when((F.col("_j") <= F.col("_jh")) & (F.col("_pg") > 0) & (F.col("_g") <= 0), cross)).alias("_lo"),
        F.min(F.when((F.col("_j") > F.col("_jh")) & (F.col("_pg") <= 0) & (F.col("_g") > 0), cross)).alias("_hi"),
        F.max("_t").alias("_mt"))
    return r.select(*by, "n_units", F.sqrt("_th").alias("tau"), F.sqrt(F.coalesce("_lo", F.lit(0.0))).alias("lo"),
                    F.sqrt(F.coalesce("_hi", "_mt")).alias("hi"), "beta")


def tau_cells(df: DataFrame, by: list[str], unit: str, x: str, y: str, grid: int = 400, min_units: int = 5,
              extra: int = 0) -> DataFrame:
    """Slopes per unit, their spread, and the medians that n* needs."""
    s = slope_se(df, [*by, unit], x, y, extra).filter(F.col("se") > 0)
    t = tau_profile(s, by, grid=grid, min_units=min_units)
    q = {"n_med": "n", "resid_sd": "resid_sd", "var_x": "var_x", "breakeven": "se"}
    small = few(df, unit)
    for name, c in q.items():
        m = quantiles(s, by, c, {name: 0.5}, small)
        t = t.join(m, by) if by else with_row(t, m)
    return t


def tau_null(df: DataFrame, unit: str, x: str, y: str, key: str, n: int, seed, grid: int = 200, min_units: int = 5) -> DataFrame:
    """M7: spread that pure estimation noise would show: real x, one common slope, normal
    residuals, the same within-unit z. Median over replicates, its Monte-Carlo error, and
    whether the observed spread passes it by two errors."""
    obs = cut(tau_cells(df, [], unit, x, y, grid, min_units), "tau")  # one row, used twice
    mx = df.groupBy(unit).agg(F.avg(x).alias("_mx"))
    d = with_row(df.select(unit, key, x).join(mx, unit), obs.select("beta", "resid_sd"))
    r = replicates(d, n)
    sim = F.col("beta") * (F.col(x) - F.col("_mx")) + F.col("resid_sd") * normal(seed, "rep", key)
    s = slope_se(r.withColumn("_sim", sim), ["rep", unit], x, "_sim")
    z = F.sqrt("var_y") + F.lit(1e-9)  # a z-score only rescales slope and error
    s = s.withColumns({"b": F.col("b") / z, "se": F.col("se") / z})
    t = tau_profile(s, ["rep"], grid=grid, min_units=min_units)
    m = t.agg(F.percentile("tau", F.lit(0.5)).alias("null"), F.count(F.lit(1)).alias("n_null"),
              (1.253 * F.stddev_samp("tau") / F.sqrt(F.count(F.lit(1)))).alias("mc_se"))
    return with_row(obs, m).withColumn("above_null", F.col("tau") - F.col("null") > 2 * F.col("mc_se"))


def tau_table(df: DataFrame) -> DataFrame:
    """M8: variance-additive correction, break-even and n* from a M7 row."""
    fix = lambda c: F.sqrt(F.greatest(F.col(c) * F.col(c) - F.col("null") * F.col("null"), F.lit(0.0)))
    d = df.withColumns({"tau_c": fix("tau"), "lo_c": fix("lo"), "hi_c": fix("hi")})
    star = lambda c: F.when(F.col(c) > 1e-9, F.col("n_med") * F.pow(F.col("breakeven") / F.nullif(F.col(c), F.lit(0.0)), F.lit(2.0)))
    return d.withColumns({"n_star": star("tau_c"), "n_star_lo": star("hi_c"),
                          "usable_now": F.col("above_null") & (F.col("lo_c") > F.col("breakeven"))})


def tau_bias_curve(df: DataFrame, unit: str, x: str, y: str, key: str, grid_n: list[int], reps: int, seed, grid: int = 200,
                   min_units: int = 5) -> DataFrame:
    """M9: spread of the same units measured on n random rows each, n along a grid."""
    r = replicates(df.select(unit, key, x, y), reps).withColumn("_u", u01(seed, "rep", key))
    w = W.partitionBy("rep", unit).orderBy("_u", key)
    r = r.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max(grid_n))  # limit before the shuffle
    size = df.groupBy(unit).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= max(grid_n))
    r = r.join(size, unit, "left_semi").select("*", F.explode(F.array(*[F.lit(g) for g in grid_n])).alias("n_rows"))
    s = slope_se(r.filter(F.col("_r") <= F.col("n_rows")), ["n_rows", "rep", unit], x, y)
    t = tau_profile(s, ["n_rows", "rep"], grid=grid, min_units=min_units)
    return t.groupBy("n_rows").agg(F.percentile("tau", F.lit(0.5)).alias("tau"), F.count(F.lit(1)).alias("n_reps"))


def budget_surface(df: DataFrame, unit: str, item: str, x: str, y: str, w_col: str, ks: list[int], reps: int, tau: float,
                   seed, min_units: int = 5) -> DataFrame:
    """Standard error of a unit's slope from k items of window w, the usable flag and
    the gain of doubling k. ``df`` holds one row per (unit, item, w)."""
    size = df.groupBy(w_col, unit).agg(F.count(F.lit(1)).alias("_n"))
    r = replicates(df.select(w_col, unit, item, x, y), reps).withColumn("_u", u01(seed, "rep", w_col, item))
    w = W.partitionBy("rep", w_col, unit).orderBy("_u", item)
    r = r.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max(ks)).join(size, [w_col, unit])
    r = r.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    r = r.filter((F.col("_r") <= F.col("k")) & (F.col("_n") >= F.col("k")))
    s = slope_se(r, [w_col, "k", unit, "rep"], x, y).filter(F.col("se").isNotNull())
    per = s.groupBy(w_col, "k", unit).agg(F.percentile("se", F.lit(0.5)).alias("_se"), F.count(F.lit(1)).alias("_c"))
    per = per.filter(F.col("_c") >= reps // 2)
    small = few(df, unit)
    m = quantiles(per, [w_col, "k"], "_se", {"se": 0.5}, small).join(
        per.groupBy(w_col, "k").agg(F.count(F.lit(1)).alias("n_units")), [w_col, "k"]).filter(F.col("n_units") >= min_units)
    half = m.select(w_col, (F.col("k") * 2).alias("k"), F.col("se").alias("_half"))
    j = m.join(half, [w_col, "k"], "left")
    return j.select(w_col, "k", (F.col("k") * F.col(w_col)).alias("budget"), "n_units", "se", (F.col("se") / tau).alias("se_over_tau"),
                    (F.col("se") < tau).alias("usable"), div("se", "_half").alias("gain_of_doubling"))


def state_interaction(pairs: DataFrame, unit: str, state: str, active, d: str, age: DataFrame, key_age: str, n: int, seed,
                      min_pairs: int = 3, grid: int = 200) -> DataFrame:
    """Per unit active minus passive with its combined error; sign-flip p of the three
    effects, spread of the response and of the interaction, and the relation to age."""
    a, v = F.col(state) == active, F.col(d)
    act, pas = F.when(a, v), F.when(~a, v)
    se = lambda c: F.stddev_samp(c) / F.sqrt(F.count(c))
    u = pairs.groupBy(unit).agg(F.count(act).alias("_na"), F.count(pas).alias("_np"), F.avg(act).alias("active"),
                                F.avg(pas).alias("passive"), se(act).alias("_sa"), se(pas).alias("_sp"))
    u = u.filter((F.col("_na") >= min_pairs) & (F.col("_np") >= min_pairs))
    u = u.select(unit, F.round("active", 9).alias("active"), F.round("passive", 9).alias("passive"),
                 F.round(F.col("active") - F.col("passive"), 9).alias("inter"), "_sa",
                 F.sqrt(F.col("_sa") * F.col("_sa") + F.col("_sp") * F.col("_sp")).alias("_si"))
    kv = F.array(*[F.struct(F.lit(c).alias("effect"), F.col(c).alias("v"), s.alias("se"))
                   for c, s in (("active", F.col("_sa")), ("passive", F.lit(None).cast("double")), ("inter", F.col("_si")))])
    lg = u.select(unit, F.explode(kv).alias("e")).select(unit, "e.*")
    p = signflip(lg, ["effect"], "v", unit, n, seed).select("effect", "n", "mean", "p")
    t = tau_profile(lg, ["effect"], "v", "se", grid=grid).select("effect", "tau", "lo", "hi")
    s = lg.groupBy("effect").agg(F.percentile("se", F.lit(0.5)).alias("sigma")) if few(pairs, unit) else quantiles(
        lg.filter(F.col("se").isNotNull()), ["effect"], "se", {"sigma": 0.5})
    r = spearman(lg.join(age, unit), ["effect"], key_age, "v", "rho_age", "_n").drop("_n")
    return p.join(t, "effect", "left").join(s, "effect", "left").join(r, "effect", "left").withColumn("ratio", div("tau", "sigma"))


def reconcile(cells: DataFrame, observed: DataFrame) -> DataFrame:
    """At each n, cells whose n* is reached against cells with an observed gain."""
    g = observed.groupBy("n").agg(F.count_if(F.col("gain") > 0).alias("observed_cells"))
    grid = observed.select("n").distinct().agg(F.sort_array(F.collect_set("n")).alias("_ns"))  # the n axis
    p = with_row(cells, grid).select("n_star", F.explode("_ns").alias("n")).groupBy("n").agg(
        F.count_if(F.col("n_star") <= F.col("n")).alias("predicted_cells"), F.count(F.lit(1)).alias("total_cells"))
    j = g.join(p, "n")
    return j.withColumn("agrees", F.abs(F.col("predicted_cells") - F.col("observed_cells")) <= 2)


def tau_match_units(df: DataFrame, unit: str, x: str, y: str, k: int, reps: int, seed, grid: int = 200) -> DataFrame:
    """The spread on random subsets of k units against the full one; it must not move."""
    s = slope_se(df, [unit], x, y).filter(F.col("se") > 0)
    full = tau_profile(s, [], grid=grid).select(F.col("tau").alias("tau_full"), F.col("n_units").alias("n_full"))
    r = replicates(s, reps).withColumn("_u", u01(seed, "rep", unit))
    r = r.withColumn("_r", F.row_number().over(W.partitionBy("rep").orderBy("_u", unit))).filter(F.col("_r") <= k)
    t = tau_profile(r, ["rep"], grid=grid).agg(F.percentile("tau", F.lit(0.5)).alias("tau"), F.count(F.lit(1)).alias("n_reps"))
    return with_row(t, full).withColumn("rel_change", div(F.col("tau") - F.col("tau_full"), "tau_full"))

