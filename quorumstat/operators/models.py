"""Spark ML models: fits, out-of-fold matrices, importance, near-optimal sets."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import replicates, u01, with_row
from ..sources.sinks import cut
from .linear import affine, principal_axes, ridge_oof
from .ordered import fits, keyed_order, row_numbers, union_all
from .resample import bh, permute, spearman_perm
from .stats import class_score, spearman
from .timeline import deviation

SEED = 42


def vectors(df: DataFrame, vec: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.transform(vec, lambda x: x.cast("double"))))


def regressor(algo: str, trees: int = 20, depth: int = 5):
    """Linear models are scaled inside the pipeline, tree models are not."""
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    if algo == "elastic_net":
        return Pipeline(stages=[scale, LinearRegression(featuresCol="scaled", labelCol="y", predictionCol="pred", regParam=0.01,
                                                        elasticNetParam=0.5, standardization=False)])
    if algo == "forest":
        return Pipeline(stages=[RandomForestRegressor(labelCol="y", predictionCol="pred", numTrees=trees, maxDepth=depth, seed=SEED)])
    if algo == "boosting":
        return Pipeline(stages=[GBTRegressor(labelCol="y", predictionCol="pred", maxIter=trees, maxDepth=3, seed=SEED)])
    raise ValueError(algo)


def classifier(algo: str, trees: int = 20, depth: int = 5):
    if algo == "logistic":
        return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
                                LogisticRegression(featuresCol="scaled", labelCol="y", regParam=0.01)])
    if algo == "forest":
        return Pipeline(stages=[RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=depth, seed=SEED)])
    if algo == "boosting":
        return Pipeline(stages=[GBTClassifier(labelCol="y", maxIter=trees, maxDepth=3, seed=SEED)])
    raise ValueError(algo)


def fit(train: DataFrame, algo: str, task: str = "regression", **kw):
    """Fitted pipeline on columns (features, y)."""
    return (regressor if task == "regression" else classifier)(algo, **kw).fit(train)


def score(model, df: DataFrame, keep: list[str], task: str = "regression") -> DataFrame:
    p = model.transform(df)
    if task != "regression":
        p = p.withColumn("pred", vector_to_array("probability")[1])
    return p.select(*keep, "pred")


def oof_matrix(df: DataFrame, corpora: dict, fold: str, k: int, algos: list[str], keep: list[str], task: str = "regression", **kw) -> DataFrame:
    """Out-of-fold predictions for corpus x model; each fit is a distributed job.

    ``df`` is written out once, so the fits do not recompute its lineage.
    """
    d = cut(df, "oof")
    parts = []
    for name, where in corpora.items():
        c = d if where is None else d.filter(where)
        for algo in algos:
            for f in range(k):
                m = fit(c.filter(F.col(fold) != f), algo, task, **kw)
                parts.append(score(m, c.filter(F.col(fold) == f), keep, task).withColumns(
                    {"corpus": F.lit(name), "algo": F.lit(algo)}))
    return union_all(parts)


def transfer_matrix(df: DataFrame, corpus: str, names: list, algos: list[str], key: str, **kw) -> DataFrame:
    """Rho per (source, target, model): one fit per source scores every other corpus."""
    d = cut(df, "transfer")
    parts = []
    for s in names:
        for algo in algos:
            m = fit(d.filter(F.col(corpus) == s), algo, **kw)
            parts.append(score(m, d.filter(F.col(corpus) != s), [corpus, key, "y"]).withColumns(
                {"source": F.lit(str(s)), "algo": F.lit(algo)}))
    return spearman(union_all(parts).withColumnRenamed(corpus, "target"), ["source", "target", "algo"], "y", "pred", small=fits(d, [corpus]))


def stack(oof: DataFrame, key: str, y: str, fold: str, k: int, top: int, algos: list[str]) -> DataFrame:
    """Logistic stacking of the ``top`` base models by out-of-fold AUC."""
    oof = cut(oof, "stack")
    auc = class_score(oof, ["algo"], y, "pred").select("algo", "auc")
    best = [r["algo"] for r in auc.orderBy(F.col("auc").desc(), "algo").limit(top).collect()]
    wide = oof.groupBy(key, y, fold).pivot("algo", algos).agg(F.max("pred"))
    d = vectors(wide.withColumn("_z", F.array(*best)), "_z").withColumn("y", F.col(y).cast("double"))
    parts = []
    for f in range(k):
        m = LogisticRegression(labelCol="y", maxIter=100).fit(d.filter(F.col(fold) != f))
        p = m.transform(d.filter(F.col(fold) == f)).withColumn("pred", vector_to_array("probability")[1])
        parts.append(p.select(F.col(y).cast("int").alias("label"), "pred"))
    s = class_score(union_all(parts).withColumn("algo", F.lit("stacking")), ["algo"], "label", "pred")
    return s.unionByName(class_score(oof.withColumn("label", F.col(y).cast("int")), ["algo"], "label", "pred"))


def perm_importance(model, df: DataFrame, key: str, vec: str, dim: int, repeats: int, seed) -> DataFrame:
    """M24 (re-aimed): drop of Spearman when one feature is shuffled; replaces SHAP.

    All features and repeats are replicate rows of one transform.
    """
    n = dim * repeats
    base = df.select(key, vec, "y")
    small = fits(base, [])
    slots = row_numbers(base, [], [key], F.col(key), "_slot", small=small)
    r = replicates(base.select(key, F.col(vec).alias("_other")), n)
    r = keyed_order(r, ["rep"], u01(seed, "rep", key), key, "_slot", base=base, base_by=[], small=small)
    j = r.select("rep", "_slot", "_other").join(slots, "_slot").withColumn("feature", (F.col("rep") % dim).cast("int"))
    mixed = F.transform(vec, lambda x, i: F.when(i == F.col("feature"), F.get("_other", i)).otherwise(x))
    p = score(model, vectors(j.withColumn("_mv", mixed), "_mv"), ["rep", "feature", "y"])
    rho = spearman(p, ["feature", "rep"], "y", "pred", small=small)
    full = spearman(score(model, vectors(base, vec), [key, "y"]), [], "y", "pred", "_full", small=small).select("_full")
    return with_row(rho, full).groupBy("feature").agg(
        F.avg(F.col("_full") - F.coalesce("rho", F.lit(0.0))).alias("importance"), F.first("_full").alias("rho_full"))


def tree_importance(spark, model, algo: str, tags: dict) -> DataFrame:
    """Importance vector of a fitted tree pipeline as rows (model-sized)."""
    v = model.stages[-1].featureImportances.toArray().tolist()
    lit = F.array(*[F.lit(float(x)) for x in v])
    return spark.range(1).select(F.posexplode(lit).alias("feature", "importance")).withColumns(
        {"algo": F.lit(algo), **{k: F.lit(x) for k, x in tags.items()}})


def feature_significance(df: DataFrame, key: str, algos: list[str], n_perm: int, seed, q: float = 0.05, **kw) -> DataFrame:
    """Tree importance against refits on shuffled labels: p, step-up mask, and the
    features significant in every model."""
    spark = df.sparkSession
    d = cut(df.select(key, "features", "y"), "sig")
    shuffled = cut(permute(d, key, ["y"], n_perm, seed), "sig_null")
    obs, null = [], []
    for a in algos:
        obs.append(tree_importance(spark, fit(d, a, **kw), a, {}))
        for r in range(n_perm):
            null.append(tree_importance(spark, fit(shuffled.filter(F.col("rep") == r), a, **kw), a, {"rep": r}))
    o = union_all(obs)
    j = union_all(null).select("algo", "feature", F.col("importance").alias("_n")).join(o, ["algo", "feature"])
    p = j.groupBy("algo", "feature").agg(
        F.max("importance").alias("observed"), F.avg("_n").alias("null_mean"),
        ((1 + F.count_if(F.col("_n") >= F.col("importance"))) / (1 + F.count(F.lit(1)))).alias("p"))
    m = bh(p, ["algo"], "p", "feature", "mask", q)
    c = m.groupBy("feature").agg((F.count_if("significant") == len(algos)).alias("calibrated"))
    return m.join(c, "feature")


def rashomon(train: DataFrame, test: DataFrame, key: str, vec: str, dim: int, grid: list[dict], eps: float, k: int, repeats: int, seed) -> DataFrame:
    """Models within ``eps`` of the best held-out rho, and the share of them that
    ranks a feature among its top k."""
    from .stats import topk_frequency

    tr, te = cut(train, "rash_train"), cut(test, "rash_test")
    parts = []
    for i, kw in enumerate(grid):
        imp = perm_importance(fit(tr, "forest", **kw), te, key, vec, dim, repeats, seed)
        parts.append(imp.select(F.lit(i).alias("model"), "feature", "importance", F.col("rho_full").alias("perf")))
    return topk_frequency(cut(union_all(parts), "rash"), "model", "feature", "importance", "perf", eps, k)


def consensus_null(df: DataFrame, key: str, algos: list[str], k: int, n_perm: int, seed, **kw) -> DataFrame:
    """Number of features in every model's top k, against shuffled labels."""
    from .resample import perm_p
    from .sampling import topk

    spark = df.sparkSession
    d = cut(df.select(key, "features", "y"), "cons")
    shuffled = cut(permute(d, key, ["y"], n_perm, seed), "cons_null")
    parts = []
    for r in range(-1, n_perm):
        src = d if r < 0 else shuffled.filter(F.col("rep") == r)
        parts += [tree_importance(spark, fit(src, a, **kw), a, {"rep": r}) for a in algos]
    top = topk(cut(union_all(parts), "cons_imp"), ["rep", "algo"], [F.col("importance").desc(), "feature"], k)
    common = top.groupBy("rep", "feature").agg(F.count(F.lit(1)).alias("_m"))
    size = common.groupBy("rep").agg(F.count_if(F.col("_m") == len(algos)).cast("double").alias("v"))
    return perm_p(size.filter("rep < 0").select(F.col("v").alias("obs")), size.filter("rep >= 0"), [])


def virtual_raters(df: DataFrame, unit: str, item: str, key: str, vec: str, dim: int, y: str, folds: int, n_pc: int, seed,
                   min_rows: int = 30) -> DataFrame:
    """Per rater the rho of the group mean, of an own model, and of a model of the
    rater's deviations from the item means."""
    from .linear import decode_units

    d = deviation(df.select(unit, item, key, vec, y), [item], y, "_dev").withColumn("_mean", F.col(y) - F.col("_dev"))
    d = cut(d, "raters")  # read six times
    g = spearman(d, [unit], "_mean", y, "rho_group").filter(F.col("n") >= min_rows)
    own = decode_units(d, unit, key, vec, dim, y, folds, n_pc, 0, seed, min_rows=min_rows).select(unit, F.col("rho").alias("rho_own"))
    dev = decode_units(d, unit, key, vec, dim, "_dev", folds, n_pc, 0, seed, min_rows=min_rows).select(unit, F.col("rho").alias("rho_deviation"))
    return g.join(own, unit, "left").join(dev, unit, "left")


def mediated_route(df: DataFrame, corpus: str, fold: str, key: str, vec: str, dim: int, rating: str, measure: str, n_pc: int) -> DataFrame:
    """Rho with the measure of (direct) its own out-of-fold prediction, (mediated)
    the rating's out-of-fold prediction, and (pc) the leading principal axes."""
    d = cut(df, "route")
    small = fits(d, [])
    direct = ridge_oof(d, corpus, fold, key, vec, dim, measure)
    med = ridge_oof(d, corpus, fold, key, vec, dim, rating).join(d.select(key, measure), key)
    out = [spearman(direct, [], "pred", measure, small=small).select(F.lit("direct").alias("route"), "rho"),
           spearman(med, [], "pred", measure, small=small).select(F.lit("mediated").alias("route"), "rho")]
    import numpy as np

    mu, axes = principal_axes(d, vec, dim, n_pc)
    pc = affine(d, vec, mu, axes, np.zeros(n_pc), "_pc").select(F.posexplode("_pc").alias("_i", "_x"), measure)
    r = spearman(pc, ["_i"], "_x", measure, small=small)
    out.append(r.select(F.concat(F.lit("pc"), (F.col("_i") + 1).cast("string")).alias("route"), "rho"))
    return union_all(out)


def explained_residual(df: DataFrame, corpus: str, fold: str, key: str, vec: str, dim: int, rating: str, measure: str, n: int, seed) -> DataFrame:
    """The part of a rating that features predict, and the rest, each tested on the measure."""
    p = ridge_oof(cut(df, "expl"), corpus, fold, key, vec, dim, rating)
    j = cut(p.join(df.select(key, measure), key).withColumn("_res", F.round(F.col(rating) - F.col("pred"), 9)), "expl_parts")
    a = spearman_perm(j, "pred", measure, key, n, seed).withColumn("part", F.lit("predicted"))
    b = spearman_perm(j, "_res", measure, key, n, seed).withColumn("part", F.lit("residual"))
    return a.unionByName(b)


def compare_versions(versions: dict[str, DataFrame], corpus: str, fold: str, key: str, vec: str, dim: int, y: str, n: int, seed) -> DataFrame:
    """The same pipeline on alternative feature versions: rho, p, and feature spread."""
    from .transfer import vector_moments

    out = []
    for name, d in versions.items():
        d = cut(d, "version")
        p = cut(ridge_oof(d, corpus, fold, key, vec, dim, y), "version_oof")
        s = spearman_perm(p, "pred", y, key, n, seed)
        sd = vector_moments(d, [], vec, dim).select(
            F.aggregate(F.transform("var", lambda v: F.sqrt(v)), F.lit(0.0), lambda a, b: a + b, lambda a: a / dim).alias("mean_sd"))
        out.append(with_row(s, sd).withColumn("version", F.lit(name)))
    return union_all(out)
