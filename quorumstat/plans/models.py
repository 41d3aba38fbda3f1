"""Spark ML and control-route queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import r6
from ..operators import attribution as at
from ..operators import kernels as kn
from ..operators import linear as ln
from ..operators import models as md
from .registry import query
from .stats import rounded
from .transfer import vecs, with_folds


def ml(t, k=3):
    return md.vectors(with_folds(t, k), "v")


def binary(t, k=3):
    d = md.vectors(with_folds(t, k), "embedding").withColumn("y", (F.col("label") < 5).cast("double"))
    return d.select("vec_id", "fold", "features", "y")


@query("M12_fit_regressors")
def _(t):
    d = ml(t)
    parts = [md.score(md.fit(d.filter("fold <> 0"), a, trees=5, depth=4), d.filter("fold = 0"), ["vec_id", "y"]).withColumn("algo", F.lit(a))
             for a in ("elastic_net", "forest", "boosting")]
    from ..operators.ordered import union_all
    from ..operators.stats import reg_score
    return rounded(reg_score(union_all(parts), ["algo"], "y", "pred"), "spearman", "pearson", "r2", "mae")


@query("M12_fit_classifiers")
def _(t):
    d = binary(t)
    from ..operators.ordered import union_all
    from ..operators.stats import class_score
    parts = [md.score(md.fit(d.filter("fold <> 0"), a, "class", trees=5, depth=4), d.filter("fold = 0"), ["vec_id", "y"], "class").withColumn("algo", F.lit(a))
             for a in ("logistic", "forest", "boosting")]
    return rounded(class_score(union_all(parts), ["algo"], "y", "pred"), "auc", "accuracy", "precision", "recall", "auc_flipped")


@query("M12_kernel_ridge")
def _(t):
    from ..operators.stats import reg_score
    d = with_folds(t)
    model = kn.fit(d.filter("fold <> 0"), "vec_id", "v", "y", landmarks=256, alpha=1.0)
    test = d.filter("fold = 0").withColumn("pred", model.predict("v"))
    return rounded(reg_score(test.withColumn("algo", F.lit("kernel_ridge")), ["algo"], "y", "pred"), "spearman", "pearson", "r2", "mae")


@query("M14_oof_matrix")
def _(t):
    from ..operators.stats import reg_score
    d = ml(t).select("vec_id", "corpus", "fold", "features", "y").withColumnRenamed("corpus", "src")
    p = md.oof_matrix(d, {"A": "src <> 'c2'", "B": "src = 'c2'"}, "fold", 3, ["elastic_net", "forest"], ["vec_id", "y"], trees=5, depth=4)
    return rounded(reg_score(p, ["corpus", "algo"], "y", "pred"), "spearman", "pearson", "r2", "mae")


@query("M15_transfer_matrix")
def _(t):
    d = ml(t).select("vec_id", "corpus", "features", "y")
    return rounded(md.transfer_matrix(d, "corpus", ["c0", "c1", "c2"], ["elastic_net", "forest"], "vec_id", trees=5, depth=4), "rho")


@query("M16_stack")
def _(t):
    d = binary(t)
    oof = md.oof_matrix(d, {"all": None}, "fold", 3, ["logistic", "forest", "boosting"], ["vec_id", "fold", "y"], "class", trees=4, depth=3)
    return rounded(md.stack(oof, "vec_id", "y", "fold", 3, 2, ["logistic", "forest", "boosting"]), "auc", "accuracy", "precision", "recall", "auc_flipped")


@query("M22_coral_sweep")
def _(t):
    return rounded(ln.coral_sweep(vecs(t).select("vec_id", "corpus", "domain", "v", "y"), "corpus", "domain", "vec_id", "v", 63, "y", [0.001, 0.01, 0.1]), "rho")


@query("M24_perm_importance")
def _(t):
    d = ml(t)
    m = md.fit(d.filter("fold <> 0"), "forest", trees=5, depth=4)
    return rounded(md.perm_importance(m, d.filter("fold = 0").select("vec_id", "v", "y"), "vec_id", "v", 63, 2, "m24"), "importance", "rho_full")


@query("M24_tree_attributions")
def _(t):
    d = ml(t)
    train, test = d.filter("fold <> 0"), d.filter("fold = 0")
    m = md.fit(train, "boosting", trees=20)
    return rounded(at.attribution_summary(at.tree_attributions(m, test.select("vec_id", "v"), train, "v", 63)), "importance", "mean_effect")


@query("M25_feature_significance")
def _(t):
    return rounded(md.feature_significance(ml(t), "vec_id", ["forest", "boosting"], 3, "m25", 0.3, trees=4, depth=3), "observed", "null_mean", "p")


@query("M26_rashomon")
def _(t):
    d = ml(t)
    grid = [{"trees": 4, "depth": 3}, {"trees": 6, "depth": 4}, {"trees": 8, "depth": 3}]
    return rounded(md.rashomon(d.filter("fold <> 0"), d.filter("fold = 0").select("vec_id", "v", "y"), "vec_id", "v", 63, grid, 0.05, 10, 1, "m26"), "frequency")


@query("M27_consensus_null")
def _(t):
    return rounded(md.consensus_null(ml(t), "vec_id", ["forest", "boosting"], 20, 3, "m27", trees=4, depth=3), "obs", "null_mean", "null_sd", "p")


def rated(t):
    """Ratings with a small feature vector: k, time of day, age in days, event type."""
    d = t.ratings
    kinds = [F.when(F.col("event_type") == e, 1.0).otherwise(0.0) for e in ("click", "error", "purchase", "signup")]
    x = F.array(F.col("k").cast("double"), (F.col("sec") % 86400) / 3600.0, F.col("sec") / 86400.0 - 19723.0, *kinds)
    return d.select("user_id", "event_id", "event_type", "k", "value", x.alias("x"))


@query("M28_decode_units")
def _(t):
    return rounded(ln.decode_units(rated(t), "user_id", "event_id", "x", 7, "value", 5, 4, 10, "m28"), "rho", "null_mean", "p")


@query("M29_virtual_raters")
def _(t):
    return rounded(md.virtual_raters(rated(t), "user_id", "k", "event_id", "x", 7, "value", 5, 4, "m29"), "rho_group", "rho_own", "rho_deviation")


def routed(t):
    return with_folds(t).select("vec_id", F.lit("all").alias("corpus"), "fold", "v", F.col("y").alias("rating"),
                                (F.col("y") + F.col("embedding")[10]).cast("double").alias("measure"))


@query("M30_mediated_route")
def _(t):
    return rounded(md.mediated_route(routed(t), "corpus", "fold", "vec_id", "v", 63, "rating", "measure", 5), "rho")


@query("M31_explained_residual")
def _(t):
    return rounded(md.explained_residual(routed(t), "corpus", "fold", "vec_id", "v", 63, "rating", "measure", 20, "m31"), "obs", "null_mean", "null_sd", "p")


@query("M32_compare_versions")
def _(t):
    d = with_folds(t).select("vec_id", F.lit("all").alias("corpus"), "fold", "v", "y")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n = d.withColumn("_n", norm).withColumn("v", F.transform("v", lambda x: x / F.col("_n"))).drop("_n")
    return rounded(md.compare_versions({"raw": d, "normalised": n}, "corpus", "fold", "vec_id", "v", 63, "y", 20, "m32"), "obs", "null_mean", "null_sd", "p", "mean_sd")
