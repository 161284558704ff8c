"""Queries of clustering and learning: checked on shape and metrics (no exact oracle)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import grouped as gr
from ..operators import models as ml
from ..operators import relational as rel
from ..plans.views import view
from ..sources.files import kept_table
from . import query, shaped

FEATURES = ["md", "x", "y", "z", "gr_rmean_5", "gr_rstd_5", "gr_lag1", "horiz_dist", "md_frac"]


def _frame(spark, sf_dir):
    return ft.sequence_features(view(spark, sf_dir, "well_log")).select("well_id", "row_seq", "tvt", *FEATURES, "tvt_ffill", "dist_from_last_known", "gr_rmean_20", "z_d1")


def _kept(spark, sf_dir):
    """_frame() written once: each fit and each judgement of a study reads it."""
    return kept_table(_frame(spark, sf_dir), "frame")


@query()
def kmeans_wells(spark, sf_dir):
    wells, names = _wells(spark, sf_dir)
    return shaped(ml.WellClusterer(3).fit(wells, names).assign(wells), ["well_id"], ["cluster_id"], ["cluster_dist"])


@query()
def gbt_baseline(spark, sf_dir):
    df = _frame(spark, sf_dir)
    train, val = rel.split_wells(df)
    model, _, _ = ml.evaluated(train, val, FEATURES, "tvt", trees=10, depth=4)
    return shaped(model.transform(val.fillna(0.0)), ["well_id", "row_seq"], [], ["prediction"])


@query()
def ablation(spark, sf_dir):
    train, val = rel.split_wells(_kept(spark, sf_dir))
    groups = {"position": FEATURES[:4], "gamma": ["gr_rmean_5", "gr_rstd_5"], "target": ["tvt_ffill", "dist_from_last_known"]}
    return shaped(ml.ablation(train, val, groups, "tvt", trees=5, depth=3), ["name"], ["step", "n_features"], ["mae", "rmse", "lift"])


@query()
def gated_pipeline(spark, sf_dir):
    train, val = rel.split_wells(_kept(spark, sf_dir))
    kept, log = ml.gated(train, val, FEATURES[:4], {"gamma": ["gr_rmean_20"], "target": ["tvt_ffill", "dist_from_last_known"], "depth": ["z_d1"]}, "tvt", trees=5, depth=3)
    rows = [(n, float(m), bool(a), len(kept)) for n, m, a in log]
    return shaped(spark.createDataFrame(rows, "name string, mae double, accepted boolean, n_features int"), ["name", "accepted"], ["n_features"], ["mae"])


@query()
def cross_validation(spark, sf_dir):
    rows = ml.cross_validated(_kept(spark, sf_dir), FEATURES, "tvt", 2, trees=3, depth=3)
    df = spark.createDataFrame([(int(f), float(m), float(r)) for f, m, r in rows], "fold int, mae double, rmse double")
    return shaped(df.agg(F.avg("mae").alias("mae_mean"), F.stddev_samp("mae").alias("mae_std"), F.avg("rmse").alias("rmse_mean")), [], [], ["mae_mean", "mae_std", "rmse_mean"])


def _wells(spark, sf_dir):
    """Fingerprints of all series, written once (scaling, reduction and clustering read them), and their names."""
    wells = kept_table(ft.well_fingerprint(view(spark, sf_dir, "well_log")), "wells")
    return wells, [c for c in wells.columns if c != "well_id"]


@query()
def ward_merges(spark, sf_dir):
    """The merge tree of all series by their scaled fingerprints."""
    wells, names = _wells(spark, sf_dir)
    made = ml.WellClusterer(5, hierarchical=True).fit(wells, names).merges
    return shaped(made, ["left", "right"], ["size", "round"], ["height"])


@query()
def ward_clusters(spark, sf_dir):
    """Five agglomerative clusters of all series, and how far each is from its cluster's mean."""
    wells, names = _wells(spark, sf_dir)
    return shaped(ml.WellClusterer(5, hierarchical=True).fit(wells, names).assign(wells), ["well_id"], ["cluster_id"], ["cluster_dist"])


@query()
def similar_series(spark, sf_dir):
    """The five series of its own cluster that are nearest to each series."""
    wells, names = _wells(spark, sf_dir)
    return shaped(ml.WellClusterer(3).fit(wells, names).similar(wells), ["query", "well_id"], ["rank"], ["distance"])


def _by_cluster(spark, sf_dir):
    wells, names = _wells(spark, sf_dir)
    labels = ml.WellClusterer(3).fit(wells, names).assign(wells).select("well_id", "cluster_id")
    rows = _frame(spark, sf_dir).join(labels, "well_id").withColumn("held", F.pmod(F.xxhash64("well_id"), F.lit(5)) == 0)
    rows = kept_table(rows, "grouped")  # read for bins, sizes, training and prediction
    models = gr.trained(rows, GROUPED, "tvt", held=F.col("held"), preset="quick").cache()  # a few rows, used twice
    return gr.predicted(rows, models, GROUPED), models


GROUPED = [*FEATURES, "tvt_ffill", "dist_from_last_known"]


@query()
def cluster_predictions(spark, sf_dir):
    """A boosted model of each cluster at the quick preset, stopped early, and its prediction of every row."""
    rows, _ = _by_cluster(spark, sf_dir)
    return shaped(rows, ["well_id", "row_seq"], ["cluster_id", "model_cluster"], ["prediction"])


@query()
def cluster_errors(spark, sf_dir):
    """Errors of these models on held-out series, by cluster, and the round at which training stopped."""
    rows, models = _by_cluster(spark, sf_dir)
    return shaped(gr.errors_by_cluster(rows.filter("held"), models, "tvt"), ["cluster_id"], ["n", "members", "rounds", "model_cluster"], ["mae", "rmse"])


@query()
def early_stopping(spark, sf_dir):
    """At the quick preset: the round where training stopped, the error on series that judged, and of the final fit of all rows."""
    rows = _frame(spark, sf_dir).withColumns({"cluster_id": F.lit(0), "held": F.pmod(F.xxhash64("well_id"), F.lit(5)) == 0})
    rows = kept_table(rows, "stopping")  # read for bins, sizes, training and prediction
    out = None
    for preset in ("quick",):
        models = gr.trained(rows, GROUPED, "tvt", held=F.col("held"), preset=preset, fallback=False).cache()  # a few rows
        held = gr.errors_by_cluster(gr.predicted(rows, models, GROUPED).filter("held"), models, "tvt").select("rounds", "n", "mae", "rmse")
        last = gr.final(rows, models, GROUPED, "tvt", preset=preset, fallback=False).cache()  # a few rows
        fit = gr.errors_by_cluster(gr.predicted(rows, last, GROUPED), last, "tvt").select(F.col("rounds").alias("final_rounds"), F.col("mae").alias("final_mae"))
        one = held.crossJoin(fit).withColumn("preset", F.lit(preset))  # a row each
        out = one if out is None else out.unionByName(one)
    return shaped(out, ["preset"], ["rounds", "n", "final_rounds"], ["mae", "rmse", "final_mae"])


@query()
def staged_pipeline(spark, sf_dir):
    """All four stages over the whole log: what each family gains on unseen series, and whether it stays."""
    from ..plans.pipelines import staged

    kept, log, _ = staged(view(spark, sf_dir, "well_log"), trees=20, depth=5)
    rows = [(n, float(m), bool(a), len(kept)) for n, m, a in log]  # a row a stage
    return shaped(spark.createDataFrame(rows, "name string, mae double, accepted boolean, n_features int"), ["name", "accepted"], ["n_features"], ["mae"])


@query()
def anonymous_features(spark, sf_dir):
    """Alignment and geometry of every row, for coordinates without a datum."""
    from ..plans.pipelines import anonymous

    _, df, groups = anonymous(view(spark, sf_dir, "well_log").drop("formation"))
    return shaped(df, ["well_id", "row_seq"], [], [*groups["alignment"], *groups["geometry"]])
