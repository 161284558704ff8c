"""Command line: python -m strataflow.cli COMMAND. Each command is a few calls of the library."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import rules
from .operators import features as ft
from .operators import models as ml
from .operators import relational as rel
from .plans import pipelines
from .sources import files, kv

FEATURES = ("md", "x", "y", "z", "gr_rmean_5", "gr_rstd_5", "gr_rmean_20", "horiz_dist", "md_frac", "tvt_ffill", "dist_from_last_known")


def _series(spark, path):
    return files.read_series(spark, path) if path.endswith((".csv", ".parquet")) else files.read_folder(spark, path)


def _frame(spark, path, priors):
    return ft.with_priors(ft.sequence_features(_series(spark, path)), priors)


def train(spark, a):
    """Train with a split by series, or repeatedly, or by cluster; prints errors and the most important features."""
    priors = files.read_priors(spark, a.priors) if a.priors else {}
    df = _frame(spark, a.data, priors)
    names = [*FEATURES, *(f"prior_{k}" for k, v in priors.items() if isinstance(v, (int, float)))]
    preset = {"trees": a.trees, "depth": a.depth}
    if a.cv_folds > 1:
        return [{"fold": f, "mae": m, "rmse": r} for f, m, r in ml.cross_validated(df, names, "tvt", a.cv_folds, **preset)]
    if a.clusters:
        wells = ft.well_fingerprint(df)
        labels = ml.WellClusterer(a.clusters).fit(wells, [c for c in wells.columns if c != "well_id"]).assign(wells).select("well_id", "cluster_id")
        return {"clusters": sorted(ml.per_cluster(df.join(labels, "well_id"), names, "tvt", **preset))}
    t, v = rel.split_wells(df)
    model, mae, rmse = ml.evaluated(t, v, names, "tvt", **preset)
    if a.model:
        model.write().overwrite().save(a.model)
    return {"mae": mae, "rmse": rmse, "importance": ml.importance(model, names)}


def predict(spark, a):
    """Predict every row (or unknown rows only) with a saved model; writes CSV."""
    from pyspark.ml import PipelineModel

    df = _frame(spark, a.data, files.read_priors(spark, a.priors) if a.priors else {})
    out = PipelineModel.load(a.model).transform(df.fillna(0.0, subset=list(FEATURES)))
    files.write_predictions(out.filter("tvt_input is null") if a.only_unknown else out, a.output)
    return {"written": a.output}


def ontology(spark, a):
    """Classify lithology descriptions."""
    df = spark.createDataFrame([(d,) for d in a.desc], "description string")
    made = zip(("lith_class", "lith_type", "environment", "confidence"), rules.lithology(F.col("description")))
    return [r.asDict() for r in df.withColumns(dict(made)).collect()]


def anomaly(spark, a):
    """Flag one reading against the history of a series."""
    df = spark.createDataFrame([(a.gr, a.tvt_delta)], "gr double, d double")
    recent = a.history[-10:]
    changes = [(float(y - x),) for x, y in zip(recent, recent[1:])]
    h = spark.createDataFrame(changes, "h double").agg(F.avg("h").alias("m"), F.stddev_pop("h").alias("s")).withColumn("n", F.lit(len(recent)))
    p = rules.continuity_prior(F.col("m"), F.col("s"), F.lit(a.tectonic), F.lit(a.sedimentary), F.col("n"))
    df = df.crossJoin(h).withColumns(p)
    return df.select(*(c.alias(n) for n, c in rules.anomaly_flags(F.col("gr"), F.col("d"), F.col("expected_std"), F.col("max_plausible_jump"), F.lit(a.sedimentary)).items())).first().asDict()


def cache(spark, a):
    """Statistics of the key/value cache, or what stays after clearing (written to --output)."""
    df = spark.read.schema(kv.SCHEMA).parquet(a.path)
    if a.action == "stats":
        return [{k: str(v) for k, v in r.asDict().items()} for r in kv.stats(df).collect()]
    if not a.output or a.output.rstrip("/") == a.path.rstrip("/"):
        raise SystemExit("cache --action clear needs an --output other than --path")
    stays = kv.cleared(df, a.source)
    stays.write.mode("overwrite").parquet(a.output)
    return {"deleted": df.count() - stays.count()}


def scrape(spark, a):
    """Rule-based record of a location (services are asked only through an injected transport)."""
    df = spark.createDataFrame([(a.lat, a.lon, a.age)], "lat double, lon double, age double")
    zone, temperature = rules.paleoclimate(F.col("lat"), F.col("age"))
    ocean, places, confidence = rules.ocean_proximity(F.col("lat"), F.col("lon"), F.col("age"))
    record = df.select("lat", "lon", F.col("age").alias("age_ma"), zone.alias("paleo_climate_zone"), temperature.alias("paleo_temp_proxy_c"), ocean.alias("paleo_ocean_proximity"), places.alias("likely_environments"), confidence.alias("confidence")).first().asDict()
    if a.output:
        files.write_priors(spark, record, a.output)
    return record


def pipeline(spark, a):
    """Feature families in up to four stages, each kept if it lowers the error: sequence, physics, sedimentary, hybrid."""
    kept, log, _ = pipelines.staged(_series(spark, a.data), a.phase, trees=a.trees, depth=a.depth)
    return {"features": kept, "log": log}


def run(spark, a):
    """From a place to a model: its record, the priors made of it (written to --output), training with them."""
    record = scrape(spark, argparse.Namespace(lat=a.lat, lon=a.lon, age=a.age, output=None))
    columns = {k: F.lit(v) for k, v in record.items() if v is not None and not isinstance(v, list)}
    priors = spark.range(1).select(*(c.alias(k) for k, c in rules.prior_features(columns).items())).first().asDict()
    if a.output:
        files.write_priors(spark, priors, a.output)
    df = ft.with_priors(ft.sequence_features(_series(spark, a.data)), priors)
    names = [*FEATURES, *(f"prior_{k}" for k in priors)]
    model, mae, rmse = ml.evaluated(*rel.split_wells(df), names, "tvt", trees=a.trees, depth=a.depth)
    if a.model:
        model.write().overwrite().save(a.model)
    return {"record": record, "mae": mae, "rmse": rmse, "n_features": len(names), "n_priors": len(priors)}


def anonymous(spark, a):
    """The run for coordinates without a datum: probe, alignment, geometry, ablation (report to --output), model."""
    reference = _series(spark, a.typewell) if a.typewell else None
    probe, study, model, names = pipelines.anonymous_study(_series(spark, a.data), reference, trees=a.trees, depth=a.depth)
    if a.output:
        files.write_report(study, a.output)
    if a.model:
        model.write().overwrite().save(a.model)
    return {"frame": probe, "report": [r["line"] for r in ml.report(study).orderBy("step").collect()], "n_features": len(names)}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="strataflow")
    sub = out.add_subparsers(dest="command", required=True)

    def command(f, *options):
        p = sub.add_parser(f.__name__, help=f.__doc__)
        for names, kw in options:
            p.add_argument(*names.split(), **kw)
        p.set_defaults(run=f)

    data, priors, model = ("--data", {"required": True}), ("--priors", {}), ("--model", {})
    trees, depth = ("--trees", {"type": int, "default": 20}), ("--depth", {"type": int, "default": 5})
    command(train, data, priors, model, trees, depth, ("--cv-folds", {"type": int, "default": 1}), ("--clusters", {"type": int, "default": 0}))
    command(predict, data, priors, ("--model", {"required": True}), ("--output", {"required": True}), ("--only-unknown", {"action": "store_true"}))
    command(ontology, ("--desc", {"nargs": "+", "required": True}))
    command(anomaly, *((f"--{n}", {"type": float, "default": d}) for n, d in (("gr", 80.0), ("tvt-delta", 0.0), ("tectonic", 0.3), ("sedimentary", 0.5))), ("--history", {"nargs": "*", "type": float, "default": []}))
    command(cache, ("--path", {"required": True}), ("--action", {"choices": ("stats", "clear"), "default": "stats"}), ("--source", {}), ("--output", {}))
    command(scrape, *((f"--{n}", {"type": float, "required": True}) for n in ("lat", "lon", "age")), ("--output", {}))
    command(pipeline, data, trees, depth, ("--phase", {"type": int, "choices": (1, 2, 3, 4), "default": 3}))
    command(run, data, model, trees, depth, ("--output", {}), *((f"--{n}", {"type": float, "required": True}) for n in ("lat", "lon", "age")))
    command(anonymous, data, model, trees, depth, ("--typewell", {}), ("--output", {}))
    return out


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("strataflow").getOrCreate()
    print(json.dumps(a.run(spark, a), default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
