"""Learning on series features: splits, boosted trees, clustering, gates and ablation, by Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEFAULT, SeriesSchema
from . import clusters as cl
from . import relational as rel

#: Presets of (trees, step, depth, loss).
PRESETS = {"full": (2000, 0.03, 9, "absolute"), "quick": (800, 0.05, 7, "absolute"), "squared": (1000, 0.05, 8, "squared")}
GATE = 0.001


def lift(steps: DataFrame, order: str, error: str) -> DataFrame:
    """lift: how much less than the first step's error each step's is, in percent. Steps are few: one row each."""
    first = F.first(error).over(Window.partitionBy().orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("lift", (first - F.col(error)) / first * 100)


def best(steps: DataFrame, name: str = "name", gain: str = "lift") -> DataFrame:
    """name and gain of the step that gains most (of equal ones the least name)."""
    least = steps.join(F.broadcast(steps.agg(F.max(gain).alias("__most"))), F.col(gain) == F.col("__most")).drop("__most")  # one row
    return least.agg(F.min(name).alias(name), F.max(gain).alias(gain)).filter(F.col(name).isNotNull())


def report(steps: DataFrame) -> DataFrame:
    """step, line: a line of text for each row of ablation(), then the one that gains most (step after the last)."""
    sign = F.when(F.col("lift") > 0, F.lit("+")).otherwise(F.lit(""))
    text = lambda c, places: F.regexp_replace(F.format_number(c, places), ",", "")
    line = F.concat(F.rpad("name", 35, " "), F.lit(" MAE="), text("mae", 4), F.lit("  RMSE="), text("rmse", 4), F.lit("  Lift="), sign, text("lift", 1), F.lit("%  Features="), F.col("n_features").cast("string"))
    lines = steps.select(F.col("step").cast("long").alias("step"), line.alias("line"))
    last = best(steps).select(F.concat(F.lit("best: "), "name", F.lit(" ("), F.when(F.col("lift") > 0, "+").otherwise(""), text("lift", 1), F.lit("%)")).alias("line"))
    end = steps.agg((F.max("step") + 1).cast("long").alias("step"))
    return lines.unionByName(end.crossJoin(last))  # a row each


def regressor(features: Sequence[str], label: str, trees: int = 20, step: float = 0.1, depth: int = 5, loss: str = "absolute", validation: str | None = None, tolerance: float = 0.01) -> Pipeline:
    more = {"validationIndicatorCol": validation, "validationTol": tolerance} if validation else {}
    gbt = GBTRegressor(featuresCol="features", labelCol=label, maxIter=trees, stepSize=step, maxDepth=depth, lossType=loss, seed=42, **more)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), gbt])


def evaluated(train: DataFrame, val: DataFrame, features: Sequence[str], label: str, **preset) -> tuple[object, float, float]:
    """(model, MAE, RMSE on val). Rows without a label take no part; missing features are 0."""
    use = lambda df: df.filter(F.col(label).isNotNull()).select(label, *features).fillna(0.0)
    model = regressor(features, label, **preset).fit(use(train))
    r = rel.errors(model.transform(use(val)), label, "prediction").first()
    return model, r["mae"], r["rmse"]


def stopped(train: DataFrame, val: DataFrame, features: Sequence[str], label: str, share: float = 0.2, seed: int = 42, s: SeriesSchema = DEFAULT, **preset) -> tuple[object, int, float, float]:
    """(model, trees, MAE, RMSE on val): training ends where the error on a share of train's series falls no further; val is unseen."""
    use = lambda df, held: df.filter(F.col(label).isNotNull()).select(label, *features).fillna(0.0).withColumn("held", F.lit(held))
    fit, judge = rel.split_wells(train, share, seed, s)
    model = regressor(features, label, validation="held", **preset).fit(use(fit, False).unionByName(use(judge, True)))
    r = rel.errors(model.transform(use(val, True)), label, "prediction").first()
    return model, model.stages[-1].getNumTrees, r["mae"], r["rmse"]


def final_fit(df: DataFrame, features: Sequence[str], label: str, trees: int, **preset):
    """The model of all labelled rows, with the number of trees at which training stopped."""
    rows = df.filter(F.col(label).isNotNull()).select(label, *features).fillna(0.0)
    return regressor(features, label, trees=trees, **preset).fit(rows)


def importance(model, features: Sequence[str], k: int = 20) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, values)), key=lambda x: (-x[1], x[0]))[:k]


def cross_validated(df: DataFrame, features: Sequence[str], label: str, folds: int = 3, seed: int = 42, s: SeriesSchema = DEFAULT, **preset) -> list[tuple[int, float, float]]:
    """(fold, MAE, RMSE) of repeated splits by series with seeds seed + fold."""
    out = []
    for f in range(folds):
        train, val = rel.split_wells(df, 0.2, seed + f, s)
        out.append((f, *evaluated(train, val, features, label, **preset)[1:]))
    return out


def gated(train: DataFrame, val: DataFrame, base: Sequence[str], groups: dict[str, Sequence[str]], label: str, gate: float = GATE, **preset) -> tuple[list[str], list[tuple[str, float, bool]]]:
    """Feature groups in turn; one stays if the validation MAE falls by more than the gate. (features, log)."""
    features = list(base)
    best = evaluated(train, val, features, label, **preset)[1]
    log = [("baseline", best, True)]
    for name, columns in groups.items():
        mae = evaluated(train, val, [*features, *columns], label, **preset)[1]
        log.append((name, mae, best - mae > gate))
        if best - mae > gate:
            features, best = [*features, *columns], mae
    return features, log


def ablation(train: DataFrame, val: DataFrame, groups: dict[str, Sequence[str]], label: str, **preset) -> DataFrame:
    """name, step, mae, rmse, n_features, lift of cumulative feature groups."""
    rows, features = [], []
    for step, (name, columns) in enumerate(groups.items()):
        features = [*features, *columns]
        _, mae, rmse = evaluated(train, val, features, label, **preset)
        rows.append((name, step, float(mae), float(rmse), len(features)))
    return lift(train.sparkSession.createDataFrame(rows, "name string, step int, mae double, rmse double, n_features int"), "step", "mae")


class WellClusterer:
    """Scaled, reduced (PCA) and clustered series summaries. k = 0: the k of 3..9 with the best silhouette.

    hierarchical: Ward's agglomerative clustering (its merge tree stays in `merges`), else k-means."""

    def __init__(self, k: int = 0, parts: int = 10, hierarchical: bool = False, seed: int = 42):
        self.k, self.parts, self.hierarchical, self.seed = k, parts, hierarchical, seed

    def _model(self, k: int):
        return KMeans(k=k, seed=self.seed, featuresCol="reduced", initSteps=10)

    def reduced(self, wells: DataFrame) -> DataFrame:
        """wells and `reduced`, the point of each in the space of clusters."""
        return self.prepare.transform(wells.fillna(0.0)).drop("raw", "scaled")

    def fit(self, wells: DataFrame, features: Sequence[str], well: str = DEFAULT.well) -> WellClusterer:
        self.features, self.well = list(features), well
        prepare = Pipeline(stages=[
            VectorAssembler(inputCols=self.features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
            PCA(k=min(self.parts, len(self.features)), inputCol="scaled", outputCol="reduced"),
        ])
        self.prepare = prepare.fit(wells.fillna(0.0))
        ready = self.reduced(wells).cache()
        if not self.k:
            judge = ClusteringEvaluator(featuresCol="reduced")
            n = ready.count()
            scores = {k: judge.evaluate(self._model(k).fit(ready).transform(ready)) for k in range(3, 10) if k < n}
            self.k = max(scores, key=lambda k: (scores[k], -k)) if scores else 1
        if self.hierarchical:
            points = ready.select(well, vector_to_array("reduced").alias("v"))
            self.merges = cl.ward(points, well, "v")
            labelled = points.join(cl.cut(self.merges, points, well, self.k), well)
            means = labelled.select("cluster_id", F.posexplode("v").alias("p", "x")).groupBy("cluster_id", "p").agg(F.avg("x").alias("x"))
            rows = means.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda v: v["x"]).alias("c"))  # k rows, an entry a dimension
            self.centres = [r["c"] for r in rows.orderBy("cluster_id").collect()]
            self.labels = labelled.select(well, "cluster_id")
        else:
            self.model = self._model(self.k).fit(ready)
            self.centres = [[float(v) for v in c] for c in self.model.clusterCenters()]  # k rows
        ready.unpersist()
        return self

    def assign(self, wells: DataFrame) -> DataFrame:
        """wells with cluster_id and cluster_dist, the distance to the centre of its cluster. New series go to the nearest centre;
        series of an agglomerative fit keep the cluster that the merges gave them."""
        v = vector_to_array("reduced")
        distance = lambda c: F.sqrt(F.aggregate(F.zip_with(v, F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
        out = self.reduced(wells).withColumn("__d", F.array(*(F.struct(distance(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(self.centres))))
        nearest = F.array_min("__d")["i"]
        if self.hierarchical:
            out = out.join(self.labels, self.well, "left").withColumn("cluster_id", F.coalesce("cluster_id", nearest))
        else:
            out = out.withColumn("cluster_id", nearest)
        return out.withColumn("cluster_dist", F.get("__d", F.col("cluster_id"))["d"]).drop("reduced", "__d")

    def members(self, wells: DataFrame, cluster: int) -> DataFrame:
        """The series of a cluster."""
        return cl.members(self.assign(wells), self.well, cluster)

    def similar(self, wells: DataFrame, k: int = 5) -> DataFrame:
        """query, well, distance, rank: the k series of its own cluster nearest to each series."""
        points = self.reduced(wells).select(self.well, vector_to_array("reduced").alias("v"))
        return cl.similar(points, self.assign(wells).select(self.well, "cluster_id"), self.well, "v", k)


def per_cluster(df: DataFrame, features: Sequence[str], label: str, cluster: str = "cluster_id", least: int = 50, **preset) -> dict[int, object]:
    """A model for each cluster of at least `least` labelled rows."""
    known = df.filter(F.col(label).isNotNull())
    sizes = known.groupBy(cluster).count().filter(F.col("count") >= least).collect()  # one row a cluster
    return {r[0]: regressor(features, label, **preset).fit(known.filter(F.col(cluster) == r[0]).select(label, *features).fillna(0.0)) for r in sizes}
