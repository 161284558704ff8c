"""Sequence data sets and embeddings for neural models, which are trained elsewhere.

The neural encoders of this domain (causal transformer, convolutional typewell and gamma encoders) need a deep-learning
library, which Spark doesn't bring. Their data sets are built here; summary embeddings (scaled and reduced by PCA) stand in for
the learnt ones, deterministically."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT, SeriesSchema
from .matching import padded


def windows(df: DataFrame, features: Sequence[str], length: int, stride: int, s: SeriesSchema = DEFAULT) -> DataFrame:
    """well, start, inputs array<array<float>>, target: complete windows of `length` rows whose last row has a target."""
    row = F.array(*(F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in features))
    w = s.ordered.rowsBetween(-(length - 1), 0)
    df = df.withColumns({"__rn": F.row_number().over(s.ordered), "inputs": F.collect_list(row).over(w)})
    return df.filter((F.size("inputs") == length) & ((F.col("__rn") - length) % stride == 0) & F.col(s.target).isNotNull()).select(s.well, (F.col("__rn") - length).alias("start"), "inputs", F.col(s.target).alias("target"))


def encoded_reference(df: DataFrame, length: int = 200, formation: str = "formation", s: SeriesSchema = DEFAULT) -> DataFrame:
    """well, gr (by its 99th percentile, clipped), depth (0 to 1), formation (order of first sight by count), mask: padded arrays."""
    from pyspark.sql import Window

    p99 = F.percentile(s.gr, F.lit(0.99)).over(s.whole)
    low, high = F.min(s.md).over(s.whole), F.max(s.md).over(s.whole)
    first = F.min(s.md).over(Window.partitionBy(s.well, formation))
    df = df.withColumns({"__g": F.least(F.greatest(F.coalesce(F.try_divide(F.col(s.gr), p99), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), "__d": F.coalesce(F.try_divide(F.col(s.md) - low, high - low), F.lit(0.0)), "__first": first})
    df = df.withColumn("__o", F.dense_rank().over(Window.partitionBy(s.well).orderBy("__first", formation)) - 1)
    df = df.withColumn("__f", F.col("__o") / F.greatest(F.lit(1), F.max("__o").over(s.whole) + 1))
    rows = df.groupBy(s.well).agg(F.sort_array(F.collect_list(F.struct(*s.order, "__g", "__d", "__f"))).alias("r"))
    pick = lambda c: padded(F.transform("r", lambda x: x[c]), length)
    return rows.select(s.well, pick("__g").alias("gr"), pick("__d").alias("depth"), pick("__f").alias("formation"), padded(F.transform("r", lambda x: F.lit(1.0)), length).alias("mask"))


def contrastive_pairs(df: DataFrame, target_gap: float, limit_per_well: int, s: SeriesSchema = DEFAULT) -> DataFrame:
    """Pairs of rows of neighbouring series (by id) at like target values: positives for contrastive training."""
    cell = F.floor(F.col(s.target) / target_gap)
    a = df.filter(F.col(s.target).isNotNull()).select(F.col(s.well).alias("a"), F.col(s.order[-1]).alias("row_a"), cell.alias("cell"))
    first = a.groupBy("a", "cell").agg(F.min("row_a").alias("row_a"))
    b = first.select((F.col("a") - 1).alias("a"), "cell", F.col("a").alias("b"), F.col("row_a").alias("row_b"))
    from pyspark.sql import Window

    order = Window.partitionBy("a").orderBy("cell")
    return first.join(b, ["a", "cell"]).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= limit_per_well).drop("r", "cell")


def summary_embeddings(wells: DataFrame, key: str, features: Sequence[str], size: int) -> DataFrame:
    """key, embedding (unit length): a saved model of this pipeline embeds new series alike."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), PCA(k=min(size, len(features)), inputCol="scaled", outputCol="reduced"), Normalizer(inputCol="reduced", outputCol="unit")]
    model = Pipeline(stages=stages).fit(wells.fillna(0.0))
    return model.transform(wells.fillna(0.0)).select(key, vector_to_array("unit", "float32").alias("embedding"))
