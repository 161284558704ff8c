"""A key/value cache with a time to live, as a table: key, source, params, data, fetched_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "key string, source string, params string, data string, fetched_at timestamp"
TTL_DAYS = 30


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def hash_key(source: Column, params_json: Column) -> Column:
    """sha256 of source:params, params being JSON with sorted keys."""
    return F.sha2(F.concat(source, F.lit(":"), params_json).cast("binary"), 256)


def lookup(asked: DataFrame, cache: DataFrame, now: Column, days: int = TTL_DAYS) -> DataFrame:
    """asked (key) with the data of fresh entries; NULL where there is none."""
    fresh = cache.filter(F.col("fetched_at") >= now - F.make_dt_interval(F.lit(days))).select("key", "data", "fetched_at")
    return asked.join(fresh, "key", "left")


def upserted(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of new replace those of equal key; of several new ones the latest (then the greatest data) counts."""
    best = Window.partitionBy("key").orderBy(F.col("fetched_at").desc(), F.col("data").desc())
    latest = new.withColumn("__r", F.row_number().over(best)).filter("__r = 1").drop("__r")
    return cache.join(latest.select("key"), "key", "left_anti").select(*cache.columns).unionByName(latest)


def stats(cache: DataFrame) -> DataFrame:
    return cache.groupBy("source").agg(F.count("*").alias("entries"), F.min("fetched_at").alias("oldest"), F.max("fetched_at").alias("newest"))


def cleared(cache: DataFrame, source: str | None = None) -> DataFrame:
    """What stays after deleting all entries, or those of a source."""
    return cache.filter(F.lit(False)) if source is None else cache.filter(F.coalesce(F.col("source") != source, F.lit(True)))
