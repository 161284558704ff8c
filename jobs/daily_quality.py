"""Daily quality of arriving sensor series: coverage, spread and rock shares of each series and day, kept up to date.

Readings (event_id, ts, user_id: the series, value: gamma) arrive as Parquet files in a folder. Each run takes the files that
its checkpoint doesn't know yet (a file stream with availableNow), and every micro-batch

1. writes its own partial statistics to output/partials/day=D/batch=N, in place of what a broken run may have left there;
2. merges the partials of the days that it touched, however old, and replaces just those days in output/daily.

So late readings correct their day, a repeated batch changes nothing, and no run reads an old reading again.

    python -m jobs.daily_quality --config jobs/daily_quality.json --input logs/ --output quality/ --checkpoint quality-mark/
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import configured, counted, log, main, replaced
from strataflow.operators.features import gr_flags
from strataflow.schema import normalised

DEFAULTS = {"files_a_batch": 1000, "series": "user_id", "value": "value", "time": "ts", "id": "event_id"}


def partials(readings: DataFrame, names: dict) -> DataFrame:
    """day, well_id and statistics that can be merged: counts, mean and squared deviations, bounds, first and last reading."""
    day = F.date_format(names["time"], "yyyy-MM-dd").alias("day")
    rows = normalised(readings.select(day, F.col(names["series"]).alias("well_id"), F.col(names["time"]).alias("ts"), F.col(names["id"]).alias("id"), F.col(names["value"]).cast("double").alias("gr")))
    at = F.struct("ts", "id", "gr")
    return gr_flags(rows).groupBy("day", "well_id").agg(
        F.count("*").alias("n_rows"), F.count("gr").alias("n"), F.avg("gr").alias("mean"), (F.var_pop("gr") * F.count("gr")).alias("m2"), F.min("gr").alias("low"), F.max("gr").alias("high"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gr_shale", "gr_sand", "gr_mudstone")), F.min(F.when(F.col("gr").isNotNull(), at)).alias("first"), F.max(F.when(F.col("gr").isNotNull(), at)).alias("last"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """day, well_id and the statistics over all partials: deviations around the common mean, so that no digits are lost."""
    both = Window.partitionBy("day", "well_id")
    n = F.sum("n").over(both)
    mean = F.sum(F.col("mean") * F.col("n")).over(both) / F.when(n > 0, n)
    parts = parts.withColumn("__mean", mean)
    total = parts.groupBy("day", "well_id").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"), F.first("__mean").alias("gr_mean"), F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("__mean")) * (F.col("mean") - F.col("__mean"))).alias("m2"),
        F.min("low").alias("gr_min"), F.max("high").alias("gr_max"), *(F.sum(c).alias(c) for c in ("gr_shale", "gr_sand", "gr_mudstone")), F.min("first").alias("first"), F.max("last").alias("last"),
    )
    share = lambda c: F.try_divide(F.col(c), F.col("n"))
    return total.select(
        "day", "well_id", "n_rows", (F.lit(1.0) - F.col("n") / F.col("n_rows")).alias("missing_share"), "gr_mean", F.coalesce(F.sqrt(F.try_divide(F.col("m2"), F.col("n") - 1)), F.lit(0.0)).alias("gr_std"), "gr_min", "gr_max",
        share("gr_shale").alias("shale_share"), share("gr_sand").alias("sand_share"), share("gr_mudstone").alias("mudstone_share"), (F.col("last.gr") - F.col("first.gr")).alias("drift"),
    )


def run(spark: SparkSession, input: str, output: str, checkpoint: str, config: str | None = None) -> DataFrame:
    """Take the new files of `input` into output/daily (returned) and the mark at `checkpoint`."""
    names = configured(spark, config, DEFAULTS)

    def batch(readings: DataFrame, number: int) -> None:
        session = readings.sparkSession
        replaced(partials(readings, names).withColumn("batch", F.lit(number)), f"{output}/partials", "day", "batch")
        parts = session.read.option("basePath", f"{output}/partials").parquet(f"{output}/partials")
        mine = parts.filter(F.col("batch") == number)
        counted(mine, f"{output}/partials", f"batch {number}: wrote")
        days = mine.select(F.col("day").alias("touched")).distinct()
        found = parts.join(days, F.col("day").eqNullSafe(F.col("touched")), "left_semi")
        replaced(merged(found), f"{output}/daily", "day")

    stream = spark.readStream.schema(spark.read.parquet(input).schema).option("maxFilesPerTrigger", names["files_a_batch"]).parquet(input)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new rows in %d batches: %s", sum(p.numInputRows for p in query.recentProgress), len(query.recentProgress), input)
    return counted(spark.read.parquet(f"{output}/daily"), f"{output}/daily", "holds")


if __name__ == "__main__":
    main("daily_quality", run, ("input", "output", "checkpoint"))
