"""File scans and sinks: CSV and parquet series, folders of one file a series, predictions, reports, priors as JSON."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import file_stem
from ..schema import DEFAULT, SeriesSchema, normalised

SERIES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("md", "x", "y", "z", "gr", "tvt_input", "tvt")])


def read_series(spark: SparkSession, path: str, schema: T.StructType | None = None, s: SeriesSchema = DEFAULT) -> DataFrame:
    """A CSV (with header; give the schema to save a pass over the file) or parquet table; NaN as NULL; row_seq if absent."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.csv(path, header=True, schema=schema) if schema else spark.read.csv(path, header=True, inferSchema=True)
    return with_row_seq(normalised(df.withColumnsRenamed({c: c.lower() for c in df.columns})), s)


def with_row_seq(df: DataFrame, s: SeriesSchema = DEFAULT) -> DataFrame:
    """row_seq: place in its series by depth, then by place in the input; a table without series id is one series."""
    if s.well not in df.columns:
        df = df.withColumn(s.well, F.lit("series"))
    if "row_seq" in df.columns:
        return df
    df = df.withColumn("__at", F.monotonically_increasing_id())
    return df.withColumn("row_seq", F.row_number().over(Window.partitionBy(s.well).orderBy(s.md, "__at")).cast("long")).drop("__at")


def read_folder(spark: SparkSession, folder: str, schema: T.StructType | None = None, preferred: str = "*__horizontal_well.csv", s: SeriesSchema = DEFAULT) -> DataFrame:
    """All CSV files of a folder (those of the preferred pattern if there are any), each file's stem as its series id."""
    reader = spark.read.option("header", True).option("recursiveFileLookup", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    for pattern in (preferred, "*.csv"):
        try:
            df = reader.option("pathGlobFilter", pattern).csv(folder)
        except Exception as e:  # no file of the pattern
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            continue
        if schema is None or df.inputFiles():
            df = df.withColumn(s.well, file_stem(F.col("_metadata.file_path")))
            return with_row_seq(normalised(df.withColumnsRenamed({c: c.lower() for c in df.columns})), s)
    raise FileNotFoundError(f"no CSV files in {folder}")


def union(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns that one lacks are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_predictions(df: DataFrame, path: str, prediction: str = "prediction", s: SeriesSchema = DEFAULT) -> None:
    df.select(s.well, s.md, F.col(prediction).alias("TVT_predicted")).write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_priors(spark: SparkSession, path: str) -> dict:
    row = spark.read.json(path, multiLine=True).first()
    return row.asDict(recursive=True) if row else {}


def write_priors(spark: SparkSession, priors: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(priors, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir). Where that is unset, a session that runs
    on this machine alone gets a temporary one; on a cluster it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="strataflow-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: every model of a run reads the same features."""
    path = new_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made by new_folder() that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
