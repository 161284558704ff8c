"""What the jobs share: their command line, configuration and log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("strataflow.jobs")


def configured(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults, overridden by a JSON file (read by Spark, so that its path may be remote); unknown names are errors."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if unknown := set(given) - set(defaults):
        raise ValueError(f"unknown settings in {path}: {', '.join(sorted(unknown))}")
    return defaults | given


def replaced(df: DataFrame, path: str, *partitions: str) -> None:
    """Write df's partitions in place of the same ones at path; all others stay. A repeated write leaves the same files' rows.

    A partition's rows meet in few tasks, large ones are split."""
    df.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def counted(df: DataFrame, path: str, what: str) -> DataFrame:
    """df, with a line in the log of how many rows it has."""
    log.info("%s %d rows: %s", what, df.agg(F.count("*")).first()[0], path)
    return df


def main(name: str, run: Callable[..., object], paths: tuple[str, ...]) -> None:
    """The command line: --config and one option a path. It alone creates and stops a session."""
    parser = argparse.ArgumentParser(prog=name, description=run.__doc__)
    parser.add_argument("--config", help="JSON file of settings")
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, **given)
    finally:
        spark.stop()
