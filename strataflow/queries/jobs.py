"""Queries of the runnable jobs: each runs its job twice into one new folder and reads the output back."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobs import daily_quality, rock_context

from ..functions import rules
from ..sources.files import new_folder
from . import query, shape, shaped
from .lookups import case, has

_DAY = "strftime(ts, '%Y-%m-%d') AS day, user_id AS well_id"
_QUALITY = ["missing_share", "gr_mean", "gr_std", "gr_min", "gr_max", "shale_share", "sand_share", "mudstone_share", "drift"]


@query(shape(f"""SELECT {_DAY}, count(*) AS n_rows, 1 - count(value) / count(*) AS missing_share, avg(value) AS gr_mean, coalesce(stddev_samp(value), 0) AS gr_std, min(value) AS gr_min, max(value) AS gr_max,
 avg((value > 100)::INT) AS shale_share, avg((value < 60)::INT) AS sand_share, avg((value BETWEEN 60 AND 100)::INT) AS mudstone_share,
 arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) - arg_min(value, (ts, event_id)) FILTER (value IS NOT NULL) AS drift FROM events GROUP BY 1, 2""", ["day", "well_id"], ["n_rows"], _QUALITY))
def job1_daily_quality(spark, sf_dir):
    """Quality of every series and day, from the file stream of events (a pattern: a stream takes folders or patterns)."""
    folder = new_folder(spark, "job1")
    for _ in range(2):
        out = daily_quality.run(spark, f"{sf_dir}/events*.parquet", f"{folder}/quality", f"{folder}/mark")
    return shaped(out.withColumn("day", F.date_format("day", "yyyy-MM-dd")), ["day", "well_id"], ["n_rows"], _QUALITY)


_T = "lower(trim(coalesce(text, '')))"
_CLASS = case([(f"{_T} = ''", "unknown"), *((has(_T, w), n) for n, w in rules.LITHOLOGY_CLASSES)], "unknown")
_PLACE = case([(f"{_T} = ''", "unknown"), *((has(_T, w), n) for n, w in rules.ENVIRONMENTS)], "unknown")
_PROVINCE = case([(has("lower(coalesce(text, ''))", w), n) for n, w in rules.PROVINCES], "unclassified")
_SHARES = [f"lith_{c}" for c in rock_context.CLASSES]


@query(shape(f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, coalesce(source, 'none') AS source, {_CLASS} AS lith_class, {_PLACE} AS environment, {_PROVINCE} AS province FROM documents),
 e AS (SELECT lang, source, arg_min(environment, (-n, environment)) AS environment FROM (SELECT lang, source, environment, count(*) AS n FROM d GROUP BY ALL) GROUP BY 1, 2)
 SELECT lang, source, n_docs, {", ".join(_SHARES)}, environment, provinces FROM (SELECT lang, source, count(*) AS n_docs, {", ".join(f"avg((lith_class = '{c}')::INT) AS lith_{c}" for c in rock_context.CLASSES)}, array_to_string(list_sort(list(DISTINCT province)), ',') AS provinces FROM d GROUP BY 1, 2) JOIN e USING (lang, source)""", ["lang", "source", "environment", "provinces"], ["n_docs"], _SHARES))
def job2_rock_context(spark, sf_dir):
    """What the documents of every source say of rock, environment and province."""
    folder = new_folder(spark, "job2")
    for _ in range(2):
        out = rock_context.run(spark, f"{sf_dir}/documents.parquet", folder)
    return shaped(out, ["lang", "source", "environment", "provinces"], ["n_docs"], _SHARES)
