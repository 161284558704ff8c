"""Rock context of described places: what a corpus of descriptions says of rock, environment and province.

Every document's text is read as a description and classified by the library's rules. Two tables come of it, both partitioned
by language: output/descriptions (one row a document, without its text) and output/context (one row a source: share of each
class of rock, commonest environment, provinces met, documents). A run replaces the languages that it finds; the same input
gives the same files' rows.

    python -m jobs.rock_context --config jobs/rock_context.json --input documents.parquet --output context/
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import configured, counted, main, replaced
from strataflow.functions import rules
from strataflow.sources.services import lithology_shares

DEFAULTS = {"id": "doc_id", "text": "text", "lang": "lang", "source": "source", "classes": None, "types": None, "environments": None, "provinces": None}
CLASSES = ("sedimentary", "igneous", "metamorphic", "unknown")


def described(docs: DataFrame, names: dict) -> DataFrame:
    """doc_id, lang, source, the four answers of the lithology rules and the province."""
    docs = docs.select(*dict.fromkeys(names[k] for k in ("id", "text", "lang", "source")))
    docs = docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a file of one row group would be one task
    docs = docs.withColumn("__low", F.lower(F.coalesce(F.col(names["text"]), F.lit("")))).withColumn("__text", F.trim("__low"))  # once a document, not once a word
    told = rules.lithology(F.col("__text"), names["classes"] or rules.LITHOLOGY_CLASSES, names["types"] or rules.LITHOLOGY_TYPES, names["environments"] or rules.ENVIRONMENTS, True)
    answers = [c.alias(n) for c, n in zip(told, ("lith_class", "lith_type", "environment", "confidence"))]
    province = rules.tectonic_province(F.col("__low"), None, names["provinces"] or rules.PROVINCES, True)
    return docs.select(F.col(names["id"]).alias("doc_id"), F.coalesce(F.col(names["lang"]), F.lit("und")).alias("lang"), F.coalesce(F.col(names["source"]), F.lit("none")).alias("source"), *answers, province.alias("province"))


def context(rows: DataFrame) -> DataFrame:
    """lang, source, n_docs, a share for each class, the commonest environment (ties: the first by name), provinces in order."""
    place = F.struct("lang", "source").alias("place")
    rows = rows.withColumn("place", place)
    shares = lithology_shares(rows, "place").groupBy("place").agg(*(F.coalesce(F.sum(F.when(F.col("lith_class") == c, F.col("share"))), F.lit(0.0)).alias(f"lith_{c}") for c in CLASSES))
    # counted by environment first: a source with most of the documents is a few rows
    seen = rows.groupBy("place", "environment").agg(F.count("*").alias("n"), F.collect_set("province").alias("provinces"))
    best = F.min_by("environment", F.struct(-F.col("n"), "environment"))
    seen = seen.groupBy("place").agg(F.sum("n").alias("n_docs"), best.alias("environment"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("provinces")))), ",").alias("provinces"))
    return seen.join(shares, "place").select("place.lang", "place.source", "n_docs", *(f"lith_{c}" for c in CLASSES), "environment", "provinces")


def run(spark: SparkSession, input: str, output: str, config: str | None = None) -> DataFrame:
    """Classify the documents of `input`; write output/descriptions and output/context (returned)."""
    names = configured(spark, config, DEFAULTS)
    docs = counted(spark.read.parquet(input), input, "read")
    replaced(described(docs, names), f"{output}/descriptions", "lang")
    rows = counted(spark.read.parquet(f"{output}/descriptions"), f"{output}/descriptions", "wrote")
    replaced(context(rows), f"{output}/context", "lang")
    return counted(spark.read.parquet(f"{output}/context"), f"{output}/context", "wrote")


if __name__ == "__main__":
    main("rock_context", run, ("input", "output"))
