"""Term mapping: cached answers first, then an optional mapper (any function of a text, e.g. of a language model), else the rules."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import kv
from . import rules

SOURCE = "ontology"


def mapped(df: DataFrame, text: str, cache: DataFrame, now: Column, mapper: Callable[[str], str | None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(df with lith_class, lith_type, environment, confidence; entries to upsert). Answers are JSON of these four fields.

    Each distinct text, lower-cased and trimmed, is mapped once; a mapper that fails or returns None leaves it to the rules."""
    answer = "struct<lith_class: string, lith_type: string, environment: string, confidence: double>"
    names = ("lith_class", "lith_type", "environment", "confidence")
    df = df.withColumn("__t", F.lower(F.trim(F.coalesce(F.col(text), F.lit("")))))
    terms = df.select("__t").distinct().withColumn("key", kv.hash_key(F.lit(SOURCE), F.col("__t")))
    found = kv.lookup(terms, cache, now)
    ruled = F.to_json(F.struct(*(c.alias(n) for c, n in zip(rules.lithology(F.col("__t")), names))))
    if mapper is None:
        found = found.withColumn("__new", ruled)
    else:

        @F.pandas_udf("string")
        def ask(t: pd.Series) -> pd.Series:
            def one(x):
                try:
                    return mapper(x)
                except Exception:  # an outside service: whatever fails falls back to the rules
                    return None

            return t.map(one)

        found = found.withColumn("__new", F.coalesce(F.when(F.col("data").isNull(), ask("__t")), ruled))
    new = found.filter("data is null").select("key", F.lit(SOURCE).alias("source"), F.col("__t").alias("params"), F.col("__new").alias("data"), now.alias("fetched_at"))
    made = found.select("__t", F.from_json(F.coalesce("data", "__new"), answer).alias("__a"))
    return df.join(made, "__t").select(*(c for c in df.columns if c != "__t"), *(F.col(f"__a.{n}").alias(n) for n in names)), new
