"""Connectors to geological services: cache first, then the service with retries; NULL on failure.

The transport is injected (a function of URL and parameters), so that the connectors work offline on cached answers."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kv

#: Tries, seconds to wait for an answer; a failed try waits 2 ** attempt seconds.
TRIES, TIMEOUT = 3, 30
Transport = Callable[[str, dict, float], dict | list]


def no_network(url: str, params: dict, timeout: float):
    raise ConnectionError(f"no transport for {url}")


def fetch(transport: Transport, url: str, params: dict, tries: int = TRIES, wait: Callable[[float], None] = time.sleep) -> str | None:
    """The answer as JSON text, or None after so many failures."""
    for attempt in range(tries):
        try:
            return json.dumps(transport(url, params, TIMEOUT))
        except Exception:  # whatever the transport raises counts as a failed try
            if attempt + 1 < tries:
                wait(2**attempt)
    return None


def answers(asked: DataFrame, cache: DataFrame, source: str, url: str, now: Column, transport: Transport = no_network, tries: int = TRIES) -> tuple[DataFrame, DataFrame]:
    """(asked with `data`, entries to upsert): asked has params, a JSON text of sorted keys."""
    keyed = asked.withColumn("key", kv.hash_key(F.lit(source), F.col("params")))
    found = kv.lookup(keyed, cache, now)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.assign(data=[fetch(transport, url, json.loads(x), tries) for x in p["params"]])

    missing = found.filter("data is null").select("key", "params").distinct().mapInPandas(run, "key string, params string, data string").cache()
    new = missing.filter("data is not null").select("key", F.lit(source).alias("source"), "params", "data", now.alias("fetched_at"))
    out = found.drop("fetched_at").join(missing.select("key", F.col("data").alias("__new")), "key", "left")
    return out.withColumn("data", F.coalesce("data", "__new")).drop("__new"), new


def adjacent_columns(radius_km: Column) -> Column:
    """How many neighbouring columns a search of that radius asks for."""
    return F.floor(radius_km / 50).cast("int")


UNIT = "struct<unit_id: bigint, unit_name: string, strat_name: string, lith: string, lith_type: string, lith_class: string, t_age: double, b_age: double, max_thick: double, environ: string, pbdb_collections: int>"
GEOLOGIC = "struct<unit_name: string, unit_age: string, lithology: string, description: string, state: string, source_map: string>"
MINERAL = "struct<deposit_name: string, commodities: string, rock_type: string, dev_status: string, lat: double, lon: double>"


def records(df: DataFrame, item: str, data: str = "data", path: str | None = None) -> DataFrame:
    """One row for each record of a JSON answer that is a list, one record, or holds them at path."""
    body = F.get_json_object(data, path) if path else F.col(data)
    array = F.when(F.ltrim(body).startswith("["), F.from_json(body, f"array<{item}>")).otherwise(F.array(F.from_json(body, item)))
    return df.withColumn("__r", F.explode(array)).filter("__r is not null").select(*(c for c in df.columns if c != data), "__r.*")


def formations_near(columns: DataFrame, units: DataFrame, most: int = 5) -> DataFrame:
    """Units of the first `most` columns (place, col_id): columns without id are skipped, not replaced."""
    from pyspark.sql import Window

    order = Window.partitionBy("place").orderBy("position")
    first = columns.withColumn("__r", F.row_number().over(order)).filter((F.col("__r") <= most) & F.col("col_id").isNotNull()).drop("__r")
    return first.join(units, "col_id")


def reconstructed(df: DataFrame, data: str = "data") -> DataFrame:
    """paleo_lon, paleo_lat of a point answer; NULL where it lacks coordinates."""
    at = F.from_json(F.get_json_object(data, "$.coordinates"), "array<double>")
    return df.withColumns({"paleo_lon": F.get(at, 0), "paleo_lat": F.get(at, 1)}).drop(data)


def lithology_shares(units: DataFrame, by: str) -> DataFrame:
    """by, lith_class, share."""
    n = units.groupBy(by, "lith_class").count()
    total = n.groupBy(by).agg(F.sum("count").alias("__t"))
    return n.join(total, by).select(by, F.coalesce("lith_class", F.lit("unknown")).alias("lith_class"), (F.col("count") / F.col("__t")).alias("share"))


def location_record(places: DataFrame, shares: DataFrame, ages: DataFrame, paleo: DataFrame, context: DataFrame, key: str = "place") -> DataFrame:
    """One record a place: lithology shares, age range, palaeo position and climate, province, minerals."""
    from ..functions import rules

    wide = shares.groupBy(key).pivot("lith_class", ["sedimentary", "igneous", "metamorphic", "unknown"]).agg(F.first("share"))
    wide = wide.select(key, *(F.coalesce(c, F.lit(0.0)).alias(f"lith_{c}") for c in ("sedimentary", "igneous", "metamorphic", "unknown")))
    out = places
    for t in (wide, ages, paleo, context):
        out = out.join(t, key, "left")
    lat = F.coalesce("paleo_lat", "lat")
    zone, temperature = rules.paleoclimate(lat, F.col("age_ma"))
    return out.withColumns({"paleo_climate_zone": zone, "paleo_temp_proxy_c": temperature, "paleo_abs_latitude": F.abs(lat), "paleo_ocean_proximity": rules.ocean_proximity(lat, F.col("lon"), F.col("age_ma"))[0]})
