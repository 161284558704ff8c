"""Endpoints of geological services, asked for many places at once: cache first, each distinct question once.

The cache is a table of files by source (key, params, data, fetched_at). A question that it can't answer goes to the transport
(in tasks, with retries), and its answer is appended; a failed one stays NULL and is asked again by the next run."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from . import kv
from .services import TRIES, Transport, adjacent_columns, fetch, lithology_shares, location_record, no_network, records

#: Columns near a place whose units are asked for.
NEAREST = 5


@dataclass(frozen=True)
class Endpoint:
    """A source's name in the cache, its address, where the records lie in an answer, and what one is."""

    source: str
    url: str
    path: str
    item: str


# Addresses and field names of the public services.
STRATA, MAPS = "https://macrostrat.org/api/v2", "https://mrdata.usgs.gov"
COLUMNS = Endpoint("macrostrat_columns", f"{STRATA}/columns", "$.success.data", "struct<col_id: bigint, col_name: string>")
UNITS = Endpoint("macrostrat_units", f"{STRATA}/units", "$.success.data", "struct<unit_id: bigint, unit_name: string, strat_name: string, lith: string, lith_type: string, lith_class: string, t_age: double, b_age: double, max_thick: double, environ: string, pbdb_collections: bigint>")
LITHOLOGIES = Endpoint("macrostrat_liths", f"{STRATA}/defs/lithologies", "$.success.data", "struct<lith_id: bigint, name: string, type: string, class: string>")
GEOLOGY = Endpoint("usgs_geounit", f"{MAPS}/sgmc", "$.geounit", "struct<unitname: string, age: string, lithology: string, description: string, state: string, sourcemap: string>")
MINERALS = Endpoint("usgs_mrds", f"{MAPS}/mrds", "$.results.result", "struct<dep_name: string, commod1: string, rrtype: string, dev_stat: string, latitude: double, longitude: double>")


def question(**values: Column) -> Column:
    """JSON text of the parameters, keys in order."""
    return F.to_json(F.struct(*(values[k].alias(k) for k in sorted(values))))


class Services:
    """The endpoints over one cache folder and one transport (a function of address, parameters and seconds)."""

    def __init__(self, spark: SparkSession, cache: str, transport: Transport = no_network, now: Column | None = None, days: int = kv.TTL_DAYS, tries: int = TRIES):
        self.spark, self.cache, self.transport, self.days, self.tries = spark, cache, transport, days, tries
        self.now = F.current_timestamp() if now is None else now

    def entries(self, source: str) -> DataFrame:
        """Fresh entries of a source, the latest of each key."""
        if not self._there(source):
            return kv.empty(self.spark)
        held = self.spark.read.schema(kv.SCHEMA).parquet(f"{self.cache}/source={source}")
        best = Window.partitionBy("key").orderBy(F.desc("fetched_at"), F.desc("data"))
        fresh = held.filter(F.col("fetched_at") >= self.now - F.make_dt_interval(F.lit(self.days)))
        return fresh.withColumn("__r", F.row_number().over(best)).filter("__r = 1").drop("__r")

    def _there(self, source: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.cache}/source={source}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def answers(self, asked: DataFrame, endpoint: Endpoint) -> DataFrame:
        """asked (with params) and data, the answer as JSON text or NULL."""
        keyed = asked.withColumn("key", kv.hash_key(F.lit(endpoint.source), F.col("params")))
        transport, url, tries = self.transport, endpoint.url, self.tries

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                yield p.assign(data=[fetch(transport, url, json.loads(x), tries) for x in p["params"]])

        missing = keyed.select("key", "params").distinct().join(self.entries(endpoint.source).select("key"), "key", "left_anti")
        new = missing.mapInPandas(run, "key string, params string, data string").filter("data is not null")
        new.select("key", F.lit(endpoint.source).alias("source"), "params", "data", self.now.alias("fetched_at")).write.mode("append").partitionBy("source").parquet(self.cache)
        return keyed.join(self.entries(endpoint.source).select("key", "data"), "key", "left").drop("key")

    def _records(self, asked: DataFrame, endpoint: Endpoint) -> DataFrame:
        return records(self.answers(asked, endpoint).drop("params"), endpoint.item, path=endpoint.path)

    def columns_near(self, places: DataFrame, radius_km: Column | None = None) -> DataFrame:
        """place, position, col_id, col_name: the strata columns around each place (place, lat, lon), as the service orders them."""
        radius = F.lit(200.0) if radius_km is None else radius_km
        asked = places.select("place", question(lat=F.col("lat"), lng=F.col("lon"), adjacentColumns=adjacent_columns(radius), response=F.lit("long")).alias("params"))
        body = F.from_json(F.get_json_object("data", COLUMNS.path), f"array<{COLUMNS.item}>")
        return self.answers(asked, COLUMNS).select("place", F.posexplode(body).alias("position", "__r")).select("place", "position", "__r.*")

    def formations_near(self, places: DataFrame) -> DataFrame:
        """place, col_id, col_name and the unit's fields, of the first NEAREST columns; columns without id are skipped, not replaced."""
        near = self.columns_near(places).filter((F.col("position") < NEAREST) & F.col("col_id").isNotNull())
        asked = near.select("col_id").distinct().withColumn("params", question(col_id=F.col("col_id"), response=F.lit("long")))
        text = lambda c: F.coalesce(c, F.lit("")).alias(c)
        units = self._records(asked, UNITS)
        return near.join(units, "col_id").select(
            "place", "col_id", text("col_name"), "unit_id", *map(text, ("unit_name", "strat_name", "lith", "lith_type", "lith_class")),
            F.col("t_age").alias("age_top"), F.col("b_age").alias("age_bottom"), F.col("max_thick").alias("thickness_m"), text("environ"), F.coalesce("pbdb_collections", F.lit(0)).alias("pbdb_collections"),
        )

    def lithologies(self) -> DataFrame:
        """The service's vocabulary of rocks."""
        return self._records(self.spark.range(1).select(question(response=F.lit("long")).alias("params")), LITHOLOGIES)

    def geologic_units(self, places: DataFrame) -> DataFrame:
        """place and the map units at it."""
        asked = places.select("place", question(lat=F.col("lat"), lng=F.col("lon"), output=F.lit("json")).alias("params"))
        names = zip(("unitname", "age", "lithology", "description", "state", "sourcemap"), ("unit_name", "unit_age", "lithology", "description", "state", "source_map"))
        return self._records(asked, GEOLOGY).select("place", *(F.coalesce(a, F.lit("")).alias(b) for a, b in names))

    def minerals_near(self, places: DataFrame, radius_km: float = 100.0) -> DataFrame:
        """place and the deposits around it."""
        asked = places.select("place", question(lat=F.col("lat"), lng=F.col("lon"), radius=F.lit(radius_km), format=F.lit("json"), maxrec=F.lit(50)).alias("params"))
        names = zip(("dep_name", "commod1", "rrtype", "dev_stat"), ("deposit_name", "commodities", "rock_type", "dev_status"))
        return self._records(asked, MINERALS).select("place", *(F.coalesce(a, F.lit("")).alias(b) for a, b in names), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))

    def location_records(self, places: DataFrame) -> DataFrame:
        """One record for each place (place, lat, lon, age_ma): shares of rock, ages, climate, province, deposits."""
        units, geology, minerals = self.formations_near(places), self.geologic_units(places), self.minerals_near(places)
        ages = units.groupBy("place").agg(F.min("age_top").alias("regional_age_min_ma"), F.max("age_bottom").alias("regional_age_max_ma"))
        said = geology.groupBy("place").agg(*(F.array_join(F.sort_array(F.collect_set(c)), " ").alias(n) for c, n in (("description", "__d"), ("unit_age", "__a"))))
        context = places.select("place").join(said, "place", "left").select("place", rules.tectonic_province(F.col("__d"), F.col("__a")).alias("tectonic_province"))
        context = context.join(minerals.groupBy("place").agg(F.count("*").alias("mineral_site_count")), "place", "left").fillna(0, subset=["mineral_site_count"])
        shares = lithology_shares(units.withColumn("lith_class", F.when(F.col("lith_class") != "", F.col("lith_class"))), "place")
        nowhere = self.spark.createDataFrame([], "place long, paleo_lon double, paleo_lat double").select(F.col("place").cast(places.schema["place"].dataType).alias("place"), "paleo_lon", "paleo_lat")
        return location_record(places, shares, ages, nowhere, context)


