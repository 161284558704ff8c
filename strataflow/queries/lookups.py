"""Queries of rules, text, JSON, dates and the key/value cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..plans.views import table, view, with_views
from ..schema import DEFAULT as S
from ..sources import kv
from . import query, shape, shaped


def case(cases, default):
    return "CASE " + " ".join(f"WHEN {c} THEN {v!r}" for c, v in cases) + f" ELSE {default!r} END"


_SPAN = "greatest(max(x) - min(x), max(y) - min(y))"
_FRAMES = [(f"min(x) >= -180 AND max(x) <= 180 AND min(y) >= -90 AND max(y) <= 90 AND {_SPAN} < 30", "latlon", 0.95), ("min(x) >= 100000 AND max(x) <= 900000 AND min(y) >= 0 AND max(y) <= 10000000", "utm", 0.85), (f"{_SPAN} < 100000 AND abs(min(x)) < 100000", "local_feet", 0.8), (f"{_SPAN} < 30000", "local_meters", 0.75)]


@query(with_views(f"SELECT {case([(c, n) for c, n, _ in _FRAMES], 'unknown')} AS frame, CAST({case([(c, v) for c, _, v in _FRAMES], 0.0)} AS DOUBLE) AS confidence FROM well_log", "well_log"))
def coord_probe(spark, sf_dir):
    return rules.coordinate_probe(view(spark, sf_dir, "well_log")).select("frame", "confidence")


_PLACE = "SELECT c_custkey, CAST(c_custkey % 181 - 90 AS DOUBLE) AS lat, CAST(c_custkey % 359 - 179 AS DOUBLE) AS lon, CAST(c_custkey % 400 AS DOUBLE) AS age FROM customer"
_ZONE = case([(f"abs(lat) < {k}", v) for k, v in ((10, "tropical"), (25, "subtropical"), (40, "warm_temperate"), (55, "cool_temperate"), (70, "subpolar"))], "polar")
_TEMP = case([(f"abs(lat) < {k}", v) for k, v in ((10, 28.0), (25, 24.0), (40, 18.0), (55, 10.0), (70, 2.0))], -8.0)


def _places(spark, sf_dir):
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c, (c % 181 - 90).cast("double").alias("lat"), (c % 359 - 179).cast("double").alias("lon"), (c % 400).cast("double").alias("age"))


@query(shape(f"SELECT *, {_ZONE} AS zone, {_TEMP} + CASE WHEN age > 66 THEN 4.0 ELSE 0 END AS temp FROM ({_PLACE})", ["c_custkey", "zone"], [], ["temp"]))
def paleoclimate(spark, sf_dir):
    zone, temp = rules.paleoclimate(F.col("lat"), F.col("age"))
    return shaped(_places(spark, sf_dir).withColumns({"zone": zone, "temp": temp}), ["c_custkey", "zone"], [], ["temp"])


_OCEAN = [("age BETWEEN 250 AND 300 AND abs(lat) < 20 AND lon > -30 AND lon < 30", "continental_interior", "fluvial_channel,eolian,lacustrine"), ("age BETWEEN 250 AND 300", "passive_margin_distal", "shallow_marine,deltaic_plain,carbonate_platform"), ("age BETWEEN 65 AND 145 AND abs(lat) < 50", "epicontinental_sea", "shallow_marine,carbonate_platform,deep_marine"), ("age BETWEEN 65 AND 145", "open_ocean_margin", "shallow_marine,carbonate_platform,deep_marine"), ("age < 2.6", "modern_analog", "fluvial_channel,deltaic_plain,shallow_marine")]


@query(shape(f"SELECT *, {case([(c, n) for c, n, _ in _OCEAN], 'uncertain')} AS category, {case([(c, v) for c, _, v in _OCEAN], 'unknown')} AS environments, {case([(c, 0.6) for c, _, _ in _OCEAN], 0.3)} AS confidence FROM ({_PLACE})", ["c_custkey", "category", "environments"], [], ["confidence"]))
def ocean_proximity(spark, sf_dir):
    category, environments, confidence = rules.ocean_proximity(F.col("lat"), F.col("lon"), F.col("age"))
    return shaped(_places(spark, sf_dir).withColumns({"category": category, "environments": F.array_join(environments, ","), "confidence": confidence}), ["c_custkey", "category", "environments"], [], ["confidence"])


_PROV = (("volcanic_arc", ("then", "erth")), ("rift_basin", ("schl", "der")), ("foreland_basin", ("que",)))
_LITH = (("sedimentary", ("sand", "that")), ("igneous", ("ione", "der")), ("metamorphic", ("que",)))
_ENV = (("marine", ("oran",)), ("fluvial", ("ment", "ung")))


def has(column, words):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@query(f"SELECT doc_id, {case([(has('lower(text)', w), n) for n, w in _PROV] + [(has('lower(source)', rules.OLD_AGES), 'cratonic_sag')], 'unclassified')} AS province FROM documents")
def tectonic_rules(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rules.tectonic_province(F.col("text"), F.col("source"), _PROV).alias("province"))


_T = "lower(trim(replace(coalesce(text, ''), chr(304), 'i' || chr(775))))"  # DuckDB's lower() makes a plain i of a dotted capital


@query(f"SELECT doc_id, {case([(has(_T, w), n) for n, w in _LITH], 'unknown')} AS lith_class, {case([(has(_T, [n]), n) for n in ('thing', 'ance', 'keit')], 'unknown')} AS lith_type, {case([(has(_T, w), n) for n, w in _ENV], 'unknown')} AS environment, CAST(CASE WHEN regexp_matches(coalesce(text, ''), '{rules.INK}') THEN 0.4 ELSE 0.0 END AS DOUBLE) AS confidence FROM documents")
def lith_rules(spark, sf_dir):
    names = ("lith_class", "lith_type", "environment", "confidence")
    made = rules.lithology(F.col("text"), _LITH, ("thing", "ance", "keit"), _ENV)
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in zip(names, made)))


@query("SELECT p_partkey, lower(replace(p_type, ' ', '_')) AS slug, regexp_extract('/data/' || p_brand || '.csv', '([^/]+?)(\\.[^./]*)?$', 1) AS stem FROM part")
def slug(spark, sf_dir):
    path = F.concat(F.lit("/data/"), "p_brand", F.lit(".csv"))
    return table(spark, sf_dir, "part").select("p_partkey", rules.slug(F.col("p_type")).alias("slug"), rules.file_stem(path).alias("stem"))


_KEY = "sha256('events:' || props)"
_CACHE = f"(SELECT {_KEY} AS key, event_type AS source, props AS params, CAST(value AS VARCHAR) AS data, ts AS fetched_at, event_id FROM events)"
_NOW = "(SELECT max(ts) FROM events)"


def _cache(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(kv.hash_key(F.lit("events"), F.col("props")).alias("key"), F.col("event_type").alias("source"), F.col("props").alias("params"), F.col("event_id").cast("string").alias("data"), F.col("ts").cast("timestamp").alias("fetched_at"), "event_id", "ts")


@query(f"SELECT event_id, {_KEY} AS key FROM events")
def hash_key(spark, sf_dir):
    return _cache(spark, sf_dir).select("event_id", "key")


@query(f"SELECT event_id, CASE WHEN ts >= {_NOW} - INTERVAL 30 DAYS THEN key END AS hit FROM (SELECT *, {_KEY} AS key FROM events)")
def ttl_lookup(spark, sf_dir):
    df = _cache(spark, sf_dir).withColumn("key", F.concat_ws("-", "key", "event_id"))
    now = df.agg(F.max("fetched_at").alias("now"))
    cache = df.crossJoin(F.broadcast(now))
    found = kv.lookup(df.select("key", "event_id"), cache, F.col("now"))
    return found.select("event_id", F.when(F.col("data").isNotNull(), F.split("key", "-")[0]).alias("hit"))


@query("SELECT event_type AS source, count(*) AS entries, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS oldest, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS newest FROM events GROUP BY 1")
def cache_stats(spark, sf_dir):
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c)
    return kv.stats(_cache(spark, sf_dir)).select("source", "entries", iso("oldest"), iso("newest"))


_LATEST = "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS r FROM events) WHERE r = 1"


@query(f"SELECT CAST(user_id AS VARCHAR) AS key, CAST(event_id AS VARCHAR) AS data FROM ({_LATEST}) UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    new = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("source"), F.col("props").alias("params"), F.col("event_id").cast("string").alias("data"), F.col("ts").cast("timestamp").alias("fetched_at"))
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.lit("old").alias("source"), F.lit("{}").alias("params"), F.col("c_mktsegment").alias("data"), F.timestamp_seconds(F.lit(0)).alias("fetched_at"))
    return kv.upserted(old, new).select("key", "data")


@query("SELECT event_id, event_type AS source FROM events WHERE event_type <> 'click'")
def cache_clear(spark, sf_dir):
    return kv.cleared(_cache(spark, sf_dir), "click").select("event_id", "source")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT lower(trim(p_type)) AS term, CASE WHEN contains(lower(p_type), 'steel') THEN 'cached' ELSE 'unknown' END AS lith_class, count(*) AS n FROM part GROUP BY 1, 2")
def map_batch_cached(spark, sf_dir):
    """Terms found in the cache take its entry, the others the rules."""
    parts = table(spark, sf_dir, "part").select(F.lower(F.trim("p_type")).alias("term"))
    keyed = parts.groupBy("term").agg(F.count("*").alias("n")).withColumn("key", kv.hash_key(F.lit("map"), F.col("term")))
    cache = keyed.filter(F.contains("term", F.lit("steel"))).select("key", F.lit("map").alias("source"), F.col("term").alias("params"), F.lit("cached").alias("data"), F.current_timestamp().alias("fetched_at"))
    found = kv.lookup(keyed, cache, F.current_timestamp())
    return found.select("term", F.coalesce("data", rules.lithology(F.col("term"))[0]).alias("lith_class"), "n")


_O = "OVER (PARTITION BY well_id ORDER BY row_seq)"
_D10 = "OVER (PARTITION BY well_id ORDER BY row_seq ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)"
_CP = f"SELECT *, coalesce(m, 0) AS expected_delta, least(greatest(coalesce(sd, 0.5) * 1.3 * 1.5, 0.1), 5) AS expected_std, least(greatest(3 * coalesce(sd, 0.5) * 1.3 * 1.5, 0.3), 10) AS max_plausible_jump FROM (SELECT *, avg(d) {_D10} AS m, stddev_pop(d) {_D10} AS sd FROM (SELECT *, tvt - lag(tvt) {_O} AS d FROM well_log))"
_CPN = ["expected_delta", "expected_std", "max_plausible_jump"]


def _continuity(spark, sf_dir):
    df = view(spark, sf_dir, "well_log").withColumn("d", F.col("tvt") - F.lag("tvt").over(S.ordered))
    df = df.withColumns({"m": F.avg("d").over(S.last(9)), "sd": F.stddev_pop("d").over(S.last(9)), "n": F.count("tvt").over(S.last(10))})
    return df.withColumns(rules.continuity_prior(F.col("m"), F.col("sd"), F.lit(0.3), F.lit(0.5), F.col("n")))


@query(with_views(shape(_CP, ["well_id", "row_seq"], [], _CPN), "well_log"))
def continuity_prior(spark, sf_dir):
    return shaped(_continuity(spark, sf_dir), ["well_id", "row_seq"], [], _CPN)


@query(with_views(shape(f"SELECT *, concat_ws(',', CASE WHEN abs(d) > max_plausible_jump THEN 'unexpected_tvt_jump' END, CASE WHEN gr > 100 AND 0.2 < 0.3 THEN 'gr_lithology_mismatch' END, CASE WHEN gr > 100 AND abs(d) > max_plausible_jump THEN 'possible_fault_crossing' END) AS flags, abs(d) / greatest(expected_std, 0.01) AS z_score FROM ({_CP})", ["well_id", "row_seq", "flags"], [], ["z_score"]), "well_log"))
def anomaly_flags(spark, sf_dir):
    made = rules.anomaly_flags(F.col("gr"), F.col("d"), F.col("expected_std"), F.col("max_plausible_jump"), F.lit(0.2))
    df = _continuity(spark, sf_dir).withColumns(made).withColumn("flags", F.array_join("anomaly_flags", ","))
    return shaped(df, ["well_id", "row_seq", "flags"], [], ["z_score"])


_PR = ["paleo_lat_norm", "paleo_lon_norm", "paleo_abs_lat_norm", "paleo_temp_norm", "climate_zone_enc", "ocean_prox_enc", "frac_sedimentary", "age_min_norm", "age_max_norm", "age_span_norm", "tectonic_enc", "mineral_site_density"]
_CODES = lambda column, codes, default: case([(f"{column} = {k!r}", float(v)) for k, v in codes.items()], float(default))


@query(shape(f"SELECT c_custkey, lat / 90 AS paleo_lat_norm, lon / 180 AS paleo_lon_norm, abs(lat) / 90 AS paleo_abs_lat_norm, temp / 35 AS paleo_temp_norm, {_CODES('zone', rules.CLIMATE_CODES, -1)} / 5 AS climate_zone_enc, {_CODES('category', rules.OCEAN_CODES, -1)} / 5 AS ocean_prox_enc, 0.0 AS frac_sedimentary, ln(101) / ln(541) AS age_min_norm, ln(1 + age) / ln(541) AS age_max_norm, ln(1 + greatest(0, age - 100)) / ln(541) AS age_span_norm, 0.9 AS tectonic_enc, least(1, (c_custkey % 90) / 50.0) AS mineral_site_density FROM (SELECT *, {_ZONE} AS zone, {_TEMP} + CASE WHEN age > 66 THEN 4.0 ELSE 0 END AS temp, {case([(c, n) for c, n, _ in _OCEAN], 'uncertain')} AS category FROM ({_PLACE}))", ["c_custkey"], [], _PR))
def prior_features(spark, sf_dir):
    df = _places(spark, sf_dir)
    zone, temp = rules.paleoclimate(F.col("lat"), F.col("age"))
    record = {"regional_age_max_ma": F.col("age"), "paleo_lat": F.col("lat"), "paleo_lon": F.col("lon"), "paleo_climate_zone": zone, "paleo_temp_proxy_c": temp, "paleo_ocean_proximity": rules.ocean_proximity(F.col("lat"), F.col("lon"), F.col("age"))[0], "mineral_site_count": F.col("c_custkey") % 90}
    return shaped(df.withColumns(rules.prior_features(record)), ["c_custkey"], [], _PR)


def _rocks(url, params, timeout):
    """A stand-in for the services, whose answers follow from the question: every place has six columns, each of them two units."""
    if url.endswith("columns"):
        first = int(abs(params["lat"]) + abs(params["lng"]))
        return {"success": {"data": [{"col_id": None if k == 1 else first + 100 * k, "col_name": f"column {k}"} for k in range(6)]}}
    if url.endswith("units"):
        c = params["col_id"]
        kinds = ("sedimentary", "igneous", "metamorphic")
        return {"success": {"data": [{"unit_id": 10 * c + k, "unit_name": f"unit {k}", "lith_class": kinds[(c + k) % 3], "t_age": c % 50 + k, "b_age": c % 50 + k + 10.0} for k in range(2)]}}
    raise ConnectionError(url)


@query(shape("""WITH p AS (SELECT c_custkey AS place, abs(c_custkey % 181 - 90) + abs(c_custkey % 359 - 179) AS f FROM customer),
 c AS (SELECT place, f + 100 * k AS col_id, k FROM p, (SELECT unnest([0, 2, 3, 4]) AS k)),
 u AS (SELECT place, col_id, k, 10 * col_id + j AS unit_id, ['sedimentary', 'igneous', 'metamorphic'][CAST((col_id + j) % 3 + 1 AS INT)] AS lith_class, col_id % 50 + j AS age_top FROM c, (SELECT unnest([0, 1]) AS j))
 SELECT place, lith_class, count(*) AS units, min(age_top) AS youngest, max(age_top) + 10 AS oldest FROM u GROUP BY 1, 2""", ["place", "lith_class"], ["units"], ["youngest", "oldest"]))
def formations_near(spark, sf_dir):
    """Units around every customer's place, asked twice: the second time of the cache alone (there is no network)."""
    from ..sources.endpoints import Services
    from ..sources.files import new_folder

    places, cache = _places(spark, sf_dir).select(F.col("c_custkey").alias("place"), "lat", "lon"), new_folder(spark, "services")
    Services(spark, cache, _rocks).formations_near(places).write.format("noop").mode("overwrite").save()
    units = Services(spark, cache, tries=1).formations_near(places)
    return shaped(units.groupBy("place", "lith_class").agg(F.count("*").alias("units"), F.min("age_top").alias("youngest"), F.max("age_bottom").alias("oldest")), ["place", "lith_class"], ["units"], ["youngest", "oldest"])
