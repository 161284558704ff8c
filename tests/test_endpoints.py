"""Services asked through a transport of the tests, cache first."""

import pytest
from pyspark.sql import functions as F

from strataflow.sources import endpoints as ep
from strataflow.sources import kv


@pytest.fixture
def asked(tmp_path):
    """A transport that notes each question in a file, and its notes."""
    folder = tmp_path / "asked"
    folder.mkdir()
    at = str(folder)

    def transport(url, params, timeout):
        import json
        import os
        import uuid

        with open(os.path.join(at, uuid.uuid4().hex), "w") as f:
            f.write(json.dumps([url.rsplit("/", 1)[-1], params]))
        name = url.rsplit("/", 1)[-1]
        if name == "columns":
            return {"success": {"data": [{"col_id": k if k != 1 else None, "col_name": None} for k in range(7)]}} if params["lat"] < 80 else {"error": "nowhere"}
        if name == "units":
            return {"success": {"data": [{"unit_id": params["col_id"] * 10, "lith_class": "igneous" if params["col_id"] else None, "t_age": 1.0, "b_age": 5.0 + params["col_id"]}]}}
        if name == "lithologies":
            return {"success": {"data": [{"lith_id": 1, "name": "shale", "type": "siliciclastic", "class": "sedimentary"}]}}
        if name == "sgmc":
            return {"geounit": {"unitname": "Dakota", "age": "Cretaceous", "description": "a foreland basin"}}
        if params["lat"] < 20:
            return {"results": {"result": [{"dep_name": "mine", "commod1": "Au", "latitude": 1.5, "longitude": 2.5}, {"dep_name": "pit"}]}}
        raise OSError("down")

    return transport, lambda: len(list(folder.iterdir()))


def test_cache_first(spark, tmp_path, asked):
    transport, notes = asked
    places = spark.createDataFrame([(1, 10.0, 20.0, 100.0), (2, 10.0, 20.0, 50.0), (3, 85.0, 0.0, 10.0)], "place long, lat double, lon double, age_ma double")
    cache = str(tmp_path / "cache")
    services = ep.Services(spark, cache, transport, tries=1)
    got = {(r["place"], r["col_id"], r["unit_id"], r["lith_class"]) for r in services.formations_near(places).collect()}
    assert got == {(p, c, c * 10, "igneous" if c else "") for p in (1, 2) for c in (0, 2, 3, 4)}
    assert notes() == 2 + 4  # two distinct places, four columns
    assert {(r["place"], r["col_id"]) for r in ep.Services(spark, cache, tries=1).formations_near(places).collect()} == {(p, c) for p in (1, 2) for c in (0, 2, 3, 4)}
    assert services.lithologies().first()["name"] == "shale" and notes() == 7
    # a failed question isn't kept, it is asked again
    assert services.minerals_near(places).count() == 4 and services.minerals_near(places).count() == 4
    assert notes() == 7 + 2 + 1
    records = {r["place"]: r for r in services.location_records(places).collect()}
    assert records[1]["tectonic_province"] == "foreland_basin" and records[1]["mineral_site_count"] == 2 and records[3]["mineral_site_count"] == 0
    assert (records[1]["lith_igneous"], records[1]["lith_unknown"], records[1]["regional_age_max_ma"]) == (0.75, 0.25, 9.0)
    assert records[3]["lith_igneous"] is None and records[1]["paleo_climate_zone"] is not None
    assert {r["source"] for r in spark.read.schema(kv.SCHEMA).parquet(cache).select("source").distinct().collect()} == {"macrostrat_columns", "macrostrat_units", "macrostrat_liths", "usgs_geounit", "usgs_mrds"}


def test_stale_answers_are_asked_again(spark, tmp_path, asked):
    transport, notes = asked
    places, cache = spark.createDataFrame([(1, 10.0, 20.0)], "place long, lat double, lon double"), str(tmp_path / "cache")
    at = lambda day: F.lit(day).cast("timestamp")
    for day, n in (("2024-01-01", 1), ("2024-01-20", 1), ("2024-03-01", 2), ("2024-03-02", 2)):
        assert ep.Services(spark, cache, transport, now=at(day)).geologic_units(places).first()["unit_name"] == "Dakota"
        assert notes() == n
