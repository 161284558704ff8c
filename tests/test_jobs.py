"""The jobs over growing copies of their input."""

import datetime as dt
import json
import logging
import shutil

import pytest
from pyspark.sql import functions as F

from jobs import common, daily_quality, rock_context

DAY = dt.datetime(2024, 5, 1)
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event(i, day, hour, well, value):
    return i, DAY + dt.timedelta(days=day, hours=hour), well, "gr", value, "{}"


def rows(df, *keys):
    return {tuple(r[k] for k in keys): {c: r[c] for c in (*keys, *df.columns)} for r in df.collect()}


def put(spark, folder, name, events):
    spark.createDataFrame(events, EVENTS).coalesce(1).write.parquet(f"{folder}/{name}.tmp")
    (folder / "in").mkdir(exist_ok=True)
    shutil.move(next((folder / f"{name}.tmp").glob("part-*.parquet")), folder / "in" / f"{name}.parquet")


def test_daily_quality_takes_only_new_files(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "strataflow.jobs")
    paths = {"input": str(tmp_path / "in"), "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "mark")}
    put(spark, tmp_path, "a", [event(1, 0, 1, 7, 50.0), event(2, 0, 2, 7, 120.0), event(3, 0, 3, 7, None), event(4, 1, 1, 7, 80.0), event(5, 0, 1, 8, float("nan"))])
    first = rows(daily_quality.run(spark, **paths), "day", "well_id")
    one = first[dt.date(2024, 5, 1), 7]
    assert (one["n_rows"], one["gr_mean"], one["shale_share"], one["sand_share"], one["drift"]) == (3, 85.0, 0.5, 0.5, 70.0)
    assert first[dt.date(2024, 5, 1), 8]["missing_share"] == 1.0 and first[dt.date(2024, 5, 1), 8]["gr_mean"] is None
    untouched = {p.name for p in (tmp_path / "out/daily/day=2024-05-02").glob("part-*")}
    # late readings of an old day, and a new day
    put(spark, tmp_path, "b", [event(6, 0, 0, 7, 1000000.0), event(7, 2, 1, 9, 10.0)])
    caplog.clear()
    second = daily_quality.run(spark, **paths)
    assert "read 2 new rows" in caplog.text
    assert {p.name for p in (tmp_path / "out/daily/day=2024-05-02").glob("part-*")} == untouched
    got = rows(second, "day", "well_id")
    assert len(got) == 4 and got[dt.date(2024, 5, 1), 7]["drift"] == 120.0 - 1000000.0
    assert got[dt.date(2024, 5, 1), 7]["gr_std"] == pytest.approx(577301.2, rel=1e-6)
    # nothing new: nothing changes
    assert rows(daily_quality.run(spark, **paths), "day", "well_id") == got


def test_daily_quality_in_small_batches_equals_one(spark, tmp_path):
    for k in range(5):
        put(spark, tmp_path, f"f{k}", [event(10 * k + i, i % 3, k, i % 2, float(7 * i + k)) for i in range(6)])
    (tmp_path / "c.json").write_text(json.dumps({"files_a_batch": 1}))
    at = lambda n: {"input": str(tmp_path / "in"), "output": str(tmp_path / f"out{n}"), "checkpoint": str(tmp_path / f"mark{n}")}
    many, one = daily_quality.run(spark, **at(1), config=str(tmp_path / "c.json")), daily_quality.run(spark, **at(2))
    a, b = rows(many, "day", "well_id"), rows(one, "day", "well_id")
    assert a.keys() == b.keys() and len(spark.read.parquet(str(tmp_path / "out1/partials")).select("batch").distinct().collect()) == 5
    for k in a:
        assert [*a[k].values()][2:] == pytest.approx([*b[k].values()][2:], rel=1e-9) or a[k] == b[k]


def test_broken_batch_is_repeated(spark, tmp_path, monkeypatch):
    paths = {"input": str(tmp_path / "in"), "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "mark")}
    put(spark, tmp_path, "a", [event(1, 0, 1, 7, 50.0), event(2, 1, 2, 7, 70.0)])
    with monkeypatch.context() as m:
        m.setattr(daily_quality, "merged", lambda parts: 1 / 0)
        with pytest.raises(Exception, match="ZeroDivisionError"):
            daily_quality.run(spark, **paths)
    got = rows(daily_quality.run(spark, **paths), "day", "well_id")
    assert [r["n_rows"] for r in got.values()] == [1, 1]


def test_rock_context(spark, tmp_path):
    docs = [(1, "Red SANDSTONE of a river delta", "en", "a"), (2, "granite in the volcanic arc", "en", "a"), (3, None, None, None), (4, "Marine shale shelf", "en", "a"), (5, "", "fr", "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("place", F.lit(1))
    df.write.parquet(str(tmp_path / "docs"))
    again = [rows(rock_context.run(spark, str(tmp_path / "docs"), str(tmp_path / "out")), "lang", "source") for _ in range(2)]
    assert again[0] == again[1] and set(again[0]) == {("en", "a"), ("und", "none"), ("fr", "b")}
    one = again[0]["en", "a"]
    assert (one["n_docs"], one["environment"], one["provinces"]) == (3, "deltaic_plain", "passive_margin,unclassified,volcanic_arc")
    assert (one["lith_sedimentary"], one["lith_igneous"], one["lith_unknown"]) == pytest.approx((2 / 3, 1 / 3, 0))
    assert again[0]["und", "none"]["lith_unknown"] == 1.0
    spark.createDataFrame([(9, "basalt", "fr", "c")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "more"))
    assert set(rows(rock_context.run(spark, str(tmp_path / "more"), str(tmp_path / "out")), "lang", "source")) == {("en", "a"), ("und", "none"), ("fr", "c")}


def test_texts_are_lowered_once(spark):
    df = spark.createDataFrame([(1, "  Red SANDSTONE of a delta", "en", "a")], "doc_id long, text string, lang string, source string")
    out = rock_context.described(df, rock_context.DEFAULTS)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert (out.first()["lith_class"], out.first()["environment"], out.first()["province"]) == ("sedimentary", "deltaic_plain", "unclassified")


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"typo": 1}')
    with pytest.raises(ValueError, match="typo"):
        common.configured(spark, str(tmp_path / "c.json"), daily_quality.DEFAULTS)
