"""Operators without an SQL text against formulas, properties and edge cases."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataflow import cli, schema
from strataflow.operators import features as ft
from strataflow.operators import forecast as fc
from strataflow.operators import matching as mt
from strataflow.operators import models as ml
from strataflow.operators import relational as rel
from strataflow.operators import sequences as sq
from strataflow.operators import surface as sf
from strataflow.operators import windows as w
from strataflow.plans.views import view
from strataflow.sources import files, kv, services
from strataflow.streaming import continuation


def series(spark, wells, gap=lambda w, i, n: i > n * 0.7):
    rng, rows = np.random.default_rng(3), []
    for k, n in wells.items():
        gr = 60 + 30 * np.sin(np.arange(n) / 5 + k) + rng.normal(0, 3, n)
        for i in range(n):
            t = 100 + 0.5 * i + math.sin(i / 9)
            rows.append((k, i + 1, float(10 * i), float(3 * i + k), float(5 * k), -1000.0 - 0.3 * i, float(gr[i]) if i % 11 else None, None if gap(k, i, n) else t, t, "A" if i < n / 2 else "B"))
    return spark.createDataFrame(rows, "well_id long, row_seq long, md double, x double, y double, z double, gr double, tvt_input double, tvt double, formation string")


@pytest.fixture(scope="module")
def log(spark):
    return series(spark, {1: 60, 2: 45, 3: 11, 4: 10, 5: 9, 6: 2, 7: 1}).cache()


def slow_dtw(a, b):
    c = np.full((len(a) + 1, len(b) + 1), np.inf)
    c[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            c[i, j] = abs(a[i - 1] - b[j - 1]) + min(c[i - 1, j - 1], c[i - 1, j], c[i, j - 1])
    return c[-1, -1] / (len(a) + len(b))


def test_dtw():
    rng = np.random.default_rng(1)
    for _ in range(10):
        a, b = rng.random(rng.integers(1, 30)), rng.random(rng.integers(1, 30))
        d, path = mt.dtw(a, b)
        assert abs(d - slow_dtw(a, b)) < 1e-12 and tuple(path[0]) == (0, 0) and tuple(path[-1]) == (len(a) - 1, len(b) - 1)
        assert (np.diff(path, axis=0).min() >= 0 and np.diff(path, axis=0).max() <= 1) if len(path) > 1 else True
    assert mt.dtw(a, a)[0] == 0 and mt.dtw(a, b, 3)[0] >= mt.dtw(a, b)[0]


def test_kalman_and_autoregression_on_a_line():
    y = 5 + 0.5 * np.arange(60)
    y[40:] = np.nan
    for f in (fc.kalman, lambda v: fc.autoregression(v, np.zeros(60))):
        values, sigma = f(y.copy())
        assert np.abs(values[:40] - y[:40]).max() < 0.2 and abs(values[59] - (5 + 0.5 * 59)) < 3 and (sigma >= 0).all() and sigma[59] >= sigma[39]
    assert np.isnan(fc.kalman(np.full(4, np.nan))[0]).all()


def test_savgol_keeps_polynomials(spark):
    y = lambda x: 1 + x - 0.2 * x**2 + 0.01 * x**3
    rows = [(k, i, y(i)) for k, n in enumerate((30, 12, 11, 10, 7, 5, 4, 3, 2, 1)) for i in range(n)]
    df = spark.createDataFrame([(k, float(i), i, float(v)) for k, i, v in rows], "well_id int, md double, row_seq int, z double")
    got = ft.savgol(df, {"z": "q"}).orderBy("well_id", "row_seq").toPandas()
    for _, p in got.groupby("well_id"):
        x, n = p["row_seq"].to_numpy(float), len(p)
        assert np.allclose(p["q"], y(x))
        want = 1 - 0.4 * x + 0.03 * x**2 if n > 4 else np.gradient(y(x)) if n > 1 else [0.0]
        assert np.allclose(p["q_d1"], want)
    assert np.allclose(ft.stencil(30, 11, 2, True) @ (2 * np.arange(11.0)), 2)


def test_physics_family_gaps_and_short_series(spark):
    rows = [(1, 10.0 * i, i, float(i), 0.0, -float(i), None if 4 <= i <= 12 else float(i % 5), float(i) if i < 9 else None) for i in range(30)] + [(2, 1.0, 1, 1.0, 1.0, 1.0, 1.0, 1.0), (2, 2.0, 2, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "well_id int, md double, row_seq int, x double, y double, z double, gr double, tvt_input double")
    got = ft.physics_features(df, smooth=True).orderBy("well_id", "row_seq").toPandas()
    assert set(ft.PHYSICS) <= set(got.columns) and not [c for c in got.columns if c.startswith("__")]
    long, short = got[got.well_id == 1], got[got.well_id == 2]
    assert short[list(ft.PHYSICS)].isna().all().all() and not long[list(ft.PHYSICS)].isna().any().any()
    g = long.gr.interpolate(limit=5).fillna(0).to_numpy()
    assert np.allclose(long.dgr_dmd, np.diff(g, prepend=g[0]) / 10)
    t = long.tvt_input.interpolate(limit=3)
    assert np.allclose(long.dtvt_dmd, (t.diff().where(t.notna()).fillna(0)) / 10)
    complete = t.rolling(11, center=True).count() == 11
    assert (long.dtvt_smooth[5:-5][~complete[5:-5]] == 0).all() and (long.geo_state_change[t.isna()] == 0).all()
    assert long.tvt_input.isna().sum() == 21


def test_welch_finds_the_period():
    p = ft.welch(np.sin(2 * np.pi * np.arange(128) / 8))
    assert p.argmax() == 4 and p.min() >= 0


def test_gap_fill_equals_interpolate(spark, log):
    got = w.gap_fill_linear(log.withColumn("g", F.when((F.col("row_seq") % 9 > 1), F.col("gr"))), "g", 3, "f").orderBy("well_id", "row_seq").toPandas()
    for _, p in got.groupby("well_id"):
        want = p["g"].interpolate(limit=3).to_numpy()
        assert np.allclose(p["f"].to_numpy(float), want, equal_nan=True)


def test_rolling_equals_pandas(log):
    got = w.rolling(log, "z", ("mean", "std", "range"), (5,), "r").orderBy("well_id", "row_seq").toPandas()
    for _, p in got.groupby("well_id"):
        r = p["z"].rolling(5, min_periods=1)
        assert np.allclose(p["r_mean_5"], r.mean()) and np.allclose(p["r_std_5"], r.std().fillna(0)) and np.allclose(p["r_range_5"], r.max() - r.min())


def test_features_of_a_series_stand_alone(spark, log):
    one = log.filter("well_id = 2")
    for build in (ft.sequence_features, ft.physics_features, ft.baseline_features):
        a, b = build(one).orderBy("row_seq").toPandas(), build(log).filter("well_id = 2").orderBy("row_seq").toPandas()
        pd.testing.assert_frame_equal(a, b[a.columns], check_exact=False)


def test_sequence_family_and_targets(log):
    df = ft.sequence_features(log)
    assert len(df.columns) - len(log.columns) >= 98
    assert df.filter("tvt_input is null").count() == log.filter("tvt_input is null").count()
    assert len(schema.feature_groups(df)) == 9 and all(schema.feature_groups(df).values()) and "gr" in schema.numeric_columns(df) and schema.aligned(df, ["gr", "absent"]).columns == ["gr", "absent"]


def test_nearest_by_cells_equals_broadcast(spark):
    rng = np.random.default_rng(2)
    make = lambda n, k: spark.createDataFrame([(i, float(a), float(b), float(a * b)) for i, (a, b) in enumerate(rng.random((n, 2)) * 100)], f"{k} long, x double, y double, z double")
    q, p = make(20, "q"), make(200, "p")
    near = lambda df: sorted((r.q, r.p_p) for r in df.collect())
    assert near(rel.nearest(q, p, 5, "q", "p")) == near(rel.nearest_by_cells(q, p, 5, "q", "p", "x", "y", 8))


def test_interpolation_holds_ends(spark):
    df = spark.createDataFrame([(1, float(x)) for x in (-1, 0, 5, 10, 12)], "w long, x double")
    t = spark.createDataFrame([(1, 0.0, 1.0), (1, 10.0, 3.0)], "w long, tx double, ty double")
    assert [r.v for r in rel.interpolated(df, t, "w", "x", "tx", "ty", "v").orderBy("x").collect()] == [1, 1, 2, 3, 3]


def test_splits_are_apart(log):
    train, val = rel.split_wells(log, 0.3)
    a, b = ({r[0] for r in d.select("well_id").distinct().collect()} for d in (train, val))
    assert not a & b and len(a | b) == 7 and len(b) == 2


def test_thin_plate_surface(spark):
    rows = [("A", float(x), float(y), 2 * x - y + 3.0, 0.0) for x in range(5) for y in range(5)] + [("B", 1.0, 1.0, 7.0, 9.0)]
    tops = spark.createDataFrame(rows, "formation string, x double, y double, depth double, base_depth double")
    got = {r.formation: r.surface for r in sf.evaluated(spark.createDataFrame([(2.5, 1.5)], "x double, y double"), sf.fitted(tops)).collect()}
    assert abs(got["A"] - 6.5) < 1e-6 and got["B"] == 7
    wide = sf.formation_features(spark.createDataFrame([(1, 1.0, 2.0, 0.5)], "k long, x double, y double, z double"), tops, ["k"], ["A", "B"])
    assert wide.columns == ["k", *(f"{c}_{f}" for f in "ab" for c in ("pred_top", "dist_to", "thick", "dip_corr"))] and wide.first().dist_to_b == 6.5


def test_physics_recurrence(log):
    got = fc.physics(log.filter("well_id = 1")).orderBy("row_seq").toPandas()
    known = log.filter("well_id = 1").orderBy("row_seq").toPandas()["tvt_input"]
    assert np.allclose(got["physics_tvt"][known.notna()], known.dropna()) and got["physics_tvt"].notna().all()
    steps = np.diff(got["physics_tvt"])[known.isna()[1:]]
    assert np.abs(steps).max() <= fc.CLIP + 1e-9 and (np.diff(got["physics_confidence"][known.isna()]) < 0).all()


def test_hybrid_and_ensemble(log):
    assert fc.hybrid(log, trees=2).count() == log.count()
    out = fc.continued(log, fc.transferred(log, fc.similar_wells(log))).toPandas()
    assert len(out) == log.count() and out["TVT_uncertainty"].dropna().ge(0).all()


def test_hybrid_is_saved_and_loaded(spark, log, tmp_path):
    model = fc.HybridEstimator(least=5, trees=3).fit(log)
    model.save(spark, str(tmp_path / "hybrid"))
    again = fc.HybridModel.load(spark, str(tmp_path / "hybrid"))
    order = lambda df: sorted(map(tuple, df.collect()))
    assert model.learner is not None and again.n == model.n and order(again.predict(log)) == order(model.predict(log)) == order(fc.hybrid(log, least=5, trees=3))
    none = fc.HybridEstimator(least=10**6).fit(log)
    none.save(spark, str(tmp_path / "none"))
    assert fc.HybridModel.load(spark, str(tmp_path / "none")).learner is None


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_similar_wells_over_ranges(spark, monkeypatch, ranges):
    monkeypatch.setattr(fc, "RANGES", ranges)
    rng = np.random.default_rng(8)
    means = np.concatenate([rng.normal(size=40), np.full(10, 0.25), rng.normal(size=10) * 100])
    df = spark.createDataFrame([(i, float(m)) for i, m in enumerate(means)], "well_id long, gr double")
    got = {(r["well_id"], r["other"]): r["score"] for r in fc.similar_wells(df, 3).collect()}
    order = sorted(range(60), key=lambda i: (means[i], i))
    want = {(i, order[k + o]): 1 / (1 + abs(means[i] - means[order[k + o]])) for k, i in enumerate(order) for o in (-3, -2, -1, 1, 2, 3) if 0 <= k + o < 60}
    assert got == pytest.approx(want)


def test_means_that_differ_by_rounding_are_summed_in_row_order(spark, tmp_path):
    """F8: series of the same values in other orders, dealt to many files: means, and so neighbours, are those of sums in row order."""
    rng = np.random.default_rng(4)
    values = rng.integers(0, 50_000, 60) / 100
    events = [(19 * (100 * w + k) + 1, w, float(v), "a") for w in range(1, 60) if w % 5 for k, v in enumerate(rng.permutation(values))]
    events = [events[i] for i in rng.permutation(len(events))]
    spark.createDataFrame(events, "event_id long, user_id long, value double, event_type string").repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    means: dict[int, float] = {}
    for w in {w for _, w, _, _ in events}:
        total, own = 0.0, [v for _, x, v, _ in sorted(events) if x == w]
        for v in own:
            total += v
        means[w] = total / len(own)
    assert 1 < len(set(means.values())) and max(means.values()) - min(means.values()) < 1e-11
    order = sorted(means, key=lambda w: (means[w], w))
    want = {(w, order[k + o]) for k, w in enumerate(order) for o in (-2, -1, 1, 2) if 0 <= k + o < len(order)}
    assert {(r["well_id"], r["other"]) for r in fc.similar_wells(view(spark, str(tmp_path), "well_log"), 2).collect()} == want


def test_topk_summary_is_padded(spark):
    df = spark.sql("SELECT array(named_struct('score', -1.0D, 'i', 3, 'value', 7.0D)) AS a UNION ALL SELECT cast(array() AS array<struct<score: double, i: int, value: double>>)")
    rows = df.select(*(c.alias(n) for n, c in mt.topk_summary(F.col("a"), 3, 2).items())).collect()
    assert [r.asDict() for r in rows if r.best_value] == [{"best_value": 7.0, "best_score": -1.0, "second_value": 7.0, "weighted_value": pytest.approx(7.0), "spread": 0.0, "confidence": 0.0}]
    assert [r for r in rows if r.best_value is None][0].asDict() == dict.fromkeys(("best_value", "best_score", "second_value", "weighted_value", "spread", "confidence"))


def test_window_match_finds_itself(log):
    one = log.filter("well_id = 1")
    got = mt.window_matches(one, one, width=12, stride=4, reference_stride=1).toPandas()
    assert got["tw_best_score"][3:9].min() > 0.98


def test_clusters(log):
    wells = ft.well_fingerprint(log)
    names = ["gr_mean", "gr_std", "z_range", "md_total"]
    out = ml.WellClusterer(0).fit(wells, names).assign(wells).toPandas()
    assert len(out) == 7 and (out["cluster_dist"] >= 0).all()
    assert ml.WellClusterer(2, hierarchical=True).fit(wells, names).assign(wells).count() == 7


def test_kv(spark):
    cache = spark.createDataFrame([("a", "s", "{}", "1"), ("b", "t", "{}", "2")], "key string, source string, params string, data string").withColumn("fetched_at", F.lit("2024-01-10").cast("timestamp"))
    new = spark.createDataFrame([("a", "s", "{}", "9"), ("c", "s", "{}", "3")], "key string, source string, params string, data string").withColumn("fetched_at", F.lit("2024-02-20").cast("timestamp"))
    both = kv.upserted(cache, new)
    assert {r.key: r.data for r in both.collect()} == {"a": "9", "b": "2", "c": "3"}
    found = kv.lookup(spark.createDataFrame([("a",), ("b",), ("x",)], "key string"), both, F.lit("2024-02-25").cast("timestamp"))
    assert {r.key: r.data for r in found.collect()} == {"a": "9", "b": None, "x": None}
    assert kv.cleared(both, "s").count() == 1 and kv.cleared(both).count() == 0 and kv.empty(spark).count() == 0


def test_services(spark):
    tries = []

    def flaky(url, params, timeout):
        tries.append(params)
        if len(tries) < 3:
            raise OSError
        return {"ok": 1}

    assert services.fetch(flaky, "u", {}, wait=lambda s: None) == json.dumps({"ok": 1}) and len(tries) == 3
    assert services.fetch(services.no_network, "u", {}, wait=lambda s: None) is None
    now, asked = F.lit("2024-01-02").cast("timestamp"), spark.createDataFrame([('{"a": 1}',), ('{"a": 2}',)], "params string")
    cached = asked.limit(1).select(services.kv.hash_key(F.lit("src"), F.col("params")).alias("key"), F.lit("src").alias("source"), "params", F.lit('[{"unit_id": 5, "lith_class": "sedimentary"}]').alias("data"), now.alias("fetched_at"))
    out, new = services.answers(asked, cached, "src", "u", now, lambda u, p, t: {"unit_id": p["a"]})
    units = services.records(out.select("params", "data"), services.UNIT)
    assert sorted(r.unit_id for r in units.collect()) == [2, 5] and new.count() == 1
    lost, none = services.answers(asked, kv.empty(spark), "src", "u", now, tries=1)
    assert all(r.data is None for r in lost.collect()) and none.count() == 0
    p = services.reconstructed(spark.createDataFrame([('{"coordinates": [10.5, -3]}',), ("{}",), (None,)], "data string")).collect()
    assert [(r.paleo_lon, r.paleo_lat) for r in p] == [(10.5, -3.0), (None, None), (None, None)]


def test_files_and_commands(spark, log, tmp_path, capsys):
    for k in (1, 2):
        log.filter(f"well_id = {k}").drop("well_id", "row_seq", "formation").orderBy("md").toPandas().rename(columns=str.upper).to_csv(tmp_path / f"W{k}__horizontal_well.csv", index=False)
    (tmp_path / "other.csv").write_text("MD\n1\n")
    df = files.read_folder(spark, str(tmp_path))
    assert {(r[0], r[1]) for r in df.groupBy("well_id").count().collect()} == {("W1__horizontal_well", 60), ("W2__horizontal_well", 45)}
    log.write.parquet(str(tmp_path / "log.parquet"))
    run = lambda *a: (cli.main(list(a)), json.loads(capsys.readouterr().out.strip().splitlines()[-1]))[1]
    got = run("train", "--data", str(tmp_path / "log.parquet"), "--trees", "2", "--depth", "2", "--model", str(tmp_path / "model"))
    assert got["mae"] >= 0
    run("predict", "--data", str(tmp_path / "log.parquet"), "--model", str(tmp_path / "model"), "--output", str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == log.count()
    assert run("ontology", "--desc", "Marine Shale", "")[0]["lith_class"] == "sedimentary"
    assert run("anomaly", "--gr", "120", "--tvt-delta", "9", "--sedimentary", "0.1", "--history", "0", "0.1", "0.2")["is_anomaly"] is True
    assert run("scrape", "--lat", "5", "--lon", "10", "--age", "80")["paleo_climate_zone"] == "tropical"
    files.write_priors(spark, {"a": 1.5}, str(tmp_path / "p"))
    assert files.read_priors(spark, str(tmp_path / "p")) == {"a": 1.5}


def test_staged_and_anonymous_commands(spark, log, tmp_path, capsys):
    data = str(tmp_path / "log.parquet")
    log.write.parquet(data)
    run = lambda *a: (cli.main([*a, "--data", data, "--trees", "2", "--depth", "2"]), json.loads(capsys.readouterr().out.strip().splitlines()[-1]))[1]
    got = run("pipeline", "--phase", "4")
    assert [name for name, _, _ in got["log"]] == ["baseline", "physics", "sedimentary", "hybrid"]
    best = got["log"][0][1]
    for _, mae, stays in got["log"][1:]:
        assert stays == (best - mae > ml.GATE)
        best = mae if stays else best
    got = run("run", "--lat", "5", "--lon", "10", "--age", "80", "--output", str(tmp_path / "priors"))
    assert got["n_priors"] == 14 and files.read_priors(spark, str(tmp_path / "priors"))["paleo_lat_norm"] == pytest.approx(5 / 90)
    got = run("anonymous", "--output", str(tmp_path / "report"))
    assert len(got["report"]) == 4 and got["report"][-1].startswith("best: ") and spark.read.csv(str(tmp_path / "report"), header=True).count() == 3


def test_report_of_no_steps(spark):
    none = spark.createDataFrame([], "name string, step int, mae double, rmse double, lift double, n_features int")
    assert ml.best(none).count() == 0 and ml.report(none).count() == 0


def test_sequences(spark, log):
    got = sq.windows(log, ["gr", "z"], 8, 4).first()
    assert len(got.inputs) == 8 and len(got.inputs[0]) == 2
    ref = sq.encoded_reference(log.filter("well_id = 1"), 50).first()
    assert len(ref.gr) == len(ref.mask) == 50 and set(ref.formation) == {0.0, 0.5}
    assert sq.contrastive_pairs(log, 1.0, 5).count() > 0
    e = sq.summary_embeddings(ft.well_fingerprint(log), "well_id", ["gr_mean", "z_range", "md_total"], 2).first()
    assert abs(sum(v * v for v in e.embedding) - 1) < 1e-5


def test_stream(spark, log, tmp_path):
    log.select("well_id", "row_seq", "tvt_input").repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("well_id long, row_seq long, tvt_input double").parquet(str(tmp_path / "in"))
    q = continuation.continued(stream).writeStream.format("memory").queryName("carried").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("carried")
    assert got.count() == log.count() and got.filter("well_id = 1 and tvt_filled is null").count() == 0


def test_plane_equals_least_squares(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(x), float(2 * x if g == 2 else y), float(z)) for g in (1, 2) for x, y, z in rng.random((12, 3))] + [(3, 0.0, 0.0, 1.0), (3, 1.0, 0.0, 2.0)]
    got = {r.g: (r.a, r.b) for r in rel.plane(spark.createDataFrame(rows, "g int, x double, y double, z double"), "g", "x", "y", "z").collect()}
    for g in (1, 2):
        p = np.array([r[1:] for r in rows if r[0] == g])
        p = p - p.mean(0)
        assert np.allclose(got[g], np.linalg.lstsq(p[:, :2], p[:, 2], rcond=None)[0])
    assert got[3] == (0.0, 0.0)


def test_ontology_cache_mapper_and_rules(spark):
    from strataflow.functions import ontology

    df = spark.createDataFrame([("Shale ",), ("shale",), ("granite",), (None,)], "d string")
    now = F.lit("2024-01-02").cast("timestamp")
    out, new = ontology.mapped(df, "d", kv.empty(spark), now)
    assert sorted(str(r.lith_class) for r in out.collect()) == ["igneous", "sedimentary", "sedimentary", "unknown"] and new.count() == 3

    def mapper(t):
        if t == "granite":
            raise ValueError
        return json.dumps({"lith_class": "mine", "lith_type": "x", "environment": "y", "confidence": 0.9}) if t else None

    assert sorted(r.lith_class for r in ontology.mapped(df, "d", kv.empty(spark), now, mapper)[0].collect()) == ["igneous", "mine", "mine", "unknown"]
    assert ontology.mapped(df, "d", new, now, mapper)[1].count() == 0


def test_physics_needs_two_known_values(spark):
    rows = [(1, i, float(10 * i), 0.0, 0.0, -float(i), 50.0, 5.0 if i == 1 else None) for i in range(1, 5)] + [(2, i, float(10 * i), 0.0, 0.0, -float(i), 50.0, None) for i in range(1, 3)]
    got = fc.physics(spark.createDataFrame(rows, "well_id long, row_seq long, md double, x double, y double, z double, gr double, tvt_input double")).collect()
    assert {(r.well_id, r.physics_tvt) for r in got} == {(1, 5.0), (2, 0.0)}


def test_fingerprint_codes(spark):
    one = series(spark, {1: 120, 2: 9})
    got = ft.fingerprint(one).toPandas()
    assert len(got) == 129 and set(got["depo_environment_enc"]) <= {0.0, 1.0, 2.0, 3.0, 4.0} and (got[got.well_id == 2]["depo_marine_score"] == 0).all()


def test_typewell_without_readings(spark):
    from strataflow.operators import relational

    rows = spark.createDataFrame([(w, float(k), k, None) for w in (2, 1) for k in range(4)], "well_id long, md double, row_seq long, gr double")
    assert sorted((r.well_id, r.row_seq) for r in relational.typewell(rows, rows=6).collect()) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]
    some = rows.withColumn("gr", F.when(F.col("well_id") == 2, F.col("md")))
    assert {r.well_id for r in relational.typewell(some, rows=6).collect()} == {2}
