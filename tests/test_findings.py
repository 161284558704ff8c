"""Faults found on larger or odd tables, made small."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strataflow.operators import clusters as cl
from strataflow.operators import features as ft
from strataflow.operators import forecast as fc
from strataflow.operators import frames
from strataflow.operators import grouped as gr
from strataflow.operators import matching as mt
from strataflow.operators import predictor as pf
from strataflow.operators import streams
from strataflow.operators import surface as sf
from strataflow.operators import windows as w
from strataflow.plans import pipelines
from strataflow.queries import models


def series(spark, wells=40, rows=30, seed=3):
    r = np.random.default_rng(seed)
    cells = [(w, i, float(10 * i), float(3 * i + r.integers(7)), float(5 * w + r.integers(11)), float(-1000 - r.integers(23)), float(r.random() * 150), 100 + i / 2, 100 + i / 2 if i < 20 else None) for w in range(wells) for i in range(1, rows + 1)]
    return spark.createDataFrame(cells, "well_id long, row_seq long, md double, x double, y double, z double, gr double, tvt double, tvt_input double")


def test_clusters_of_series_are_read_from_their_summaries(spark):
    df = series(spark)
    lost = df.filter("well_id = 0").withColumn("well_id", F.lit(None).cast("long"))  # rows without a series take part in none
    out = pf.PredictorFamily(3).fit(df.unionByName(lost)).transform(df.unionByName(lost))
    assert out.count() == 41 * 30
    found = {r[0]: r[1] for r in out.select("well_id", "well_cluster_id").distinct().collect()}
    assert found[None] == 0 and len(found) == 41
    plan = pf.PredictorFamily(3)._wells(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_trees_by_bits_and_smaller_children():
    r = np.random.default_rng(1)
    x = r.integers(0, gr.BINS, (2000, 5)).astype(np.uint8)
    y, held = np.round(x[:, 0] / 2 + r.normal(size=2000) * 3, 1), r.random(2000) < 0.2
    for loss in ("absolute", "squared"):
        model = gr.boosted(x, y, held, 12, 0.1, 6, loss)
        total = np.zeros(len(x))
        for f, c, v in zip(model["feature"], model["cut"], model["value"]):  # node by node
            for i, row in enumerate(x):
                at = 0
                for level in range(6):
                    k = (1 << level) - 1 + at
                    at = 2 * at + int(row[f[k]] > c[k])
                total[i] += v[at]
        assert np.array_equal(gr.guessed(model, x), model["base"] + total)
    target = np.sign(r.normal(size=2000))
    for a, b in zip(gr.tree(x, target, 6, gr.BINS), gr.tree(x, target, 6, gr.BINS, signs=True)):
        assert np.array_equal(a, b)


def test_no_fallback_is_trained_where_none_is_wanted(spark):
    rows = spark.range(300).select((F.col("id") % 17).cast("double").alias("f"), F.col("id").cast("double").alias("tvt"), F.lit(0).alias("cluster_id"))
    models = gr.trained(rows, ["f"], "tvt", preset=(3, 0.1, 2, "absolute"), fallback=False).collect()
    both = {r["cluster"]: r["model"] for r in gr.trained(rows, ["f"], "tvt", preset=(3, 0.1, 2, "absolute")).collect()}
    assert [(m["cluster"], m["model"]) for m in models] == [(0, both[0])] and set(both) == {0, gr.FALLBACK}


def test_ward_merges_equal_points_at_once(spark):
    places = [[float(k % 3), float(k % 2)] for k in range(400)]  # six places: round by round it would take 66 rounds
    df = spark.createDataFrame(list(enumerate(places)), "k long, v array<double>")
    got = cl.ward(df, "k", "v", finish=4).collect()
    flat = [r for r in got if r["height"] == 0]
    assert len(got) == 399 and len(flat) == 394 and {r["round"] for r in flat} == {0}
    assert all(r["left"] == r["right"] % 6 and r["size"] == r["right"] // 6 + 1 for r in flat)
    assert max(r["round"] for r in got) < 10 and max(r["size"] for r in got) == 400


def test_quartile_tells_values_a_bit_apart(spark):
    low = 6.319
    high = float(np.nextafter(low, 7))
    cells = [(0, float(i), i, v) for i, v in enumerate([1.0] * 53 + [low, high] + [9.0] * 17)]  # the quartile is 53.25 places on
    cells += [(1, float(i), i, v) for i, v in enumerate([4.0, 1.0, None, 2.0, 3.0, 5.0])]
    df = spark.createDataFrame(cells, "well_id long, md double, row_seq long, v double")
    got = {r[0]: r[1] for r in ft.upper_quartile(df, "v", "q").select("well_id", "q").distinct().collect()}
    assert got == {0: low, 1: 4.0}
    assert df.filter("well_id = 0").agg(F.percentile("v", F.lit(0.75))).first()[0] == high  # as it was taken before


def test_nearest_clusters_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(cl.nb, "BLOCK", 16)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # partitions stay apart, as they do with many rows
    try:
        df = spark.range(100).select("id", F.lit(1).cast("long").alias("n"), F.array((F.col("id") * F.col("id")).cast("double")).alias("c"))
        got = {r["id"]: r["to"] for r in cl.nearest_clusters(df, df, "bigint").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert got == {0: 1, **{k: k - 1 for k in range(1, 100)}}


def test_series_warped_together_as_one_by_one():
    r = np.random.default_rng(5)
    a, b = np.round(r.random((30, 25)), 1), np.round(r.random(25), 1)  # many ties
    for band in (None, 4):
        distances, last = mt.warped(a, b, band)
        for x, d, to in zip(a, distances, last):
            want, path = mt.dtw(x, b, band)
            assert d == want and list(to) == list({i: j for i, j in path}.values())


def test_whole_series_of_cut_batches():
    wells = [None] * 3 + [1] * 7 + [2] * 40 + [3] + [4] * 5
    table = pa.table({"w": pa.array(wells, pa.int64()), "v": range(len(wells))})
    got = list(streams.whole_series(iter(table.to_batches(max_chunksize=4)), 8))
    assert pa.concat_tables(t for t, _ in got).equals(table)
    seen = [w for t, bounds in got for a, b in zip(bounds[:-1], bounds[1:]) for w in set(t["w"].to_pylist()[a:b])]
    assert seen == [None, 1, 2, 3, 4]


def test_splines_far_from_the_origin():
    """Coordinates of millions leave small smoothing its effect, and equal values are a constant."""
    r = np.random.default_rng(7)
    x, y = r.random(400) * 3000, r.random(400) * 3000
    z = np.sin(x / 500) + r.random(400)
    one = lambda shift, z: sf._spline("a", 0, [-np.inf, np.inf, -np.inf, np.inf, 1.0, 1.0], x + shift, y + shift, z, 1.0).iloc[0].to_dict()
    at = r.random(50) * 3000
    near, far = sf.blended(at, at, [one(0.0, z)]), sf.blended(at + 4e6, at + 4e6, [one(4e6, z)])
    assert np.abs(near - far).max() < 1e-6
    made = one(0.0, z)
    fit = sf.blended(x, y, [made])
    w = np.asarray(made["ws"]) / made["unit"] ** 2
    assert np.abs(fit + w - z).max() < 1e-6  # what smoothing leaves at each point is its weight
    flat = one(0.0, np.full(400, 2.5))
    assert flat["kind"] == "constant" and np.array_equal(sf.blended(at, at, [flat]), np.full(50, 2.5))


def test_surfaces_are_solved_once(spark):
    df = spark.createDataFrame([("A b", float(i % 7), float(i % 5), float(i), float(i + 2)) for i in range(30)], "formation string, x double, y double, depth double, base_depth double")
    model = sf.fitted(df)
    assert "FlatMapGroupsInPandas" not in model._jdf.queryExecution().executedPlan().toString()
    points = spark.createDataFrame([(1, 2.0, 3.0, 1.0), (2, None, 3.0, 1.0)], "id long, x double, y double, z double")
    got = {r["id"]: r for r in sf.formation_features(points, df, ["id"], ["A b"]).collect()}
    assert abs(got[1]["thick_a_b"] - 2) < 1e-9 and abs(got[1]["dist_to_a_b"] - got[1]["pred_top_a_b"] + 1) < 1e-9
    assert got[2]["pred_top_a_b"] is None and got[1]["dip_corr_a_b"] is not None


def test_staged_features_are_joined_before_they_are_wide(spark):
    df = series(spark, 8, 24)
    out, base, groups = pipelines.staged_features(df)
    assert list(groups) == ["physics", "sedimentary", "hybrid"] and not set(base) & {c for g in groups.values() for c in g}
    seq = ft.sequence_features(df)
    assert set(base) == set(seq.columns) - {"well_id", "row_seq", "tvt", "tvt_input"}
    widest = [len(x.output().mkString(",").split(",")) for x in _nodes(out._jdf.queryExecution().executedPlan()) if x.nodeName() == "Exchange"]
    assert max(widest) < 70  # 98 columns of the sequence family are never dealt anew
    assert seq.exceptAll(out.select(*seq.columns)).isEmpty()


def _nodes(plan):
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    yield plan
    kids = plan.children()
    for k in range(kids.size()):
        yield from _nodes(kids.apply(k))


def test_best_scores_of_many(spark):
    """The best of each row are told from the maxima of parts: equal to a sort, ties and a row's own key included."""
    r = np.random.default_rng(0)
    for measure in ("cosine", "euclidean"):
        x, y = np.round(r.normal(size=(300, 4)), 1), np.round(r.normal(size=(900, 4)), 1)
        y[:40] = y[0]
        qx, qy = np.arange(300), r.permutation(900)
        s = x @ y.T if measure == "cosine" else -((x[:, None] - y) ** 2).sum(2)
        for i, at, score in cl.nb.best_of(x, y, qx, qy, 5, measure):
            want = sorted((-round(v, 9), q, j) for j, (q, v) in enumerate(zip(qy, s[i])) if q != qx[i])[:5]
            assert list(at) == [j for *_, j in want] and np.allclose(score, s[i, at])


def test_blocks_are_dealt_seldom(spark):
    """A row travels once for each block of the other side: blocks hold as many rows as a task takes easily."""
    assert cl.nb.BLOCK >= 16_384


def test_residuals_are_made_once(spark, monkeypatch):
    made = []
    kept = fc.kept_table
    monkeypatch.setattr(fc, "kept_table", lambda df, name: made.append(name) or kept(df, name))
    fc.HybridEstimator(trees=1).fit(series(spark, 6, 30))
    assert made == ["residuals"]


def test_matches_of_a_series_hang_on_itself(spark):
    """Read with other series in one stream, a series has the very matches that it has alone; NULLs and short series included."""
    df = series(spark, 12, 60).withColumn("gr", F.when(F.col("row_seq") % 7 > 0, F.round("gr", 0))).filter("well_id > 1 or row_seq < 5")
    ref = df.filter("well_id = 5")
    found = mt.window_matches(df, ref)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    both = {(r["well_id"], r["i"]): r for r in found.collect()}
    for well in (0, 7):
        alone = mt.window_matches(df.filter(F.col("well_id") == well), ref).collect()
        assert alone and all(both[r["well_id"], r["i"]] == r for r in alone)
    assert len(both) == 10 * 6 + 2


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_exact_medians_of_brackets(spark):
    r = np.random.default_rng(5)
    cells = [(float(r.normal()), float(i % 3), None if i % 7 else float(i), None) for i in range(4000)]
    df = spark.createDataFrame(cells, "a double, b double, c double, d double")
    for accuracy in (4, 10_000):  # the coarse one brackets everything
        got = pf.exact_medians(df, ["a", "b", "c", "d"], accuracy=accuracy)
        columns = [[v for v in c if v is not None] for c in zip(*cells)]
        assert got == {n: float(np.median(c)) for n, c in zip("abc", columns)}
    family = pf.PredictorFamily(exact=True)
    assert "Join" not in plan_of(family._joined(series(spark), None))  # rows are made once for themselves and their summary


def test_continuation_of_many_series_at_once(spark):
    r = np.random.default_rng(6)
    many = [np.where(r.random(n) < 0.6, 100 + np.arange(n) / 2 + r.normal(size=n), np.nan) for n in (1, 2, 3, 9, 40, 64, 65, 200)] + [np.full(5, np.nan)]
    length = np.array([len(y) for y in many])
    wide = np.full((len(many), length.max()), np.nan)
    for row, y in zip(wide, many):
        row[-len(y) :] = y
    for k, (value, sigma) in enumerate(zip(*fc.kalman_all(wide, length))):
        alone = fc.kalman(many[k])
        assert np.allclose(value[-length[k] :], alone[0], equal_nan=True) and np.allclose(sigma[-length[k] :], alone[1], equal_nan=True)
    grs = [r.random(n) * 100 for n in length]
    for y, gr_, (value, sigma) in zip(many, grs, fc.autoregressions(many, grs)):
        alone = fc.autoregression(y, gr_)
        assert np.allclose(value, alone[0], equal_nan=True) and np.allclose(sigma, alone[1])
    assert "FlatMapGroups" not in plan_of(fc.continued(series(spark)))


def test_spectra_come_from_buckets(spark):
    df = series(spark, 3, 237)
    got = {(x["well_id"], x["start"]): x for x in ft.spectral_features(df).collect()}
    values = {w: [x["gr"] for x in df.filter(f"well_id = {w}").orderBy("row_seq").collect()] for w in range(3)}
    assert set(got) == {(w, k) for w in range(3) for k in range(0, 230, 10)}
    for (w, k), x in got.items():
        p = ft.welch(np.array(values[w][k : k + 100]))
        n = len(p)
        assert np.allclose([x["depo_cyclicity"], x["depo_spectral_low"]], [p[n // 6 : n // 3].sum() / (p.sum() + 1e-9), p[: n // 3].sum() / (p.sum() + 1e-9)])
    assert plan_of(ft.fingerprint(df)).count("Join") == 1


def test_wide_frames_are_gathered_once(spark):
    df = series(spark, 4, 70).withColumn("gr", F.when(F.col("row_seq") % 9 > 0, F.col("gr")))
    plan = plan_of(ft.sequence_features(df))
    assert "ArrowEvalPython" in plan and plan.count("-49, currentrow") == 2  # the two arrays of 50 rows
    wanted = {"g": ("gr", ("mean", "std", "min", "max"), (3, 50))}
    rows = w.rolling(frames.rolled(df, wanted, "told"), "gr", ("mean", "std", "min", "max"), (3, 50), "g").collect()
    for x in rows:
        for name, value in x["told"].asDict().items():
            assert (value is None) == (x[name] is None) and (value is None or abs(value - x[name]) < 1e-9)


def test_wide_correlations_equal_sliding_ones(spark, monkeypatch):
    df = series(spark, 4, 90).withColumn("gr", F.when(F.col("row_seq") % 11 > 0, F.when(F.col("well_id") > 0, F.col("gr")).otherwise(7.3)))
    wide = w.rolling_autocorrelation(df, "gr", 10, 60, "c")
    assert "ArrowEvalPython" in plan_of(wide)
    monkeypatch.setattr(w, "MOST_PAIRS", 1000)
    a, b = ({(x["well_id"], x["row_seq"]): x["c"] for x in d.collect()} for d in (wide, w.rolling_autocorrelation(df, "gr", 10, 60, "c")))
    assert a.keys() == b.keys() and all(abs(v - b[k]) < 1e-9 for k, v in a.items()) and {v for k, v in a.items() if k[0] == 0} == {0.0}


def test_every_row_trains_a_member(spark, monkeypatch):
    """a cluster of more rows than its members' share trains on all of them, and their rounds are all told."""
    monkeypatch.setattr(gr, "ROWS", 20)
    monkeypatch.setattr(gr, "MEMBERS", 3)
    monkeypatch.setattr(gr, "MOST", 60)
    rows = spark.range(1000).select((F.col("id") % 97).cast("double").alias("f"), F.col("id").cast("double").alias("tvt"), (F.col("id") % 2).cast("int").alias("cluster_id"))
    for n, members in ((50, 2), (150, 3), (1000, 9)):  # 25, 75 and 500 rows a cluster
        models = gr.trained(rows.limit(n) if n < 1000 else rows, ["f"], "tvt", preset=(3, 0.1, 2, "absolute"), least=10, fallback=False)
        got = models.groupBy("cluster").agg(F.sum("n").alias("n"), F.count("*").alias("members")).collect()
        assert [(r["n"], r["members"]) for r in got] == [(n // 2, members)] * 2
    uneven = models.select("cluster", "member", (F.col("member") + 1).alias("rounds"))
    told = gr.errors_by_cluster(rows.withColumns({"prediction": F.lit(0.0), "model_cluster": F.col("cluster_id")}), uneven, "tvt").collect()
    assert {(r["n"], r["members"], r["rounds"]) for r in told} == {(500, 9, 5)}


def test_series_are_fingerprinted_once(spark, tmp_path, monkeypatch):
    """scaling, reduction and clustering read the fingerprints that were written, not the rows of the log again."""
    events = [(100 * k + w, w, float((7 * k + w) % 150), "a") for w in range(12) for k in range(60)]
    spark.createDataFrame(events, "event_id long, user_id long, value double, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    wells, _ = models._wells(spark, str(tmp_path))
    plan = wells._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "events.parquet" not in plan and wells.count() == 12


def test_nearest_clusters_of_unlike_sizes_equal_brute_force(spark, monkeypatch):
    """the block product tells the same nearest clusters, ties by the least id, in strips of any length."""
    r = np.random.default_rng(11)
    cells = [(k, int(r.integers(1, 5)), [float(v) for v in r.integers(-3, 4, 3)]) for k in range(90)]  # many ties
    df = spark.createDataFrame(cells, "id long, n long, c array<double>")
    want = {}
    for k, n, c in cells:
        far = {o: float(cl.ward_distance(n, m, sum((a - b) ** 2 for a, b in zip(c, d)))) for o, m, d in cells if o != k}
        want[k] = min(far, key=lambda o: (far[o], o)), min(far.values())
    for strip in (1, 7, 256):
        monkeypatch.setattr(cl, "STRIP", strip)
        got = {x["id"]: (x["to"], x["height"]) for x in cl.nearest_clusters(df, df, "bigint").collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert max(abs(got[k][1] - want[k][1]) for k in want) < 1e-9


def test_medians_only_of_what_may_be_null(spark):
    """columns that are never NULL are left out of the medians; a table whose signals may be NULL is filled as before."""
    df = series(spark, 6, 20)
    solid = df.select("well_id", "row_seq", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("md", "x", "y", "z", "gr", "tvt")), "tvt_input")
    family = pf.PredictorFamily(1).fit(solid)
    assert {"md", "gr", "gr_lag1", "md_frac"} <= set(family.medians) and not {"gr_roc", "gr_roll_std5", "tvt_ffill", "well_geo_gr_mean"} & set(family.medians)
    holes = df.withColumns({"gr": F.when(F.col("row_seq") % 3 > 0, F.col("gr")), "x": F.lit(None).cast("double")})
    out = family.transform(holes)
    row = out.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in ("gr", "x", *family.features))).first().asDict()
    assert not any(row.values()), {c: n for c, n in row.items() if n}


def test_staged_run_keeps_its_fingerprints(spark, monkeypatch):
    """counting, scaling, reduction and clustering of the learnt series read a table."""
    names, kept = [], pipelines.kept_table
    monkeypatch.setattr(pipelines, "kept_table", lambda df, name: names.append(name) or kept(df, name))
    _, _, groups = pipelines.staged_features(series(spark, 12, 30), 3, 2)
    assert names == ["wells"] and "cluster_id" in groups["sedimentary"]
