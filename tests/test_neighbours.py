"""Neighbours, agglomerative clusters and grouped models against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.operators import clusters as cl
from strataflow.operators import grouped as gr
from strataflow.operators import models as ml
from strataflow.operators import neighbours as nb


def frame(spark, x, key="id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{key} long, v array<double>")


@pytest.mark.parametrize("measure", ["cosine", "euclidean"])
def test_topk_over_blocks(spark, monkeypatch, measure):
    monkeypatch.setattr(nb, "BLOCK", 64)
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(100, 5)), 3, axis=0)[:290]  # each vector three times: ties
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    s = u @ u.T if measure == "cosine" else -((x[:, None] - x[None]) ** 2).sum(2)
    got = {}
    for r in nb.topk(frame(spark, x), frame(spark, x), 4, "id", "v", measure).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["id"], r["score"])
    for i in range(len(x)):
        want = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-round(s[i, j], 9), j))[:4]
        assert [got[i][k][0] for k in (1, 2, 3, 4)] == want
        assert [got[i][k][1] for k in (1, 2, 3, 4)] == pytest.approx([s[i, j] for j in want], abs=1e-9)


def test_topk_leaves_out_what_has_no_place(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, []), (None, [1.0, 0.0]), (5, [1.0, float("nan")]), (6, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert [(r["query"], r["id"]) for r in nb.topk(df, df, 3, "id", "v").orderBy("query").collect()] == [(1, 2), (2, 1)]
    assert nb.topk(df.limit(0), df, 3, "id", "v").count() == 0


def test_index_is_stored_appended_and_reopened(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8)) + 3 * rng.integers(0, 6, 600)[:, None]
    df, path = frame(spark, x), str(tmp_path / "index")
    nb.EmbeddingIndex.build(df.filter("id < 400"), path, "id", "v", cells=8, k=5)
    index = nb.EmbeddingIndex(spark, path).append(df.filter("id >= 300"))
    index.append(df)  # again: nothing is new
    assert index.rows().count() == 600 and index.rows().select("key").distinct().count() == 600
    assert nb.EmbeddingIndex(spark, path).settings["recall"] >= 0.95
    pairs = lambda d: {(r["query"], r["id"]) for r in d.collect()}
    true, found = pairs(nb.topk(df, df, 5, "id", "v")), pairs(index.tuned(0.95, 5).query(df, 5))
    assert len(true & found) >= 0.95 * len(true)
    assert pairs(index.query(df, 5, probes=8)) == true  # all cells: exact


def greedy(x):
    """Ward's merges one by one."""
    n, c, out = dict.fromkeys(range(len(x)), 1), dict(enumerate(x)), []
    while len(n) > 1:
        keys = sorted(n)
        h, a, b = min((cl.ward_distance(n[a], n[b], ((c[a] - c[b]) ** 2).sum()), a, b) for i, a in enumerate(keys) for b in keys[i + 1 :])
        c[a], n[a] = (n[a] * c[a] + n[b] * c[b]) / (n[a] + n[b]), n[a] + n[b]
        del n[b]
        out.append((a, b, round(float(h), 8), n[a]))
    return out


def test_ward_merges_and_cuts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 40)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 4)) + 2 * rng.integers(0, 5, 150)[:, None]
    df, want = frame(spark, x), greedy(x)
    merges = cl.ward(df, "id", "v", finish=50)
    order = lambda rows: sorted(rows, key=lambda r: (r[2], r))
    assert order((r["left"], r["right"], round(r["height"], 8), r["size"]) for r in merges.collect()) == order(want)
    assert merges.agg(F.max("round")).first()[0] > 3
    for k in (1, 4, 150):
        root = list(range(150))
        for a, b, _, _ in order(want)[: 150 - k]:
            root = [a if r == b else r for r in root]
        number = {r: i for i, r in enumerate(sorted(set(root)))}
        assert {r["id"]: r["cluster_id"] for r in cl.cut(merges, df, "id", k).collect()} == {i: number[r] for i, r in enumerate(root)}


def test_ward_of_equal_points_and_few(spark):
    same = frame(spark, np.zeros((70, 2)))
    merges = cl.ward(same, "id", "v", finish=8)
    assert merges.count() == 69 and merges.agg(F.max("height")).first()[0] == 0.0
    assert cl.ward(same.limit(1), "id", "v").count() == 0 and cl.ward(same.limit(0), "id", "v").count() == 0


def test_similar_of_a_cluster(spark):
    x = np.array([[0.0], [1.0], [3.0], [10.0], [11.0]])
    df = frame(spark, x)
    own = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)], "id long, cluster_id int")
    got = {(r["query"], r["rank"]): (r["id"], r["distance"]) for r in cl.similar(df, own, "id", "v", 2).collect()}
    assert got == {(0, 1): (1, 1.0), (0, 2): (2, 3.0), (1, 1): (0, 1.0), (1, 2): (2, 2.0), (2, 1): (1, 2.0), (2, 2): (0, 3.0), (3, 1): (4, 1.0), (4, 1): (3, 1.0)}
    assert {r["id"] for r in cl.members(own, "id", 1).collect()} == {3, 4}


@pytest.fixture(scope="module")
def steps(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3 if i % 10 else None, float(a), float(b), float(np.sign(a) * (1 + i % 3) + 0.5 * b), i % 5 == 0) for i, (a, b) in enumerate(rng.normal(size=(900, 2)))]
    rows += [(i, 7, 0.0, 0.0, 1.0, False) for i in range(900, 910)] + [(910, 0, None, float("nan"), None, False)]
    return spark.createDataFrame(rows, "id long, cluster_id int, a double, b double, y double, held boolean").cache()


@pytest.mark.parametrize("loss", ["squared", "absolute"])
def test_grouped_models_equal_training_one_by_one(spark, steps, loss):
    preset = (30, 0.2, 3, loss)
    models = gr.trained(steps, ["a", "b"], "y", held=F.col("held"), preset=preset).cache()
    out = gr.predicted(steps, models, ["a", "b"]).toPandas().set_index("id").sort_index()
    assert len(out) == 911 and set(out["model_cluster"].dropna()) == {-1, 0, 1, 2}
    assert (out.loc[900:909, "model_cluster"] == -1).all()  # too few rows: the fallback
    p = steps.toPandas().set_index("id").sort_index()
    edges = gr.bin_edges(steps.filter("y is not null"), ["a", "b"])
    x = np.stack([np.searchsorted(e, np.nan_to_num(p[c].astype(float))) for c, e in zip("ab", edges)], 1).astype(np.uint8)
    for c in (0, 1, 2):
        at = np.flatnonzero((p["cluster_id"] == c) & p["y"].notna())
        at = at[np.lexsort((p["b"].to_numpy()[at], p["a"].to_numpy()[at], p["y"].to_numpy()[at]))]
        model = gr.boosted(x[at], p["y"].to_numpy()[at], p["held"].to_numpy()[at], *preset)
        rows = np.flatnonzero(p["cluster_id"] == c)
        assert out["prediction"].to_numpy()[rows] == pytest.approx(gr.guessed(model, x[rows]), abs=1e-9)
    errors = {r["cluster_id"]: r for r in gr.errors_by_cluster(gr.predicted(steps, models, ["a", "b"]).filter("held"), models, "y").collect()}
    assert errors[0]["mae"] < 0.3 and errors[0]["n"] == p[p["held"] & (p["cluster_id"] == 0)].shape[0]


def test_early_stop_and_presets(spark, steps):
    models = gr.trained(steps, ["a"], "y", held=F.col("held"), preset="quick", patience=5).collect()
    assert all(m["rounds"] < gr.PRESETS["quick"][0] for m in models)


def test_members_of_a_large_cluster(spark, steps, monkeypatch):
    monkeypatch.setattr(gr, "ROWS", 100)
    models = gr.trained(steps, ["a", "b"], "y", preset=(20, 0.3, 3, "squared")).cache()
    assert {(r["cluster"], r["m"]) for r in models.groupBy("cluster").agg(F.count("*").alias("m")).collect()} == {(-1, 8), (0, 3), (1, 3), (2, 3)}
    out = gr.predicted(steps, models, ["a", "b"])
    e = out.filter("y is not null").agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert out.count() == 911 and e < 0.6


def test_final_fit_takes_the_stopped_rounds(spark, steps):
    stopped = gr.trained(steps, ["a", "b"], "y", held=F.col("held"), preset=(200, 0.2, 3, "squared"), patience=5).cache()
    rounds = {r["cluster"]: r["rounds"] for r in stopped.collect()}
    last = {r["cluster"]: (r["rounds"], r["n"]) for r in gr.final(steps, stopped, ["a", "b"], "y", preset=(200, 0.2, 3, "squared")).collect()}
    assert {c: r for c, (r, _) in last.items()} == rounds and all(r < 200 for r in rounds.values())
    assert last[0][1] == steps.filter("cluster_id = 0 and y is not null").count()  # held rows too


def test_spark_training_stops(spark, steps):
    df = steps.filter("y is not null").withColumn("well_id", F.col("id") % 20)
    train, val = df.filter("well_id < 15"), df.filter("well_id >= 15")
    model, trees, mae, _ = ml.stopped(train, val, ["a", "b"], "y", trees=60, step=0.5, depth=3, loss="squared", tolerance=0.05)
    assert 1 <= trees < 60 and mae < 1.2
    assert ml.final_fit(df, ["a", "b"], "y", trees, step=0.5, depth=3, loss="squared").stages[-1].getNumTrees == trees


def test_rows_of_vectors_that_take_part(spark):
    """F8: units are made many rows at once, to the bit as unit() makes them."""
    rng = np.random.default_rng(8)
    cells = [(i, [float(x) for x in rng.normal(size=3 + i % 3)]) for i in range(60)]
    cells += [(60, None), (61, []), (62, [1.0, None, 2.0]), (63, [1.0, float("nan")]), (None, [1.0]), (64, [0.0, 0.0])]
    df = spark.createDataFrame(cells, "id long, e array<float>").repartition(3)
    want = {r[0]: r[1] for r in df.filter("id < 60 or id = 64").select("id", nb.unit(F.col("e"))).collect()}
    assert {r["key"]: r["v"] for r in nb._sides(df, "id", "e", "cosine", "key").collect()} == want
    plain = {r["key"]: r["v"] for r in nb._sides(df, "id", "e", "euclidean", "key").collect()}
    assert plain == {r[0]: r[1] for r in df.filter("id < 60 or id = 64").select("id", F.col("e").cast("array<double>")).collect()}


def test_blocks_grow_instead_of_more_copies(spark, monkeypatch):
    """F8: a row travels at most GRID times while a block of that many rows fits a task; the answers are the same."""
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)], "id long, e array<double>")
    found = lambda: {(r["query"], r["rank"]): (r["id"], round(r["score"], 9)) for r in nb.topk(df, df, 3, "id", "e").collect()}
    want = found()
    monkeypatch.setattr(nb, "BLOCK", 10)
    monkeypatch.setattr(nb, "GRID", 2)
    rows = nb._sides(df, "id", "e", "cosine", "query")
    for numbers, blocks in ((1 << 23, 2), (400, 3), (1, 30)):
        monkeypatch.setattr(nb, "NUMBERS", numbers)
        pairs = nb._paired(rows, rows.withColumnRenamed("query", "key"), [], 1, "bigint", "cosine")
        assert pairs.count() == 300 * blocks  # a best one of each block that a row met
        assert found() == want
