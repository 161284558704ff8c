"""A boosted-tree model for each cluster of series, trained in tasks: models are rows of a table, not objects on the driver.

Feature values are cut into bins once for the whole table. Every row of a cluster is dealt to one of its members, of about ROWS
rows (beyond MEMBERS of these, of more rows, up to MOST), each trained in its own task on its histogram of bins; a cluster's
model is the mean of its members, so that all its rows make it. Clusters with fewer than `least` training rows take
the fallback, a model of all clusters made in the same way. Training stops early where a validation part is given."""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import PRESETS

BINS, ROWS, MEMBERS, MOST, LEAF, TASKS = 64, 100_000, 8, 400_000, 5, 256
#: The cluster under which the fallback's members stand; rounds without a gain after which training stops.
FALLBACK, PATIENCE = -1, 50


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> np.ndarray:
    """Inner edges of the bins (features x (bins - 1)), by approximate percentiles over all rows; missing counts as 0."""
    at = [k / bins for k in range(1, bins)]
    row = df.agg(*(F.percentile_approx(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), at, 10_000).alias(c) for c in features)).first()
    return np.array([row[c] if row[c] is not None else [0.0] * (bins - 1) for c in features])


def binned(t: pa.Table, features: Sequence[str], edges: np.ndarray) -> np.ndarray:
    cells = [np.searchsorted(e, np.nan_to_num(t[c].fill_null(0).to_numpy().astype(float))) for c, e in zip(features, edges)]
    return np.stack(cells, axis=1).astype(np.uint8) if cells else np.zeros((t.num_rows, 0), np.uint8)


def leaf_values(leaf: np.ndarray, residual: np.ndarray, leaves: int, loss: str) -> np.ndarray:
    """Mean (squared loss) or median (absolute) of the residuals in each leaf; 0 in empty ones."""
    n = np.bincount(leaf, minlength=leaves)
    if loss == "squared":
        return np.bincount(leaf, residual, leaves) / np.maximum(n, 1)
    r = residual[np.argsort(leaf.astype(np.uint16), kind="stable")]  # short numbers are sorted by digits
    out, end = np.zeros(leaves), 0
    for k, m in enumerate(n.tolist()):
        if m:
            middle = ((m - 1) // 2, m // 2)
            part = np.partition(r[end : end + m], middle)
            out[k] = (part[middle[0]] + part[middle[1]]) / 2
        end += m
    return out


def cells_of(x: np.ndarray, bins: int) -> np.ndarray:
    """The place of each row's bins among those of all features."""
    return x + np.arange(x.shape[1], dtype=np.int64) * bins


def histograms(node: np.ndarray, cells: np.ndarray, target: np.ndarray, wide: int, bins: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sum of targets) by node, feature and bin. whole: over 0 where targets are -1, 0 or 1 of fewer than so many rows;
    one sum then holds both."""
    n, f = cells.shape
    at, size, shape = (node[:, None] * (f * bins) + cells).ravel(), wide * f * bins, (wide, f, bins)
    if whole:
        both = np.bincount(at, np.repeat(target + 4.0 * whole, f), size)
        count = np.rint(both / (4.0 * whole))
        return count.astype(np.int64).reshape(shape), (both - count * (4.0 * whole)).reshape(shape)
    return np.bincount(at, minlength=size).reshape(shape), np.bincount(at, np.repeat(target, f), size).reshape(shape)


def tree(x: np.ndarray, target: np.ndarray, depth: int, bins: int, cells: np.ndarray | None = None, signs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, leaf of each row) of a full binary tree by least squares on histograms; bins: no split, all go left.

    signs: targets are -1, 0 or 1; then only the smaller child of a node is counted, the other is what is left of the node (such
    sums are exact)."""
    n, f = x.shape
    cells = cells_of(x, bins) if cells is None else cells
    whole = 1 << int(n).bit_length() if signs else 0
    feature, cut, node = np.zeros((1 << depth) - 1, np.int16), np.full((1 << depth) - 1, bins, np.int16), np.zeros(n, np.int64)
    flat, start = np.ascontiguousarray(x).ravel(), np.arange(n) * f
    count = total = None
    for level in range(depth):
        wide = 1 << level
        if whole and level:
            rows = np.bincount(node, minlength=wide).reshape(-1, 2)
            small = np.zeros((wide // 2, 2), bool)
            small[np.arange(wide // 2), (rows[:, 1] < rows[:, 0]).astype(int)] = True
            pick = np.flatnonzero(small.ravel()[node])
            c, s = histograms(node[pick] >> 1, cells[pick], target[pick], wide // 2, bins, whole)
            c, s = (np.where(small[:, :, None, None], v[:, None], (old - v)[:, None]) for v, old in ((c, count), (s, total)))
            count, total = c.reshape(wide, f, bins), s.reshape(wide, f, bins)
        else:
            count, total = histograms(node, cells, target, wide, bins, whole)
        left, s = count.cumsum(2), total.cumsum(2)
        right, z = left[:, :, -1:] - left, s[:, :, -1:] - s
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = s * s / left + z * z / right - s[:, :, -1:] ** 2 / left[:, :, -1:]
        gain = np.where((left >= LEAF) & (right >= LEAF), gain, 0.0).reshape(wide, f * bins)
        best = gain.argmax(1)
        good = gain[np.arange(wide), best] > 1e-12
        base = wide - 1
        feature[base : base + wide], cut[base : base + wide] = best // bins, np.where(good, best % bins, bins)
        of, at = feature[base : base + wide].astype(np.int64), cut[base : base + wide]
        node = 2 * node + (flat.take(start + of.take(node)) > at.take(node))
    return feature, cut, node


def boosted(x: np.ndarray, y: np.ndarray, held: np.ndarray, trees: int, step: float, depth: int, loss: str, patience: int = PATIENCE) -> dict[str, np.ndarray]:
    """Boosted trees on binned features; held rows only judge each round. `rounds`: how many trees did best on them."""
    bins, train = BINS, ~held
    base = float(np.median(y[train]) if loss == "absolute" else y[train].mean())
    inner, outer, signs = x[train], x[held], loss == "absolute"
    cells, bits = cells_of(inner, bins), tests(outer)
    y_in, y_out = y[train], y[held]
    guess, beyond, judged, made = np.full(len(y_in), base), np.full(len(y_out), base), [], []
    for _ in range(trees):
        residual = y_in - guess
        feature, cut, leaf = tree(inner, np.sign(residual) if signs else residual, depth, bins, cells, signs)
        value = step * leaf_values(leaf, residual, 1 << depth, loss)
        made.append((feature, cut, value))
        guess += value[leaf]
        if len(y_out):
            beyond += value[leaves_of(bits, len(y_out), feature, cut, depth)]
            judged.append(float(np.abs(y_out - beyond).mean()))
            if len(judged) - int(np.argmin(judged)) > patience:
                break
    rounds = int(np.argmin(judged)) + 1 if judged else len(made)
    feature, cut, value = (np.stack(c) for c in zip(*made[:rounds]))
    return {"base": np.array(base), "feature": feature, "cut": cut, "value": value}


def tests(x: np.ndarray) -> np.ndarray:
    """For each feature and bin a row of bits in words: whether a row's bin is beyond it (a last row: none is)."""
    words = -(-len(x) // 64)
    out = np.zeros((x.shape[1] * BINS + 1, words * 8), np.uint8)
    for j in range(x.shape[1]):
        column = np.ascontiguousarray(x[:, j])
        for b in range(BINS):
            packed = np.packbits(column > b)
            out[j * BINS + b, : len(packed)] = packed
    return out.view(np.uint64)


def leaves_of(bits: np.ndarray, n: int, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The leaf of each of n rows, by their tests(): the nodes of a level are 64 rows a word, and each step of the path so far
    chooses between the two halves of them."""
    which = np.where(cut < BINS, feature.astype(np.int64) * BINS + cut, len(bits) - 1)
    path: list[np.ndarray] = []
    for level in range(depth):
        at = bits[which[(1 << level) - 1 : (2 << level) - 1]]
        for step in path:  # from the root on: the upper half of the nodes lies beyond its test
            half = len(at) // 2
            low = at[:half]
            at = low ^ ((low ^ at[half:]) & step)
        path.append(at[0])
    leaf = np.zeros(n, np.int64 if depth > 8 else np.uint8)
    for step in path:
        leaf = (leaf << 1) | np.unpackbits(step.view(np.uint8), count=n)
    return leaf


#: Rows whose tests are made at once.
STRIP = 1 << 15


def guessed(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    depth = int(model["value"].shape[1]).bit_length() - 1
    out = np.zeros(len(x))
    for a in range(0, len(x), STRIP):
        part = x[a : a + STRIP]
        bits, total = tests(part), out[a : a + STRIP]
        for v, f, c in zip(model["value"], model["feature"], model["cut"]):
            total += v[leaves_of(bits, len(part), f, c, depth)]
    return model["base"] + out


def packed(model: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **model)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data)))


def trained(df: DataFrame, features: Sequence[str], label: str, cluster: str = "cluster_id", held: Column | None = None, preset: str | tuple = "quick", least: int = 50, patience: int = PATIENCE, rounds: DataFrame | None = None, fallback: bool = True) -> DataFrame:
    """cluster, member, n, rounds, edges, model: the members of each cluster's model and of the fallback (cluster FALLBACK).

    held: rows that only judge when to stop. preset: a name of PRESETS or (trees, step, depth, loss). rounds: models stopped
    before (cluster, rounds), as many trees as these had are made (the final fit, on held rows too). Rows without label or
    cluster take no part in a cluster's model, those without label in none. fallback: whether to train it at all."""
    trees, step, depth, loss = PRESETS[preset] if isinstance(preset, str) else preset
    known = df.filter(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))
    rows = known.select(F.coalesce(F.col(cluster).cast("int"), F.lit(FALLBACK)).alias("cluster"), F.col(label).cast("double").alias("__y"), (F.lit(False) if held is None else F.coalesce(held, F.lit(False))).alias("__held"), *(F.col(c).cast("double").alias(c) for c in features))
    rows = rows.withColumn("__h", F.xxhash64(*features, "__y"))
    edges = bin_edges(rows, features)
    sizes = rows.groupBy("cluster").agg(F.count_if(~F.col("__held")).alias("n"))
    every = sizes.agg(F.sum("n").alias("n")).select(F.lit(FALLBACK).alias("cluster"), "n")
    sizes = sizes.filter((F.col("cluster") != FALLBACK) & (F.col("n") >= least))
    sizes = (sizes.unionByName(every) if fallback else sizes).filter("n > 0")
    parts = F.greatest(F.least(F.ceil(F.col("n") / ROWS), F.lit(MEMBERS)), F.ceil(F.col("n") / MOST)).cast("long")
    both = rows.filter(F.col("cluster") != FALLBACK)
    both = both.unionByName(rows.withColumn("cluster", F.lit(FALLBACK))) if fallback else both
    sizes = sizes.withColumn("parts", parts)
    known = rounds.groupBy("cluster").agg(F.ceil(F.avg("rounds")).cast("int").alias("__trees")) if rounds is not None else None
    sizes = sizes.join(known, "cluster", "left").withColumn("__trees", F.coalesce("__trees", F.lit(trees))) if rounds is not None else sizes.withColumn("__trees", F.lit(trees))
    both = both.join(F.broadcast(sizes), "cluster")  # a row a cluster
    both = both.withColumn("member", F.pmod("__h", "parts").cast("int")).drop("parts", "n", "__h")

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("__y", *features)])  # sums don't hang on the order of arrival
        y, out = t["__y"].to_numpy(), t["__held"].to_numpy(zero_copy_only=False)
        if out.all():
            out = np.zeros(len(out), bool)
        model = boosted(binned(t, features, edges), y, out, t["__trees"][0].as_py(), step, depth, loss, patience)
        return pa.table({"cluster": t["cluster"][:1], "member": t["member"][:1], "n": pa.array([int((~out).sum())], pa.int64()), "rounds": pa.array([len(model["value"])], pa.int32()), "edges": pa.array([edges.tolist()], pa.list_(pa.list_(pa.float64()))), "model": pa.array([packed(model)], pa.binary())})

    # so many partitions that hardly two members share one, and a number that stays: members train side by side
    return both.repartition(TASKS, "cluster", "member").groupBy("cluster", "member").applyInArrow(fit, "cluster int, member int, n long, rounds int, edges array<array<double>>, model binary")


def predicted(df: DataFrame, models: DataFrame, features: Sequence[str], cluster: str = "cluster_id", name: str = "prediction") -> DataFrame:
    """df with the prediction of its cluster's model (of the fallback where it has none) and `model_cluster`, the one used.

    Rows of a cluster are dealt to blocks of about ROWS rows, each block meets the members of its model in a task."""
    own = models.select(F.col("cluster").alias("model_cluster")).distinct()
    rows = df.join(F.broadcast(own), F.col(cluster).cast("int") == F.col("model_cluster"), "left").withColumn("model_cluster", F.coalesce("model_cluster", F.lit(FALLBACK)))
    sizes = rows.groupBy("model_cluster").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("__blocks"))
    rows = rows.join(F.broadcast(sizes), "model_cluster").withColumn("__block", F.pmod(F.xxhash64(*df.columns), "__blocks").cast("int")).drop("__blocks")
    each = models.join(F.broadcast(sizes), F.col("cluster") == F.col("model_cluster")).select("cluster", "member", "edges", "model", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("block"))
    out = [*df.columns, "model_cluster"]
    kinds = dict(rows.dtypes)

    def guess(t: pa.Table, members: pa.Table) -> pa.Table:
        total = np.zeros(t.num_rows)
        if t.num_rows and members.num_rows:
            members = members.sort_by("member")
            x = binned(t, features, np.array(members["edges"][0].as_py()))
            for m in members["model"].to_pylist():
                total += guessed(unpacked(m), x)
            total /= members.num_rows
        return t.select(out).append_column(name, pa.array(total))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in out) + f", `{name}` double"
    return rows.groupBy("model_cluster", "__block").cogroup(each.groupBy("cluster", "block")).applyInArrow(guess, schema)


def errors_by_cluster(rows: DataFrame, models: DataFrame, label: str, cluster: str = "cluster_id", name: str = "prediction") -> DataFrame:
    """cluster, n, mae, rmse, model_cluster, members, rounds (the mean of all members, rounded up): the errors on rows with a label."""
    e = F.col(label) - F.col(name)
    out = rows.filter(F.col(label).isNotNull()).groupBy(cluster, "model_cluster").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    about = models.groupBy(F.col("cluster").alias("model_cluster")).agg(F.count("*").alias("members"), F.ceil(F.avg("rounds")).cast("int").alias("rounds"))
    return out.join(F.broadcast(about), "model_cluster")


def final(df: DataFrame, stopped: DataFrame, features: Sequence[str], label: str, cluster: str = "cluster_id", preset: str | tuple = "quick", least: int = 50, fallback: bool = True) -> DataFrame:
    """Models of all rows, each with as many trees as the one of `stopped` (of trained() with held rows) did best with."""
    return trained(df, features, label, cluster, None, preset, least, rounds=stopped.select("cluster", "rounds"), fallback=fallback)
