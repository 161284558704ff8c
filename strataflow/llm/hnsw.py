"""Operator 11: approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

Equal vectors are one node, which carries the least k + 1 ids (all that can be among a query's k). Nodes go to the cell of the
nearest centroid (k-means over at most SAMPLE nodes), large cells are split by a hash, so that a shard has about SHARD nodes.
Each shard's graph is built in its own task and stored flat: one row a node, with its place, its level, its vector and one
array of neighbours (2 LINKS of the lowest layer, then LINKS of each further one; -1: none). Nodes are placed by falling level, so
a layer is a prefix of the places, and inserted in batches: the walk of a whole batch is one numpy loop, its members also
meet each other, and lists keep neighbours that are closer to the node than to a kept one, then the nearest others.

A query searches the shards of its PROBES nearest cells; distances of what the walks find are computed again from the
original vectors in double precision, and shard results are merged. The recall of at most AUDITED queries is measured against
brute force over all nodes; below RECALL twice as many cells are searched, in the end all.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of different lengths
never meet; repeated rows (equal id and vector) count once; an id with several vectors is a candidate with each, and its
queries' results are merged; rows of a query's own id are no candidates of it; null ids are candidates, last among equals, and
no queries; other columns are ignored; an empty table gives an empty result. Squares beyond the range of doubles give infinity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import least_hashed, read, written

SHARD, LINKS, BUILD, SEARCH, BATCH = 4096, 16, 48, 96, 512
#: Nodes from which centroids are learnt, most cells, cells searched at first, queries a task searches at once.
SAMPLE, MOST_CELLS, PROBES, QUERIES = 16384, 1024, 4, 2048
AUDITED, RECALL = 256, 0.95


def decoded(vec: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    """Vectors of one length, from bytes of float32 or doubles, as doubles."""
    return np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * length else np.float64) for v in vec.to_pylist()]).astype(float)


def encoded(e: pa.Scalar) -> bytes | None:
    """The vector's bytes, as float32 where that loses nothing; None for one that takes no part."""
    if not e.is_valid or e.values.null_count or not len(e.values):
        return None
    x = np.asarray(e.values, float) + 0.0  # -0 as 0
    if not np.isfinite(x).all() or not x.any():
        return None
    with np.errstate(over="ignore", under="ignore"):
        short = x.astype(np.float32)
    return short.tobytes() if np.array_equal(short, x) else x.tobytes()


def vectors_of(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, length, vec of the vectors that take part, repeated rows once."""
    kind = rows.schema[vec_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = [encoded(e) for e in b.column(1)]
            length = [len(e.values) if v else 0 for e, v in zip(b.column(1), vec)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(length, pa.int32()), pa.array(vec, pa.binary())], ["id", "length", "vec"])

    made = rows.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("e")).mapInArrow(run, f"id {kind}, length int, vec binary")
    return made.filter("vec is not null").distinct()


def walked(x: np.ndarray, square: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances): for each row of q the `width` nearest nodes that a best-first walk from its starts meets, in order.

    Distances are squares less the query's own square. All queries walk in step; -1: no node."""
    n, far = len(q), np.inf
    seen = np.zeros((n, len(x) + 1), bool)
    seen[:, -1] = True  # of -1
    d = np.where(start < 0, far, square[start] - 2 * np.einsum("amd,ad->am", x[start], q))
    seen[np.arange(n)[:, None], start] = True
    place, dist = np.full((n, width), -1), np.full((n, width), far)
    order = np.argsort(d, axis=1)[:, :width]
    m = order.shape[1]
    place[:, :m], dist[:, :m] = np.take_along_axis(start, order, 1), np.take_along_axis(d, order, 1)
    done = place < 0
    live = np.arange(n)
    while True:
        pick = np.argmin(done[live], axis=1)
        going = ~done[live, pick]
        live, pick = live[going], pick[going]
        if not len(live):
            return place, dist
        done[live, pick] = True
        near = links[place[live, pick]]
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        d = np.where(fresh, square[near] - 2 * np.einsum("amd,ad->am", x[near], q[live]), far)
        near = np.where(fresh, near, -1)
        both, ends = np.concatenate([dist[live], d], 1), np.concatenate([place[live], near], 1)
        order = np.argsort(both, axis=1)[:, :width]
        dist[live], place[live] = np.take_along_axis(both, order, 1), np.take_along_axis(ends, order, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], near < 0], 1), order, 1)


def diverse(x: np.ndarray, square: np.ndarray, place: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Of each row's nodes (in order of their full squared distances; -1: none) at most `most`: those nearer to the row's node than to
    one taken before, then the nearest others."""
    v = x[place]
    apart = square[place][:, :, None] + square[place][:, None, :] - 2 * v @ v.transpose(0, 2, 1)
    taken = np.zeros(place.shape, bool)
    for k in range(place.shape[1]):
        hidden = (taken & (apart[:, k] < dist[:, k, None])).any(1)
        taken[:, k] = (place[:, k] >= 0) & ~hidden & (taken.sum(1) < most)
    order = np.argsort(np.where(taken, 0, np.where(place >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(place, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def nearest_first(x: np.ndarray, square: np.ndarray, own: np.ndarray, place: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, full squared distances) of the nodes next to each own node, repeats and itself left out, nearest first."""
    place = np.sort(np.where(place == own[:, None], -1, place), axis=1)
    place[:, 1:][place[:, 1:] == place[:, :-1]] = -1
    d = np.where(place < 0, np.inf, square[own][:, None] + square[place] - 2 * np.einsum("amd,ad->am", x[place], x[own]))
    order = np.argsort(d, axis=1)[:, :most]
    return np.take_along_axis(place, order, 1), np.take_along_axis(d, order, 1)


def levels(n: int, seed: int) -> np.ndarray:
    """Falling levels of n nodes: each next level holds 1 / LINKS of the nodes on average."""
    u = np.random.default_rng(seed).random(n)
    return np.sort((-np.log(1 - u) / np.log(LINKS)).astype(np.int32))[::-1]


def built(x: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
    """The layers' links: of layer l an array with a row for each of the first nodes, those of a level of l or more."""
    square = (x * x).sum(1)
    count = [int((level >= l).sum()) for l in range(int(level[0]) + 1)]
    layers = [np.full((c, 2 * LINKS if l == 0 else LINKS), -1) for l, c in enumerate(count)]
    a = 0
    while a < len(x):
        z = min(len(x), a + min(max(a, 64), BATCH))
        start = np.zeros((z - a, 1), int)
        for l in range(len(layers) - 1, -1, -1):
            links, most = layers[l], layers[l].shape[1]
            if a:
                start = walked(x, square, links[: max(count[l], 1)], x[a:z], start, BUILD if a < count[l] else 1)[0]
            own = np.arange(a, min(z, count[l]))
            if not len(own):
                continue
            peers = np.broadcast_to(own, (len(own), len(own)))
            if len(own) > BUILD + 1:
                s = square[own][None, :] - 2 * x[own] @ x[own].T
                peers = own[np.argpartition(s, BUILD, axis=1)[:, : BUILD + 1]]
            place = np.concatenate([start[: len(own)], peers], 1) if a else peers
            place, dist = nearest_first(x, square, own, place, BUILD)
            links[own] = diverse(x, square, place, dist, most)
            # each new link also leads back; lists that overflow are chosen anew
            to, of = links[own].ravel(), np.repeat(own, most)
            to, of = to[to >= 0], of[to >= 0]
            order = np.lexsort((((x[to] - x[of]) ** 2).sum(1), to))
            to, of = to[order], of[order]
            ends, first = np.unique(to, return_index=True)
            rank = np.arange(len(to)) - np.repeat(first, np.diff([*first, len(to)]))
            back = np.full((len(ends), 2 * most), -1)
            few = rank < 2 * most
            back[np.searchsorted(ends, to[few]), rank[few]] = of[few]
            for k in range(0, len(ends), BATCH):
                e = ends[k : k + BATCH]
                place, dist = nearest_first(x, square, e, np.concatenate([links[e], back[k : k + BATCH]], 1), 2 * most)
                links[e] = diverse(x, square, place, dist, most)
        a = z
    return layers


def searched(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, width: int) -> np.ndarray:
    """Places of the `width` nearest nodes found for each row of q; -1: none."""
    square, place = (x * x).sum(1), np.zeros((len(q), 1), int)
    for l in range(len(layers) - 1, -1, -1):
        place = walked(x, square, layers[l], q, place, 1 if l else width)[0]
    return place


def centroids(nodes: DataFrame, seed: int = 7) -> dict[int, np.ndarray]:
    """By length of vectors the centres of its cells: k-means over the SAMPLE nodes with the least hashes."""
    n, sample = nodes.count(), least_hashed(nodes.select("length", "vec"), SAMPLE, "vec").toArrow()
    cells, out = min(MOST_CELLS, -(-n // SHARD)), {}
    for length in set(sample["length"].to_pylist()):
        x = decoded(sample.filter(pc.equal(sample["length"], length))["vec"], length)
        k = max(1, min(len(x), round(cells * len(x) / sample.num_rows)))
        c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
        for _ in range(10):
            own = cell_order(x, c, 1)[:, 0]
            held = np.bincount(own, minlength=k)
            total = np.zeros_like(c)
            np.add.at(total, own, x)
            c = np.where(held[:, None] > 0, total / np.maximum(held, 1)[:, None], c)
        out[length] = c
    return out


def cell_order(x: np.ndarray, c: np.ndarray, most: int) -> np.ndarray:
    """The `most` nearest centres of each row, nearest first."""
    d = (c * c).sum(1) - 2 * x @ c.T
    return np.argsort(d, axis=1, kind="stable")[:, :most]


def routed(rows: DataFrame, centres, columns: list[str], low: int, high: int) -> DataFrame:
    """The columns, length, vec, and a row for each cell from the low-th to before the high-th nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = centres.value
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            for d in np.unique(length):
                part = b.filter(pa.array(length == d))
                c = known.get(int(d), np.zeros((1, int(d))))
                cells = cell_order(decoded(part.column(part.schema.get_field_index("vec")), int(d)), c, high)[:, low:]
                if cells.shape[1]:
                    part = part.take(pa.array(np.repeat(np.arange(part.num_rows), cells.shape[1])))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells.ravel().astype(np.int32))], [*part.schema.names, "cell"])

    kinds = dict(rows.dtypes)
    return rows.select(*columns, "length", "vec").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in (*columns, "length", "vec")) + ", cell int")


def graphs(nodes: DataFrame, centres) -> DataFrame:
    """length, cell, part, place, level, near, vec, ids: every node in the flat graph of its shard. nodes: length, vec, ids."""
    placed = routed(nodes, centres, ["ids"], 0, 1)
    parts = placed.groupBy("length", "cell").agg(F.ceil(F.count("*") / SHARD).alias("parts"))
    placed = placed.join(parts, ["length", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec"), "parts").cast("int"))

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec")
        order = np.random.default_rng(t.num_rows).permutation(t.num_rows)  # places don't hang on the order of arrival
        t = t.take(pa.array(order))
        x, level = decoded(t["vec"], t["length"][0].as_py()), levels(t.num_rows, t.num_rows)
        layers = built(x / np.abs(x).max(), level)
        near = [np.concatenate([layers[l][k] for l in range(level[k] + 1)]) for k in range(t.num_rows)]
        return pa.table([t["length"], t["cell"], t["part"], pa.array(np.arange(t.num_rows, dtype=np.int32)), pa.array(level), pa.array(near, pa.list_(pa.int32())), t["vec"], t["ids"]], names=["length", "cell", "part", "place", "level", "near", "vec", "ids"])

    kind = dict(nodes.dtypes)["ids"]
    return placed.groupBy("length", "cell", "part").applyInArrow(build, f"length int, cell int, part int, place int, level int, near array<int>, vec binary, ids {kind}")


def layers_of(t: pa.Table) -> list[np.ndarray]:
    """The layers' links, from rows in order of place."""
    level = t["level"].to_numpy()
    near = t["near"].combine_chunks()
    flat, at = near.values.to_numpy(), near.offsets.to_numpy()[:-1]
    lowest = flat[at[:, None] + np.arange(2 * LINKS)].astype(int)
    higher = [flat[at[: int((level >= l).sum()), None] + 2 * LINKS + (l - 1) * LINKS + np.arange(LINKS)].astype(int) for l in range(1, int(level[0]) + 1)]
    return [lowest, *higher]


def search(index: DataFrame, queries: DataFrame, k: int, kind: str) -> DataFrame:
    """query_id, vec_id, score: of every shard of a query's cells the ids of its k + 1 nearest nodes. queries: id, length, vec, cell."""
    cells = index.select("length", "cell", "part").distinct().groupBy("length", "cell").agg(F.max("part").alias("last"))
    asked = queries.groupBy("length", "cell").agg(F.ceil(F.count("*") / QUERIES).alias("blocks")).join(cells, ["length", "cell"])
    each = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int")))
    left = index.join(asked.select("length", "cell", each(F.col("blocks") - 1).alias("block")), ["length", "cell"])
    right = queries.join(asked, ["length", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("part", each(F.col("last"))).select("length", "cell", "part", "block", "id", F.col("vec").alias("q"))
    keys = ["length", "cell", "part", "block"]

    def find(t: pa.Table, asked: pa.Table) -> pa.Table:
        rows = []
        if t.num_rows and asked.num_rows:
            t = t.sort_by("place")
            length = t["length"][0].as_py()
            x, layers = decoded(t["vec"], length), layers_of(t)
            top = np.abs(x).max()
            own, back = np.unique(np.array(asked["q"].to_pylist(), object), return_inverse=True)
            q = decoded(pa.array(own.tolist(), pa.binary()), length)
            hits = []
            for s in range(0, len(q), 256):
                place = searched(x / top, layers, q[s : s + 256] / top, max(SEARCH, 2 * k))
                with np.errstate(over="ignore"):
                    d = np.where(place < 0, np.inf, np.sqrt(((x[place] - q[s : s + 256, None]) ** 2).sum(2)))
                best = np.lexsort((place, d), axis=1)[:, : k + 1]
                hits += list(zip(np.take_along_axis(place, best, 1).tolist(), np.take_along_axis(d, best, 1).tolist()))
            ids = t["ids"].to_pylist()
            rows = [(i, v, d) for i, h in zip(asked["id"].to_pylist(), back.tolist()) for p, d in zip(*hits[h]) if p >= 0 for v in ids[p]]
        cells = list(zip(*rows)) or [[], [], []]
        types = (asked.schema.field("id").type, t.schema.field("ids").type.value_type, pa.float64())
        return pa.table([pa.array(c, y) for c, y in zip(cells, types)], names=["query_id", "vec_id", "score"])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(find, f"query_id {kind}, vec_id {kind}, score double")


def exact(nodes: DataFrame, queries: DataFrame, k: int, kind: str) -> DataFrame:
    """query_id, vec_id, score by brute force over all nodes; queries (id, length, vec) are few: AUDITED at most."""
    few = queries.select("id", "length", "vec").toArrow()
    ids, size = few["id"].to_pylist(), np.array(few["length"].to_pylist())
    asked = {int(d): (np.flatnonzero(size == d), decoded(few.filter(pa.array(size == d))["vec"], int(d))) for d in np.unique(size)}
    id_type = few.schema.field("id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rows = b.column(0).to_numpy(), []
            for d, (which, q) in asked.items():
                part = b.filter(pa.array(length == d))
                if not part.num_rows:
                    continue
                x, held = decoded(part.column(1), d), part.column(2).to_pylist()
                for w, v in zip(which.tolist(), q):
                    with np.errstate(over="ignore"):
                        s = np.sqrt(((x - v) ** 2).sum(1))
                    best = np.argsort(s, kind="stable")
                    for p in best[s[best] <= s[best[min(k, len(best) - 1)]]].tolist():
                        rows += [(ids[w], i, float(s[p])) for i in held[p]]
            cells = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cells[0], id_type), pa.array(cells[1], id_type), pa.array(cells[2], pa.float64())], ["query_id", "vec_id", "score"])

    return nodes.select("length", "vec", "ids").mapInArrow(run, f"query_id {kind}, vec_id {kind}, score double")


def merged(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of what the shards found."""
    best = Window.partitionBy("query_id").orderBy("score", F.asc_nulls_last("vec_id"))
    own = found.filter(~F.col("vec_id").eqNullSafe(F.col("query_id"))).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return own.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, asked, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", measured: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row where the condition `asked` (on vec_id) holds.
    measured: gets a (cells searched, recall) for each round."""
    spark = vectors.sparkSession
    kind = vectors.schema[vec_id].dataType.simpleString()
    rows = written(vectors_of(vectors, vec_id, embedding), "vectors")
    least = Window.partitionBy("length", "vec").orderBy(F.asc_nulls_last("id"))
    kept = rows.withColumn("r", F.row_number().over(least)).filter(F.col("r") <= k + 1)
    nodes = written(kept.groupBy("length", "vec").agg(F.collect_list("id").alias("__set"), F.max(F.col("id").isNull()).alias("__null")).select("length", "vec", F.when(F.col("__null"), F.concat("__set", F.array(F.lit(None).cast(kind)))).otherwise(F.col("__set")).alias("ids")), "nodes")
    centres = centroids(nodes)
    cells, sent = max([len(c) for c in centres.values()], default=1), spark.sparkContext.broadcast(centres)
    index = written(graphs(nodes, sent), "graphs")
    queries = rows.filter("id is not null").filter(asked(F.col("id")))
    audited = written(least_hashed(queries, AUDITED, "id"), "audited")
    true = written(merged(exact(nodes, audited, k, kind), k), "true", True)
    wanted, found, low, high = true.count(), None, 0, PROBES
    while True:
        more = written(search(index, routed(queries, sent, ["id"], low, high), k, kind), "found", True)
        found = more if found is None else found.unionByName(more)
        mine = merged(found.join(audited.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_semi"), k)
        hit = mine.join(true.select("query_id", "vec_id"), (mine["query_id"] == true["query_id"]) & mine["vec_id"].eqNullSafe(true["vec_id"]), "left_semi").count()
        if measured is not None:
            measured.append((min(high, cells), hit / max(wanted, 1)))
        if hit >= RECALL * wanted or high >= cells:
            return merged(found, k)
        low, high = high, 2 * high


def op11_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: every vec_id divisible by 100 against all others."""
    return nearest(read(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)
