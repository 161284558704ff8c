"""Operator 9: near-duplicate embeddings by NN-descent.

Equal vectors of a label are one node. Neighbour lists of LIST entries start from the buckets of TREES random-projection
trees, then NN-descent refines them: each node brings its neighbours and reverse neighbours together, and any two of them, at
least one of them new in its list, that are closer than the worst entry of a list, or meet a list with room, enter it. A
list whose entries are all links (at the threshold or above) is saturated and grows, up to MOST_LIST entries. Rounds end when
fewer than SETTLED of the entries are new.

Nodes whose MOST_LIST entries are still all links are compared with all nodes of their space by blocks, which counts their
links exactly without listing them. The same pass takes AUDITED further nodes to measure the recall of the lists against
brute force. Below RECALL, as many trees again are added and descended, at most FORESTS times; if that isn't enough, the
blocks take all nodes, which is quadratic in the nodes of a label but whole. Components follow from the links of both.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and null labels, link with nothing (each is
its own component); vectors of different lengths are never linked; repeated rows are linked with each other; other columns
are ignored; an empty table gives an empty result. Cosines are in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, least_hashed, read, written
from .components import components

LIST, MOST_LIST, BUCKET, TREES = 12, 96, 256, 6
#: Neighbours and reverse neighbours of a node meet in parts of about MEETING.
MEETING = 128
#: Share of new entries at which the descent ends; nodes held against all others; recall asked of them; times trees are added.
SETTLED, AUDITED, RECALL, FORESTS = 1e-3, 1024, 0.99, 3
#: Side of a block of pairs: an eighth of the space's nodes, within these bounds. Products are taken STRIP rows at a time.
LEAST_SIDE, MOST_SIDE, STRIP = 512, 8192, 512


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of rows that are equal in the first `keys` columns; rows must come ordered by them."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        if rest.num_rows < 4096:
            continue
        rest = rest.combine_chunks()
        cut = _edges(rest, keys)
        for a, z in zip(cut[:-2], cut[1:-1]):
            yield rest.slice(a, z - a)
        rest = rest.slice(cut[-2])
    if rest is not None and rest.num_rows:
        rest = rest.combine_chunks()
        cut = _edges(rest, keys)
        for a, z in zip(cut[:-1], cut[1:]):
            yield rest.slice(a, z - a)


def _edges(t: pa.Table, keys: int) -> list[int]:
    new = np.zeros(t.num_rows, bool)
    for k in range(keys):
        x = t.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    new[0] = True
    return [*np.flatnonzero(new).tolist(), t.num_rows]


def grouped(rows: DataFrame, keys: list[str], columns: list[str], each: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """each(table) for rows equal in keys, streamed through sorted partitions (groups are small and many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for t in _runs(batches, len(keys)):
            out = each(t)
            if out is not None and out.num_rows:
                held.append(out)
                n += out.num_rows
                if n > 50_000:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*keys, *columns).repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def matrix(vec, length) -> np.ndarray:
    """Vectors of one length, as bytes of float32 or (where they don't fit) of doubles, as a double matrix of unit rows."""
    d = length[0].as_py()
    x = np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * d else np.float64) for v in vec.to_pylist()]).astype(float)
    return x / np.linalg.norm(x, axis=1)[:, None]


def vector_bytes(e: pa.Scalar) -> bytes | None:
    """The vector's bytes, lossless as float32 where it fits, else as doubles over its largest component."""
    if not e.is_valid or e.values.null_count or not len(e.values):
        return None
    x = np.asarray(e.values, float)
    top = np.abs(x).max()
    if not np.isfinite(x).all() or top == 0:
        return None
    with np.errstate(over="ignore", under="ignore"):
        short = x.astype(np.float32)
    return short.tobytes() if np.array_equal(short, x) else (x / top).tobytes()


def nodes_of(vectors: DataFrame, embedding: str, label: str, vec_id: str) -> DataFrame:
    """id, node (null for vectors that link with nothing), space (label and length), length, vec (bytes)."""
    kind = vectors.schema[vec_id].dataType.simpleString()
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("e"), F.col(label).cast("string").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = [vector_bytes(e) if l.is_valid else None for e, l in zip(b.column(1), b.column(2))]
            length = [len(e.values) if v else 0 for e, v in zip(b.column(1), vec)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(length, pa.int32()), pa.array(vec, pa.binary())], ["id", "label", "length", "vec"])

    made = rows.mapInArrow(run, f"id {kind}, label string, length int, vec binary")
    valid = F.col("vec").isNotNull()
    return made.select("id", F.when(valid, F.xxhash64("label", "length", "vec")).alias("node"), F.when(valid, F.xxhash64("label", "length")).alias("space"), "length", "vec")


def projected(nodes: DataFrame, trees: range) -> DataFrame:
    """u, v, sim: for each node the closest LIST of its bucket in each tree. nodes: node, space, length, vec, bits."""
    columns = ["tree", "space", "code", "part"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            bits, size = b.column(3).to_numpy(), b.column(4).to_numpy()
            for tree in trees:
                code = np.zeros(b.num_rows, np.int64)
                for d in np.unique(size):
                    at = np.flatnonzero(size == d)
                    if (tree, d) not in planes:
                        planes[tree, d] = np.random.default_rng((tree, int(d))).standard_normal((int(d), 40))
                    sign = matrix(b.column(2).take(pa.array(at)), b.column(4).take(pa.array(at))) @ planes[tree, d] > 0
                    code[at] = (sign * (1 << np.arange(40))).sum(1) & ((1 << bits[at]) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, tree, np.int32)), b.column(1), pa.array(code), b.column(0), b.column(2), b.column(4)], ["tree", "space", "code", "node", "vec", "length"])

    rows = nodes.select("node", "space", "vec", "bits", "length").mapInArrow(deal, "tree int, space long, code long, node long, vec binary, length int")
    size = rows.groupBy("tree", "space", "code").agg(F.count("*").alias("n"))  # hot buckets are dealt to parts of about BUCKET
    rows = rows.join(size, ["tree", "space", "code"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("n") / BUCKET).cast("long")))

    def closest(t: pa.Table) -> pa.RecordBatch | None:
        return _closest(t["node"].to_numpy(), matrix(t["vec"], t["length"]), LIST)

    return grouped(rows, columns, ["node", "vec", "length"], closest, "u long, v long, sim double")


def _closest(node: np.ndarray, x: np.ndarray, k: int) -> pa.RecordBatch | None:
    if len(node) < 2:
        return None
    s = x @ x.T
    np.fill_diagonal(s, -2)
    k = min(k, len(node) - 1)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    u = np.repeat(np.arange(len(node)), k)
    return pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[top.ravel()]), pa.array(s[u, top.ravel()])], ["u", "v", "sim"])


def shortened(edges: DataFrame, threshold: float) -> DataFrame:
    """The lists: the best LIST entries of each node, and further ones while all are links, up to MOST_LIST.
    edges: u, v, sim, fresh; an entry met again stays as old as it was."""
    best = Window.partitionBy("u").orderBy(F.col("sim").desc(), "v")
    met = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    return met.withColumn("r", F.row_number().over(best)).filter((F.col("r") <= LIST) | (F.col("r") <= MOST_LIST) & (F.col("sim") >= threshold)).drop("r")


def meetings(graph: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """u, v, sim: pairs of neighbours (and reverse ones) of a node, one of them fresh, that improve on a list or find room."""
    worst = F.when(F.count("*") < LIST, -2.0).when(F.count("*") < MOST_LIST, F.least(F.min("sim"), F.lit(threshold))).otherwise(F.min("sim"))
    bars = graph.groupBy("u").agg(worst.alias("worst")).select(F.col("u").alias("node"), "worst")
    both = graph.select("u", "v", "fresh").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh"))
    both = both.groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
    # a node in many lists has many reverse neighbours: they meet in parts
    degree = both.groupBy("u").agg(F.count("*").alias("n"), F.max("fresh").alias("any")).filter("any")
    both = both.join(degree.drop("any"), "u").withColumn("part", F.pmod(F.xxhash64("u", "v"), F.ceil(F.col("n") / MEETING).cast("long")))
    rows = both.select("u", "part", F.col("v").alias("node"), "fresh").join(nodes.select("node", "vec", "length"), "node").join(bars, "node", "left")

    def meet(t: pa.Table) -> pa.RecordBatch | None:
        fresh = t["fresh"].to_numpy()
        if not fresh.any():
            return None
        node, x, least = t["node"].to_numpy(), matrix(t["vec"], t["length"]), t["worst"].fill_null(-2.0).to_numpy()
        s = x @ x.T
        np.fill_diagonal(s, -2)
        s[np.ix_(~fresh, ~fresh)] = -2
        a, b = np.nonzero((s > least[:, None] + 1e-12) | (s >= threshold) & (least[:, None] == threshold))
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(s[a, b])], ["u", "v", "sim"])

    return grouped(rows, ["u", "part"], ["node", "vec", "length", "worst", "fresh"], meet, "u long, v long, sim double")


def descended(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The lists that NN-descent ends with, from a first graph (u, v, sim, fresh)."""
    graph = written(shortened(edges, threshold), "neighbours")
    while True:
        entries, fresh = graph.agg(F.count("*"), F.coalesce(F.sum(F.col("fresh").cast("long")), F.lit(0))).first()
        if fresh <= SETTLED * entries:
            return graph
        found = meetings(graph, nodes, threshold).withColumn("fresh", F.lit(True))
        after = written(shortened(graph.withColumn("fresh", F.lit(False)).unionByName(found), threshold), "neighbours")
        discard(graph)
        graph = after


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Enough of the edges a-b to connect what they connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = x = root[y]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            out.append((x, y))
    return out


def compared(members: DataFrame, threshold: float) -> DataFrame:
    """Asked nodes against all nodes of their space, by blocks: rows (node, near: number of nodes linked, links: sum of their
    `many`; for nodes that aren't asked, of asked ones only) and rows (a, b: roots that a link joins).
    members: space, node, length, vec, many, root, asked.

    The asked nodes and all nodes of a space are dealt to parts; each pair of parts is one block product."""
    size = members.groupBy("space").agg(F.count("*").alias("n"), F.count_if("asked").alias("m")).filter("m > 0")
    side = F.least(F.greatest(F.ceil(F.col("n") / 8), F.lit(LEAST_SIDE)), F.lit(MOST_SIDE))
    rows = members.join(size, "space").withColumns({"down": F.ceil(F.col("m") / side).cast("long"), "across": F.ceil(F.col("n") / side).cast("long")})
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    columns = ["node", "vec", "length", "many", "root", "asked"]
    rows = rows.filter("asked").select("space", own("down").alias("i"), each("across").alias("j"), *columns, F.lit(True).alias("row")).unionByName(
        rows.select("space", each("down").alias("i"), own("across").alias("j"), *columns, F.lit(False).alias("row")))

    def product(t: pa.Table) -> pa.RecordBatch | None:
        row = t["row"].to_numpy()
        a, b = np.flatnonzero(row), np.flatnonzero(~row)
        if not len(a) or not len(b):
            return None
        node, many, root, x = t["node"].to_numpy(), t["many"].to_numpy(), t["root"].to_numpy(), matrix(t["vec"], t["length"])
        other = ~t["asked"].to_numpy()[b]
        near, links, joins = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), [np.zeros((0, 2), np.int64)]
        for k in range(0, len(a), STRIP):
            s = a[k : k + STRIP]
            hit = (x[s] @ x[b].T >= threshold) & (node[s][:, None] != node[b])
            near[s] += hit.sum(1)
            links[s] += hit @ many[b]
            near[b] += hit.sum(0) * other
            links[b] += (many[s] @ hit) * other
            u, v = np.nonzero(hit & (root[s][:, None] != root[b]))
            if len(u):
                joins.append(np.array(forest(root[s][u], root[b][v]), np.int64))
        ends = np.array(forest(*np.concatenate(joins).T), np.int64).reshape(-1, 2)
        none = lambda n: pa.nulls(n, pa.int64())
        told = np.flatnonzero(row | (near > 0))
        cells = [(pa.array(c[told]), none(len(ends))) for c in (node, near, links)] + [(none(len(told)), pa.array(ends[:, k])) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in cells], ["node", "near", "links", "a", "b"])

    return grouped(rows, ["space", "i", "j"], [*columns, "row"], product, "node long, near long, links long, a long, b long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, embedding: str = "embedding", label: str = "label", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors."""
    rows = written(nodes_of(vectors, embedding, label, vec_id), "vectors")
    known = rows.filter("node is not null").groupBy("node").agg(F.first("space").alias("space"), F.first("length").alias("length"), F.first("vec").alias("vec"), F.count("*").alias("many"))
    spaces = known.groupBy("space").agg(F.count("*").alias("n"))
    bits = F.least(F.lit(39), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / (BUCKET / 2))))).cast("long")
    nodes = written(known.join(spaces, "space").withColumn("bits", bits), "nodes")
    old, kept = None, nodes.select("node").join(least_hashed(nodes.select("node"), AUDITED, "node").withColumn("audited", F.lit(True)), "node", "left")
    audited = written(kept.select("node", F.coalesce("audited", F.lit(False)).alias("audited")), "audited")
    for forests in range(FORESTS + 1):
        edges = projected(nodes, range(forests * TREES, (forests + 1) * TREES)).withColumn("fresh", F.lit(True))
        old = descended(edges if old is None else edges.unionByName(old.withColumn("fresh", F.lit(False))), nodes, threshold)
        found = old.filter(F.col("sim") >= threshold).select("u", "v")
        both = written(found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links", True)
        full = old.groupBy("u").agg((F.count_if(F.col("sim") >= threshold) >= MOST_LIST).alias("full")).filter("full").select(F.col("u").alias("node"), "full")
        known = nodes.join(components(both.toDF("a", "b")), "node", "left").join(full, "node", "left").join(audited, "node")
        known = written(known.select("space", "node", "length", "vec", "many", F.coalesce("root", "node").alias("root"), F.col("audited"), (F.coalesce("full", F.lit(False)) | F.col("audited")).alias("asked")), "rooted")
        pairs = written(compared(known, threshold), "compared")
        exact = pairs.filter("node is not null").groupBy("node").agg(F.sum("near").alias("near"), F.sum("links").alias("links"))
        listed = both.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("listed"))
        checked = known.filter("audited").join(full, "node", "left_anti").join(exact, "node").join(listed, "node", "left")
        true, seen = checked.agg(F.sum("near"), F.sum(F.coalesce("listed", F.lit(0)))).first()
        if not true or seen >= RECALL * true:
            break
    else:
        known = known.withColumn("asked", F.lit(True))
        pairs = written(compared(known, threshold), "compared")
        exact = pairs.filter("node is not null").groupBy("node").agg(F.sum("near").alias("near"), F.sum("links").alias("links"))
    # links between nodes that weren't asked come from the lists, all others from the blocks
    plain = known.filter("not asked").select("node", "many")
    listed = both.join(plain.select(F.col("node").alias("u")), "u").join(plain.select(F.col("node").alias("v"), "many"), "v").groupBy(F.col("u").alias("node")).agg(F.sum("many").alias("listed"))
    joins = components(pairs.filter("a is not null").select("a", "b")).select(F.col("node").alias("root"), F.col("root").alias("joined"))
    known = known.select("node", "many", "root").join(exact.select("node", "links"), "node", "left").join(listed, "node", "left").join(joins, "root", "left")
    links = F.coalesce("links", F.lit(0)) + F.coalesce("listed", F.lit(0))
    out = rows.select("id", "node").join(known.select("node", "many", links.alias("links"), F.coalesce("joined", "root").alias("root")), "node", "left")
    least = out.filter("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    out = out.join(least, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least"))
    n = F.coalesce("many", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))
    return out.select(F.col("id").alias("vec_id"), n.cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings at a cosine of 0.93 within a label."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))
