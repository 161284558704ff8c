"""Operator 8: resharding by minimum-cost flow.

Shards have sizes in bytes and new shards have capacities; the flow from old to new shards that fits the
capacities and moves the fewest bytes is found on the driver, over shard totals only. Each flow becomes an interval of
its old shard's bytes, cut into blocks (hash buckets); whole blocks lie inside one interval, and only the documents
of the few cut blocks are told apart one by one. A second flow over small documents then evens out what the
granularity of documents left over.

Cases: null text counts 1 byte; null ids are rows like any other; equal rows are dealt independently, and where there are more
than HOT of them they go to as many blocks as others do, by their place in the input, so that no task holds them all; an
empty table gives an empty result; a document larger than a shard's capacity goes whole to one shard.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, read, written

#: Blocks of one shard, or more of them, so that one has about DOCS_A_BLOCK documents at most. The driver holds a total a
#: block: shards x BLOCKS numbers up to 10^9 documents, one for each 131,072 documents beyond.
BLOCKS, DOCS_A_BLOCK = 1024, 1 << 20
#: Equal rows beyond which they are told apart by their place in the input.
HOT = 10_000
#: Size classes of the second flow: documents of one class are within 64 bytes, larger ones share the last.
CLASSES = 64


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[int]]) -> list[list[int]]:
    """flow[i][j] of least total cost that ships every supply; sum(capacity) must be at least sum(supply).

    Successive shortest augmenting paths over the bipartite graph with residual arcs (label-correcting search,
    since residual costs can be negative). Costs are per unit."""
    n, m = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("the new shards can't hold the old ones")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        # nodes 0..n-1: old shards, n..n+m-1: new shards
        dist: list[float] = [0.0 if left[i] else float("inf") for i in range(n)] + [float("inf")] * m
        back, queue = [-1] * (n + m), deque(i for i in range(n) if left[i])
        queued = set(queue)
        while queue:
            u = queue.popleft()
            queued.discard(u)
            steps = [(n + j, cost[u][j]) for j in range(m)] if u < n else [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
            for v, c in steps:
                if dist[u] + c < dist[v]:
                    dist[v], back[v] = dist[u] + c, u
                    if v not in queued:
                        queue.append(v)
                        queued.add(v)
        end = min((j for j in range(m) if room[j]), key=lambda j: dist[n + j])
        path, v = [n + end], n + end
        while back[v] >= 0:
            v = back[v]
            path.append(v)
        path.reverse()
        push = min(left[path[0]], room[end], *(flow[b][a - n] for a, b in zip(path, path[1:]) if a >= n), left[path[0]])
        for a, b in zip(path, path[1:]):
            if a < n:
                flow[a][b - n] += push
            else:
                flow[b][a - n] -= push
        left[path[0]] -= push
        room[end] -= push
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def _block_starts(rows, key: str) -> dict:
    """(shard, block) -> what lies before it in its shard."""
    starts, at = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        starts[r[0], r[1]] = at.get(r[0], 0)
        at[r[0]] = at.get(r[0], 0) + r[key]
    return starts


def _flowed(docs: DataFrame, old: str, block: Column, new: str, capacities: Sequence[int] | None, shards: int) -> DataFrame:
    """docs (with size, order key) and `new`: the shard by one flow from shards `old`, blocks taken in ascending order."""
    spark = docs.sparkSession
    docs = docs.withColumn("__b", block)
    rows = docs.groupBy(old, "__b").agg(F.sum("size").alias("bytes")).collect()  # at most shards x blocks
    supply: dict[int, int] = {}
    for r in rows:
        supply[r[0]] = supply.get(r[0], 0) + r["bytes"]
    olds = sorted(supply)
    caps = list(capacities) if capacities else equal_capacities(sum(supply.values()), shards)
    flow = min_cost_flow([supply[i] for i in olds], caps, [[int(i != j) for j in range(shards)] for i in olds])
    ends = []
    for k, i in enumerate(olds):
        at = 0
        for j in sorted(range(shards), key=lambda j: (j == i, j)):  # movers first, what stays last
            if flow[k][j]:
                ends.append((i, at, at + flow[k][j], j))
                at += flow[k][j]
        ends[-1:] = [(*ends[-1][:2], 1 << 62, ends[-1][3])]
    starts = _block_starts(rows, "bytes")
    at = spark.createDataFrame([(i, b, s) for (i, b), s in starts.items()], "__i int, __b int, __s long")
    parts = spark.createDataFrame([(i, [x[1:] for x in ends if x[0] == i]) for i in olds], "__i int, __cuts array<struct<lo:long,hi:long,to:int>>")
    order = Window.partitionBy(old, "__b").orderBy("key", "doc_id", "text_crc32", "size", "row")
    mid = F.col("__s") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.floor(F.col("size") / 2)
    docs = docs.join(F.broadcast(at.withColumnRenamed("__i", old)), [old, "__b"]).join(F.broadcast(parts.withColumnRenamed("__i", old)), old)
    hit = F.filter("__cuts", lambda c: (c["lo"] < F.col("__m")) & (F.col("__m") <= c["hi"]))
    return docs.withColumn("__m", mid).withColumn(new, F.get(hit, F.lit(0))["to"]).drop("__s", "__m", "__cuts", "__b")


def salted(rows: DataFrame, key: str, place: str) -> DataFrame:
    """rows whose key also hangs on their place where more than HOT of them share it (the few such keys are counted first)."""
    hot = rows.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > HOT).select(F.col(key).alias("__hot"))
    return rows.join(hot, F.col(key) == F.col("__hot"), "left").withColumn(key, F.when(F.col("__hot").isNull(), F.col(key)).otherwise(F.xxhash64(key, place))).drop("__hot")


def reshard(docs: DataFrame, old_shard: Column, shards: int = 8, capacities: Sequence[int] | None = None, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot (gapless in its shard), moved: one row for each row of docs.

    old_shard: int column with values from 0; capacities: bytes of the new shards (equal by default); row: a column that
    numbers the rows, carried along as `row` (by default their places as read)."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), old_shard.cast("int").alias("old_shard"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row"))
    slim = written(slim.withColumn("key", F.xxhash64("doc_id", "text_crc32", "size")), "reshard-docs")
    total = slim.count()
    blocks = max(BLOCKS, -(-total // DOCS_A_BLOCK))
    if not total:
        return slim.select("doc_id", "size", "text_crc32", "old_shard", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(False).alias("moved"), *(["row"] if row else []))
    slim = salted(slim, "key", "row")
    hashed = F.pmod("key", F.lit(blocks)).cast("int")
    first = written(_flowed(slim, "old_shard", hashed, "__first", capacities, shards), "reshard-flow")
    bySize = (F.least(F.floor(F.col("size") / 64), F.lit(CLASSES - 1)) * blocks + F.pmod("key", F.lit(max(CLASSES, blocks // CLASSES)))).cast("int")
    done = written(_flowed(first, "__first", bySize, "shard", capacities, shards), "reshard-even")
    done = done.withColumn("__b", hashed)
    counts = done.groupBy("shard", "__b").agg(F.count("*").alias("n")).collect()  # at most shards x blocks
    at = docs.sparkSession.createDataFrame([(s, b, n) for (s, b), n in _block_starts(counts, "n").items()], "shard int, __b int, __s long")
    order = Window.partitionBy("shard", "__b").orderBy("key", "doc_id", "text_crc32", "size", "old_shard", "row")
    out = done.join(F.broadcast(at), ["shard", "__b"]).withColumn("slot", F.col("__s") + F.row_number().over(order) - 1)
    return out.select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot", (F.col("old_shard") != F.col("shard")).alias("moved"), *(["row"] if row else []))


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows and __k: 1, 2, ... for those of equal key, which no task needs to hold together: parts of more than HOT equal ones are
    numbered apart, each from where the parts before it end. rows is read more than once, in the same order."""
    rows = rows.withColumn("__at", F.monotonically_increasing_id())
    rows = salted(rows.withColumn("__part", F.col(key)).withColumn("__at", F.pmod("__at", F.lit(1024))), "__part", "__at")
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.filter(F.col("__part") != F.col(key)).groupBy(key, "__part").agg(F.count("*").alias("__n")).withColumn("__s", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    parts = parts.select("__part", "__s")  # at most 1024 rows a hot key
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(key, "__part").orderBy(F.lit(0))))
    return rows.join(parts, "__part", "left").withColumn("__k", F.col("__r") + F.coalesce("__s", F.lit(0))).drop("__at", "__part", "__r", "__s")


def rewrite_affected(docs: DataFrame, placed: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", old_shard: Column | None = None, row: str | None = None) -> list[int]:
    """Write the shards that gain or lose documents to path/shard=N; the rest stay untouched.

    Returns the shards written. placed: of reshard(). Rows meet by `row`, the column of docs that numbered them, where given;
    else rows of one id are told apart by their texts, equal ones by old_shard, which is needed where they may stand in several
    old shards with other columns that differ. docs may be the files at path itself."""
    moved = placed.filter("moved").select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct()
    touched = sorted(r[0] for r in moved.collect())  # at most the number of shards
    to = placed.filter(F.col("shard").isin(touched))
    keep = [c for c in docs.columns if c != "shard"]
    if row:
        rows = docs.select(*keep).join(to.select(F.col("row").alias("__placed"), "shard"), F.col(row) == F.col("__placed"))
    else:
        body = F.coalesce(F.col(text), F.lit("")).cast("binary")
        mine, theirs = [F.col(doc_id), (F.octet_length(body) + 1).cast("long"), F.crc32(body)], [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
        if old_shard is not None:
            mine, theirs = [*mine, old_shard.cast("int")], [*theirs, F.col("old_shard")]
        every = _numbered(placed.select(F.xxhash64(*theirs).alias("__h"), "shard"), "__h").filter(F.col("shard").isin(touched))
        rows = _numbered(docs.select(*keep, F.xxhash64(*mine).alias("__h")), "__h").join(every, ["__h", "__k"])
    path = path or fresh_path(docs.sparkSession, "shards")
    filled = {r[0] for r in to.select("shard").distinct().collect()}
    if filled:
        # dynamic: only the shards that rows go to are replaced
        rows.select(*keep, "shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("shard").parquet(path)
    for emptied in set(touched) - filled:
        docs.select(*keep).limit(0).write.mode("overwrite").parquet(f"{path}/shard={emptied}")
    return touched


def resharded_files(docs: DataFrame, old_shard: Column, shards: int = 8) -> DataFrame:
    """The columns of reshard(), for the rows of a layout in files: docs are laid out by old_shard, then only the affected shards
    are rewritten in place, and all rows are read back with the shard that they lie in. The layout's rows carry a number."""
    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "shards")
    laid = docs.drop("shard").withColumns({"__row": F.monotonically_increasing_id(), "__old": old_shard.cast("int"), "shard": old_shard.cast("int")})
    laid.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    layout = lambda: spark.read.schema(laid.schema).parquet(path)  # noqa: E731  (its files change)
    placed = written(reshard(layout(), F.col("__old"), shards, row="__row"), "placed")
    rewrite_affected(layout(), placed, path, row="__row")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    found = layout().select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.col("__old").alias("old_shard"), "shard", "__row")
    return found.join(placed.select(F.col("row").alias("__row"), "slot", "moved"), "__row", "left").drop("__row")


def op8_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, laid out by source in 8 uneven shards, resharded to equal bytes; rows as read from the rewritten files."""
    docs = read(spark, sf_dir, "documents")
    old = F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")) % 8
    out = resharded_files(docs, old, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")
