"""Operator 7: packing by patterns, fitted with non-negative least squares.

Documents become token sequences with an end id; only those longer than a sequence are cut. What matters for packing
is the histogram of lengths (at most `capacity` numbers), so packing is solved on the driver on it alone: patterns
of one to three lengths that fill a sequence are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares, rounded within what is there, and the residual counts are packed by best fit, longest first,
also by counts. Each piece then finds its place by its rank among the pieces of its length.

Cases: null and empty texts are the end id alone; equal rows and null ids are packed like any other; an empty table gives
an empty result; a text of any length is cut into full sequences, the first piece taking the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import read, written

CAPACITY, END_ID = 1024, 2
#: Rows of one length that are ranked together; rows of one length can be most of the input.
RANKED = 1 << 16
#: Two-length patterns may leave so many tokens free; three-length patterns fill the sequence.
SLACK = 8
#: Texts over so many characters go through the streaming encoder.
WHOLE = 1 << 20


class FastIds:
    """Ids as the vocabulary's own library gives them: a native BPE over the same merges where ids rank them."""

    def __init__(self, path: str | None = None):
        self.path, self.native = path or bpe.default_vocabulary(), None
        v = bpe.encoder(self.path).vocabulary
        new = [i for _, i in v.merges.values()]
        if new == sorted(new) and all(i >= 256 for i in new) and sorted(v.byte_id) == list(range(256)):
            import tiktoken

            special = set(v.added.values())
            ranks = {b: i for i, b in enumerate(v.bytes_of) if i not in special and b}
            self.native = tiktoken.Encoding("packing", pat_str=bpe.encoder(self.path).pattern.pattern, mergeable_ranks=ranks, special_tokens=v.added)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.native is None or len(text) > WHOLE:
            return np.array(bpe.encoder(self.path).encode(text), "<u4")
        return self.native.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


def cut(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = FastIds(path), np.array([end_id], "<u4")
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, t in enumerate(b.column(1)):
                ids = np.concatenate([ids_of(t.as_py()), end])
                first = len(ids) % capacity or capacity
                for p, at in enumerate((0, *range(first, len(ids), capacity))):
                    x = ids[at : first if p == 0 else at + capacity]
                    row.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(len(x))
                    crc.append(zlib.crc32(x.tobytes()))
            ids = b.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names)

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pairs(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns of one or two lengths that fill a sequence, a row each of three descending lengths (0: none)."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    a = lengths[(2 * lengths >= capacity) & (lengths < capacity)]
    a = a[there[capacity - a]]
    return np.stack([a, capacity - a, np.zeros_like(a)], 1)


def triples(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns of three lengths that fill a sequence, and of two that leave up to SLACK tokens free."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    out = []
    for free in range(SLACK + 1):
        a = lengths[(2 * lengths >= capacity - free) & (lengths < capacity - free)]
        a = a[there[capacity - free - a]]
        out.append(np.stack([a, capacity - free - a, np.zeros_like(a)], 1))
    a, b = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
    c = capacity - a - b
    ok = (a >= b) & (c >= 1) & (c <= b)
    a, b, c = a[ok], b[ok], c[ok]
    ok = there[c]
    return np.concatenate([*out, np.stack([a[ok], b[ok], c[ok]], 1)])


def fit(found: np.ndarray, counts: np.ndarray, rounds: int = 1000, width: int = 96) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns, of least squared distance between what they use and counts.

    An active-set method: patterns that the residual asks for most, with lengths apart, become free together; those
    that the least-squares solution over the free ones makes negative leave again. It ends when no pattern that isn't free
    has a gradient over half a document (the free ones have none), which is the condition of the optimum."""
    x, free = np.zeros(len(found)), np.zeros(len(found), bool)
    if not len(found):
        return x
    for _ in range(rounds):
        rest = counts - np.bincount(found.ravel(), np.repeat(x, 3), len(counts))
        rest[0] = 0
        gradient = rest[found].sum(1)
        gradient[free] = 0
        order, used, new = np.argsort(-gradient, kind="stable")[: 40 * width], set(), 0
        for p in order:
            if gradient[p] <= 0.5 or new >= width:
                break
            if used.isdisjoint(found[p][found[p] > 0]):
                used.update(found[p][found[p] > 0])
                free[p] = True
                new += 1
        if not new:
            break
        for _ in range(20):
            k = np.flatnonzero(free)
            a = np.zeros((len(counts), len(k)))
            for column in range(3):
                np.add.at(a, (found[k, column], np.arange(len(k))), 1)
            a[0] = 0
            gram = a.T @ a
            gram[np.diag_indices(len(k))] += 1e-6
            s = np.linalg.solve(gram, a.T @ counts)
            if (s > 0).all():
                x[:] = 0
                x[k] = s
                break
            bad = s <= 0
            step = min(1.0, float(np.min(x[k][bad] / np.maximum(x[k][bad] - s[bad], 1e-12)))) if bad.any() else 1.0
            y = x[k] + step * (s - x[k])
            y[bad & (y <= 1e-9)] = 0
            x[:] = 0
            x[k] = np.maximum(y, 0)
            free[k[bad & (x[k] <= 1e-9)]] = False
    return x


def pack_histogram(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that together use the histogram exactly."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []
    if counts[capacity]:
        plan.append(((capacity,), int(counts[capacity])))
        counts[capacity] = 0
    for kind in (pairs, triples):  # the second fit is to what the first, of patterns that don't overlap, leaves
        found = kind(np.flatnonzero(counts), capacity)
        x = fit(found, counts.astype(float))
        for p in np.argsort(-x, kind="stable"):
            want = int(np.floor(x[p] + 0.5))
            if want < 1:
                break
            lengths = tuple(int(v) for v in found[p] if v)
            many = min(want, *(int(counts[v]) // lengths.count(v) for v in lengths))
            if many > 0:
                plan.append((lengths, many))
                for v in lengths:
                    counts[v] -= many
    return plan + best_fit(counts, capacity)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: sequences alike are handled together."""
    bins: list[list[list]] = [[] for _ in range(capacity + 1)]  # by free tokens: [lengths, how many]
    for length in range(capacity, 0, -1):
        n = int(counts[length])
        while n:
            free = next((f for f in range(length, capacity) if bins[f]), capacity)
            lengths, many = bins[free].pop() if free < capacity else ((), n)
            each = free // length
            full = min(many, n // each)
            if full:
                bins[free - each * length].append([lengths + (length,) * each, full])
                n -= full * each
                many -= full
            if many and n and n < each:
                bins[free - n * length].append([lengths + (length,) * n, 1])
                n, many = 0, many - 1
            if many and free < capacity:
                bins[free].append([lengths, many])
    return [(lengths, many) for group in bins for lengths, many in group]


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each pattern and length in it: ranks from `lo` on of that length go to its sequences, `each` to one."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for lengths, many in plan:
        at = np.concatenate([[0], np.cumsum(lengths)])
        for v in sorted(set(lengths)):
            offsets = [int(at[k]) for k, w in enumerate(lengths) if w == v]
            rows.append((v, rank.get(v, 0), base, len(offsets), offsets[0]))
            rank[v] = rank.get(v, 0) + many * len(offsets)
        base += many
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "lo", "base", "each", "offset"), table.T))


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """cut() with sequence_id and offset."""
    pieces = written(cut(docs, capacity, end_id, path, text, doc_id), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    where = places(pack_histogram(histogram, capacity))
    full = pieces.filter(F.col("length") == capacity)
    full = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = pieces.filter(F.col("length") < capacity)
    parts = [max(1, -(-histogram.get(n, 0) // RANKED)) for n in range(capacity + 1)]
    rest = rest.withColumn("__b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(F.lit(parts), F.col("length").cast("int"))).cast("int"))
    counts = rest.groupBy("length", "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__s", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    if sum(parts) <= 1 << 20:  # a row for each part
        counts = F.broadcast(counts)
    order = Window.partitionBy("length", "__b").orderBy("doc_id", "piece", "ids_crc32", "start")
    rest = rest.withColumn("__r", F.row_number().over(order)).join(counts, ["length", "__b"])
    rest = rest.withColumn("rank", F.col("__s") + F.col("__r") - 1).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    keys = (where["length"] << 44) + where["lo"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (np.asarray(b.column(k)) for k in (3, 5))
            k = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            inside = rank - where["lo"][k]
            sequence = where["base"][k] + inside // where["each"][k]
            offset = where["offset"][k] + inside % where["each"][k] * length  # equal lengths stand side by side
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return rest.mapInArrow(run, schema).unionByName(full)


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack(read(spark, sf_dir, "documents"))
