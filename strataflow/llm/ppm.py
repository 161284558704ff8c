"""Operator 4: language-model scoring by prediction by partial matching.

A text is its words (A-Z in lower case), a space byte after each, then one end byte (10). The model is a byte-context trie
of depth ORDER, held as counts of (context, byte) over all training texts, so every order's counts are its marginals.
A byte is coded in its longest known context: p = (2c - 1) / 2n, with escape d / 2n to the next shorter one (d: distinct
bytes, n: their count), where bytes of longer contexts are excluded from c's competitors; after order 0 the bytes never
seen share what is left. Training is in one pass over all training texts; the model is then fixed (pretrained).

Words are told apart by 64-bit hashes. Nothing grows with the corpus on one machine: counts are grouped by key, code lengths
are worked out apart for each three-byte context ending (only orders 0 to 2, at most 16,843,008 counts, go to every task),
and a block of documents (BLOCK rows of a partition) gets just the code lengths and word counts that occur in it, by a
co-group.

Cases: null and empty texts are the end alone; very long texts count whole; repeated rows score alike; without any training
text all bytes are equally likely and every token is unknown; other columns are ignored; an empty table gives an empty
result. A block must hold the same rows each time it is read. Rows that don't come from files as they are get written
first; should a block meet another one's table all the same, its unknown bytes or words stop the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_AZ, crc_mod, read, written
from .shingles import word_spans

ORDER, END = 5, 10
#: Bytes of a context and the byte after it, the last in the low bits.
_GRAM = (1 << 8 * (ORDER + 1)) - 1
#: Text bytes whose grams are sorted at a time; rows of a block; grams whose code lengths are worked out at a time.
_STRETCH = 1 << 20
BLOCK = 1 << 13
_GRAMS = 1 << 18
#: Bytes of a context's ending that tasks are dealt by; the orders below are held by every task.
_ENDING = 3


def coded(text: str | None) -> bytes:
    words = (text or "").encode().translate(LOWER_AZ).split()
    return b"".join((b" ".join(words), b" " if words else b"", bytes((END,))))


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of the coded texts and 0 for each end, in order; tokens of each text)."""
    data = b"".join(texts)
    words, start, _ = word_spans(data)
    end = np.cumsum([len(t) for t in texts]) - 1
    at = np.concatenate([start, end])
    order = np.argsort(at, kind="stable")
    out = np.concatenate([words.view(np.int64), np.zeros(len(texts), np.int64)])[order]
    last = np.flatnonzero(order >= len(words))
    return out, np.diff(np.concatenate([[-1], last]))


def grams_of(texts: list[bytes]) -> np.ndarray:
    """For every byte of the coded texts, in order: it and its context; before a text stand end bytes."""
    pad = bytes((END,)) * ORDER
    x = np.frombuffer(b"".join(y for t in texts for y in (pad, t)), np.uint8).astype(np.int64)
    g = x[: len(x) - ORDER].copy()
    for k in range(1, ORDER + 1):
        g <<= 8
        g |= x[k : len(x) - ORDER + k]
    size = np.array([len(t) + ORDER for t in texts])
    inside = np.ones(len(g), bool)
    for at in np.cumsum(size)[:-1]:
        inside[at - ORDER : at] = False
    return g[inside]


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams.sort()
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, int)
    return grams[first], np.diff(np.append(first, len(grams)))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[1] for p in parts])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def stretches(texts: list[str | None]) -> Iterator[list[bytes]]:
    """The coded texts in lists of about _STRETCH bytes."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        held.append(coded(t))
        size += len(held[-1])
        if size >= _STRETCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def counts(docs: DataFrame) -> DataFrame:
    """Of docs with text, train, block (ascending in a partition): block, word, key, n.

    key: of a word its hash (0: the end), else a gram; n: how often in training."""

    def table(block: int, parts: tuple[list, list]) -> Iterator[pa.RecordBatch]:
        for k, part in enumerate(parts):
            if part:
                key, n = _added(part)
                for at in range(0, len(key), 200_000):
                    m = len(key[at : at + 200_000])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block, np.int64)), pa.array(np.full(m, bool(k))), pa.array(key[at : at + m]), pa.array(n[at : at + m])], ["block", "word", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: tuple[list, list] = ([], [])  # of grams, of words
        block = None
        for whole in batches:
            blocks = whole.column(2).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)] if len(blocks) else []
            for x, y in zip(cut[:-1], cut[1:]):
                if block is not None and block != blocks[x]:
                    yield from table(block, parts)
                    parts = ([], [])
                block, b = int(blocks[x]), whole.slice(x, y - x)
                train = np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool)
                for use in (False, True):
                    for texts in stretches(b.column(0).filter(pa.array(train == use)).to_pylist()):
                        for k, values in enumerate((grams_of(texts), tokens_of(texts)[0])):
                            key, n = _counted(values)
                            parts[k].append((key, n if use else np.zeros(len(n), np.int64)))
                            if len(parts[k]) >= 16:
                                parts[k][:] = [_added(parts[k])]
        if block is not None:
            yield from table(block, parts)

    return docs.select("text", "train", "block").mapInArrow(run, "block long, word boolean, key long, n long")


def _level(gram: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) of that order with training counts, from grams seen in training."""
    return _added([(gram & ((1 << 8 * (order + 1)) - 1), n)]) if len(gram) else (gram, n)


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values of the wanted keys (ascending keys), 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[k] == wanted, values[k], 0)


def code_lengths(gram: np.ndarray, n: np.ndarray, low: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 of the probability of each gram's last byte after its context.

    gram, n: all grams (n 0: not in training) whose contexts end alike in as many bytes as `low` has orders; low: counts
    of the orders below that."""
    seen = n > 0
    levels = {j: low.get(j) or _level(gram[seen], n[seen], j) for j in range(ORDER + 1)}
    out, open_ = np.zeros(len(gram)), np.ones(len(gram), bool)
    above = None  # of the next longer context: (contexts, distinct bytes, their count one order lower)
    for j in range(ORDER, -1, -1):
        pair, c = levels[j]
        context, distinct = np.unique(pair >> 8, return_counts=True)
        total = np.add.reduceat(c, np.searchsorted(pair >> 8, context)) if len(pair) else np.zeros(0, np.int64)
        mine = gram & ((1 << 8 * (j + 1)) - 1)
        left, kinds = _at(context, total, mine >> 8), _at(context, distinct, mine >> 8)
        if above is not None:
            longer = (gram & ((1 << 8 * (j + 2)) - 1)) >> 8
            left, kinds = left - _at(above[0], above[2], longer), kinds - _at(above[0], above[1], longer)
        hit = _at(pair, c, mine)
        done, escape = open_ & (hit > 0), open_ & (hit == 0) & (kinds > 0)
        out[done] += np.log10((2 * hit[done] - 1) / (2 * left[done]))
        out[escape] += np.log10(kinds[escape] / (2 * left[escape]))
        open_ &= hit == 0
        if j:
            lower_pair, lower_c = levels[j - 1]
            shared = _at(lower_pair, lower_c, pair & ((1 << 8 * j) - 1))
            above = (context, distinct, np.add.reduceat(shared, np.searchsorted(pair >> 8, context)) if len(pair) else np.zeros(0, np.int64))
    rest = 256 - len(levels[0][0])
    out[open_] += np.log10(1 / max(1, rest))
    return out


def model(grams: DataFrame) -> DataFrame:
    """key, value: the log10 probability of each gram of key, n (sums of training counts, one row a gram)."""
    low = {}
    for j in range(_ENDING):  # at most 256, 65,536 and 16,777,216 rows
        rows = grams.filter("n > 0").groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1)).alias("pair")).agg(F.sum("n").alias("n")).toArrow()
        order = np.argsort(rows["pair"].to_numpy())
        low[j] = (rows["pair"].to_numpy()[order], rows["n"].to_numpy()[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # whole endings, then those of the last one so far
        have = 0

        def done(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(code_lengths(key, n, low))], ["key", "value"])

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            have += b.num_rows
            if have < _GRAMS:
                continue
            key, n = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            ending = key >> 8 & ((1 << 8 * _ENDING) - 1)
            cut = int(np.argmax(ending == ending[-1]))  # equal endings stand together
            if cut:
                yield done(key[:cut], n[:cut])
            held, have = [(key[cut:], n[cut:])], len(key) - cut if cut else 0
        if held:
            yield done(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))

    ending = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * _ENDING) - 1))
    parts = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = grams.select("key", "n", ending.alias("ending")).repartition(parts, "ending").sortWithinPartitions("ending")
    return rows.select("key", "n").mapInArrow(run, "key long, value double")


def bundled(rows: DataFrame) -> DataFrame:
    """block, word, keys, values (bytes of arrays): the rows of a task for one block at a time, as few rows as may be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, word, key, value = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            group = block.astype(np.int64) * 2 + word.astype(np.int64)
            order = np.argsort(group, kind="stable")
            group, key, value = group[order], key[order], value[order]
            cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            if len(group):
                first = group[cut[:-1]]
                bundle = [pa.array([x[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])], pa.binary()) for x in (key, value)]
                yield pa.RecordBatch.from_arrays([pa.array(first >> 1), pa.array((first & 1).astype(bool)), *bundle], ["block", "word", "keys", "values"])

    return rows.select("block", "word", "key", "value").mapInArrow(run, "block long, word boolean, keys binary, values binary")


class Lookup:
    """Code lengths by gram: a table by hash, and a sorted search for grams whose place another one has."""

    def __init__(self, gram: np.ndarray, code: np.ndarray):
        order = np.argsort(gram)
        self.gram, self.code = gram[order], code[order]
        self.bits = max(10, int(len(gram) * 2).bit_length())
        self.key, self.value = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        at = self._place(self.gram)
        self.key[at], self.value[at] = self.gram, self.code

    def _place(self, gram: np.ndarray) -> np.ndarray:
        return ((gram.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def __call__(self, gram: np.ndarray) -> np.ndarray:
        at = self._place(gram)
        out = self.value[at]
        other = np.flatnonzero(self.key[at] != gram)
        if len(other):
            place = np.minimum(np.searchsorted(self.gram, gram[other]), len(self.gram) - 1)
            if not len(self.gram) or (self.gram[place] != gram[other]).any():
                raise ValueError("a block has rows that its table wasn't made from")
            out[other] = self.code[place]
        return out


def scores(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", settled: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, learning from rows that aren't held out.

    settled: docs are read from files as they are, so a partition has the same rows each time; else they are written first."""
    kind = docs.schema[doc_id].dataType.simpleString()
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out"))
    docs = docs if settled else written(docs, "ppm-docs")
    # partition and row number, so a block is BLOCK rows of one partition
    docs = docs.withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK).cast("long"))
    rows = written(counts(docs.select("text", (~F.col("held_out")).alias("train"), "block")), "ppm-counts")
    totals = written(rows.groupBy("word", "key").agg(F.sum("n").alias("n")), "ppm-totals")
    total, distinct = totals.filter("word and n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    codes = model(totals.filter("not word").select("key", "n")).withColumn("word", F.lit(False))
    values = written(codes.unionByName(totals.filter("word").select("key", F.col("n").cast("double").alias("value"), "word")), "ppm-values")
    mine = bundled(rows.select("block", "word", "key").join(values, ["word", "key"]))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(part: pa.Table, known: pa.Table) -> pa.Table:
        word, lookup = known["word"].to_numpy(), []
        for kind_ in (False, True):
            keys, values_ = (known[c].filter(pa.array(word == kind_)) for c in ("keys", "values"))
            lookup.append(Lookup(*(np.frombuffer(b"".join(v.as_buffer() for v in x), t) for x, t in ((keys, np.int64), (values_, float)))))
        n_tokens, n_known, base, score = [], [], [], []
        per_token = np.log10(total + distinct + 1)
        for batch in part.select(["text"]).to_batches():
            for texts in stretches(batch.column(0).to_pylist()):
                code = lookup[0](grams_of(texts))
                score.append(np.add.reduceat(code, np.cumsum([0, *map(len, texts[:-1])])))
                tokens, each = tokens_of(texts)
                c, at = lookup[1](tokens), np.cumsum([0, *each[:-1]])
                n_tokens.append(each)
                n_known.append(np.add.reduceat((c > 0).astype(np.int64), at))
                base.append(np.add.reduceat(np.log10(c + 1), at) - each * per_token)
        columns = [np.concatenate([np.zeros(0, t), *x]).astype(t) for x, t in ((n_tokens, np.int64), (n_known, np.int64), (base, float), (score, float))]
        return pa.table([part["doc_id"], part["held_out"], pa.array(columns[0]), pa.array(columns[1]), pa.array(np.full(part.num_rows, total, np.int64)), pa.array(columns[2]), pa.array(columns[3])], names)

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(run, schema)


def op4_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of six sevenths of them."""
    docs = read(spark, sf_dir, "documents")
    return scores(docs, crc_mod(F.col("doc_id"), 7) == 2, settled=True)
