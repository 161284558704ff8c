"""Operator 12: phrase collocations, counted by Aho-Corasick automata over candidates from a sketch.

Texts are normalised once: A-Z lower-cased, words between single spaces, pieces between guards (" a b . c d "; no word holds
the guard, which is a delimiter itself), the texts of a language joined to rows of about CHUNK bytes. A longer text is cut
between words; each row but the last repeats the OVERLAP words that follow it, and a row of weight -1 with just those takes
their second count back.

1. A count sketch (one row of counters, about one a word, at most 2^MOST_BITS) over the hashes of all words and phrases gives
   upper bounds: what falls into a counter below the least count can't be frequent. Counters are summed by Spark, block by
   block, and only one bit each (count reached or not) travels to the tasks: at most 2^MOST_BITS / 8 bytes. Beyond as many words
   the bounds get looser and the candidates more; the result stays exact.
2. A second pass gathers the distinct candidates (phrases whose bit is set, and those of all words and phrases within) and
   counts the words whose bit is set.
3. Candidates of a language are dealt to shards of about MOST_PATTERNS by a hash of their first two words. Every text sends each
   shard only the runs of words in which one of its candidates can start (so no word goes to more than three shards), and each
   part of about BLOCK bytes of them is scanned by the shard's automaton, whose patterns are guarded by the delimiter on both
   sides; overlapping matches share it. Counts are summed, then the thresholds apply.

Cases: null and empty texts add nothing; a null language is `und`; repeated rows count again, whatever their ids; very long
texts are cut as above; other columns are ignored; ties are broken by the phrase in UTF-8 order; an empty table gives an
empty result. Products are exact up to 38 digits (counts up to 10^15). Within a row of a task phrases are told apart by 64 bits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import compress
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, mix64, read, written

CHUNK, OVERLAP = 1 << 17, 2
#: Rows and bytes that a task hands to Python at once, rows that it reads at once; parts of a language whose best phrases are
#: ranked apart.
ROWS, BYTES_AT_ONCE, ROWS_READ, PARTS = 256, 4 << 20, 32, 64
#: The size of a page is looked at after so many rows (by default 100 at least, 13 MB of pieces).
PAGES = {f"parquet.page.size.row.check.{k}": 8 for k in ("min", "max")}
#: The number of counters is a power of two between these; they are summed in 2^BLOCKS blocks.
LEAST_BITS, MOST_BITS, BLOCKS = 18, 30, 8
#: Phrases and words of a task between two emissions; bits of the places where it remembers candidates.
SLAB, WORDS, MET = 1 << 22, 1 << 17, 21
#: Patterns of an automaton; bytes that it scans in a task; bytes from which a task gathers candidates (a task tells each once).
MOST_PATTERNS, BLOCK, GATHER = 50_000, 12 << 20, 128 << 20
GUARD = b"."
#: Bytes as normal texts have them: A-Z lower-cased, the tab a space, every delimiter the guard.
BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else GUARD[0] if b in b".,;:!?" or 10 <= b <= 13 else b for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Words and guards."""
    return (text or "").encode().translate(BYTES).replace(GUARD, b" . ").split()


def slices(words: list[bytes], size: int) -> Iterator[tuple[list[bytes], int]]:
    """(words, weight): slices of about `size` bytes whose weighted counts are those of the whole."""
    ends = np.cumsum([len(w) + 1 for w in words])
    a = 0
    while True:
        z = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size)) + 1
        if z >= len(words):
            yield words[a:], 1
            return
        yield words[a : z + OVERLAP], 1
        yield words[z : z + OVERLAP], -1
        a = z


def prepared(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, text (normal, a space at both ends), weight, words (their number), size (bytes of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: Counter[str] = Counter()

        def row(key: str, words: list[bytes], weight: int) -> tuple:
            normal = b" %b " % b" ".join(words)
            return key, normal, weight, len(words) - words.count(GUARD), len(normal)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["lang", "text", "weight", "words", "size"])

        for b in batches:
            for key, raw in zip(b.column(0), b.column(1)):
                key, words = key.as_py(), tokens(raw.as_py())
                n = sum(map(len, words)) + len(words)
                if n > CHUNK:
                    for part in slices(words, CHUNK):
                        yield out([row(key, *part)])
                elif words:
                    held.setdefault(key, []).extend([GUARD, *words])
                    size[key] += n
                    if size[key] > CHUNK or size.total() > 16 * CHUNK:
                        key = max(size, key=lambda k: size[k])
                        yield out([row(key, held.pop(key), 1)])
                        del size[key]
        if held:
            yield out([row(key, words, 1) for key, words in held.items()])

    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).mapInArrow(run, "lang string, text string, weight int, words long, size long")


class Spans:
    """Places and hashes of the words of a normal text and of the phrases of two and three words that start at each; hash 0
    where none does. Hashes come from prefix sums over the text's bytes, so that no word is touched alone."""

    table = np.random.default_rng(12).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    powers = inverses = np.ones(1, np.uint64)

    def __init__(self, lang: str, text: bytes) -> None:
        b = np.frombuffer(text, np.uint8)
        if len(b) > len(Spans.powers):
            n = 1 << len(b).bit_length()
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                x = np.full(n, base)
                x[0] = 1
                setattr(Spans, name, np.cumprod(x))
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.table[b] * self.powers[: len(b)], out=sums[1:])
        gap = np.flatnonzero(b == 32)
        self.text, self.start, self.end = text, gap[:-1] + 1, gap[1:]
        word = ~((self.end - self.start == 1) & (b[self.start] == GUARD[0]))
        seed = np.uint64(xxhash.xxh3_64_intdigest(lang))

        def keys(n: int) -> np.ndarray:
            out = np.zeros(len(word), np.uint64)
            m = len(word) - n + 1
            if m > 0:
                whole = np.logical_and.reduce([word[k : m + k] for k in range(n)])
                s, e = self.start[:m], self.end[n - 1 :]
                out[:m] = np.where(whole, mix64((sums[e] - sums[s]) * self.inverses[s] + seed + (e - s).astype(np.uint64)) | np.uint64(1), 0)
            return out

        self.one, self.two, self.three = (keys(n) for n in (1, 2, 3))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The batches' rows, one after the other; the second column as bytes."""
    for b in batches:
        for row in zip(*b.columns):
            yield tuple(c.as_buffer().to_pybytes() if k == 1 else c.as_py() for k, c in enumerate(row))


def gaps(at: np.ndarray, many: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending places as bytes of their gaps, and what to add there: a gap of 255 or more takes steps of 255 that add nothing."""
    gap = np.diff(at, prepend=0)
    steps = gap // 255
    end = np.cumsum(steps + 1) - 1
    step, add = np.full(end[-1] + 1, 255, np.uint8), np.zeros(end[-1] + 1, np.uint8)
    step[end], add[end] = gap % 255, many
    return step.tobytes(), add.tobytes()


def sketched(pieces: DataFrame, bits: int, least: int) -> DataFrame:
    """block, size, at, many: counters of a block (their gaps) and what to add to them, `size` bytes each, packed by zstd: they
    are most of the shuffled bytes, and the shuffle's own codec can't shorten them, since few bytes repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, codec = [], 0, pa.Codec("zstd", 1)

        def counters() -> pa.RecordBatch:
            at = np.concatenate(keys)
            keys.clear()
            at.sort()
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            many = np.minimum(np.diff(first, append=len(at)), least).astype(np.uint8)  # one that reaches the least count alone needs no more
            at = at[first].astype(np.int64)
            edge = np.searchsorted(at >> (bits - BLOCKS), np.arange((1 << BLOCKS) + 1))
            blocks = [k for k in range(1 << BLOCKS) if edge[k + 1] > edge[k]]
            cells = [gaps(at[edge[k] : edge[k + 1]] & ((1 << (bits - BLOCKS)) - 1), many[edge[k] : edge[k + 1]]) for k in blocks]
            packed = ([codec.compress(x, asbytes=True) for x in c] for c in zip(*cells))
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([len(c[0]) for c in cells], pa.int32()), *(pa.array(c, pa.binary()) for c in packed)], ["block", "size", "at", "many"])

        for lang, text, weight in rows_of(batches):
            if weight > 0:  # what is counted twice only raises a bound
                spans = Spans(lang, text)
                keys += [(x[x > 0] >> np.uint64(64 - bits)).astype(np.uint32) for x in (spans.one, spans.two, spans.three)]
                n += sum(map(len, keys[-3:]))
            if n > SLAB:
                yield counters()
                n = 0
        if n:
            yield counters()

    return pieces.select("lang", "text", "weight").mapInArrow(run, "block int, size int, at binary, many binary")


def reached(marks: DataFrame, bits: int, least: int) -> DataFrame:
    """block, bits: for each counter of the block whether its sum reaches the least count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total, codec = None, np.zeros(1 << (bits - BLOCKS), np.int32), pa.Codec("zstd")

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["block", "bits"])

        for b in batches:
            for k, size, at, many in zip(*b.columns):
                at, many = (np.frombuffer(codec.decompress(x.as_buffer(), size.as_py()), np.uint8) for x in (at, many))
                if k.as_py() != block:
                    if block is not None:
                        yield done()
                    block, total[:] = k.as_py(), 0
                place = np.cumsum(at, dtype=np.int64)
                total[place] += many  # of a step and a gap of 0 after it the gap counts
        if block is not None:
            yield done()

    n = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return marks.repartition(n, "block").sortWithinPartitions("block").mapInArrow(run, "block int, bits binary")


def heavy(spans: Spans, bitmap: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether the word, and the phrases of two and three words, at each place can be frequent."""
    held = np.frombuffer(bitmap, np.uint8)

    def bit(key: np.ndarray) -> np.ndarray:
        at = key >> np.uint64(64 - bits)
        return (key > 0) & (held[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)

    later = lambda x: np.append(x[1:], False)
    one = bit(spans.one)
    two = one & later(one) & bit(spans.two)
    return one, two, two & later(two) & bit(spans.three)


def strings(text: bytes, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The parts of a text as an Arrow array, gathered at once."""
    length = end - start
    offsets = np.append(0, np.cumsum(length)).astype(np.int32)
    data = np.frombuffer(text, np.uint8)[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(data))


def candidates(pieces: DataFrame, bitmap, bits: int) -> DataFrame:
    """lang, phrase, n: candidates (n null), and the words that can be frequent with their counts.

    A task leaves out most of the candidates that it has told already: a place by their hash remembers the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(1 << MET, np.uint64)
        words: dict[str, Counter[bytes]] = {}

        def out(lang: str, phrase: pa.Array, n: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), phrase, n], ["lang", "phrase", "n"])

        def counts() -> Iterator[pa.RecordBatch]:
            for lang, held in words.items():
                yield out(lang, pa.array(held, pa.string()), pa.array(held.values(), pa.int64()))
            words.clear()

        for lang, text, weight in rows_of(batches):
            spans = Spans(lang, text)
            one, two, three = heavy(spans, bitmap.value, bits)
            held = words.setdefault(lang, Counter())
            (held.update if weight > 0 else held.subtract)(compress(text[1:-1].split(b" "), one.tolist()))
            if weight > 0:
                for key, ok, size in ((spans.two, two, 2), (spans.three, three, 3)):
                    at = np.flatnonzero(ok)
                    place = (key[at] >> np.uint64(64 - MET)).astype(np.int64)
                    new = met[place] != key[at]
                    at, place = at[new], place[new]
                    if len(at):
                        met[place] = key[at]
                        at = at[np.unique(key[at], return_index=True)[1]]
                        yield out(lang, strings(text, spans.start[at], spans.end[at + size - 1]), pa.nulls(len(at), pa.int64()))
            if sum(map(len, words.values())) > WORDS:
                yield from counts()
        yield from counts()

    return pieces.select("lang", "text", "weight").mapInArrow(run, "lang string, phrase string, n long")


def runs(spans: Spans, shard: np.ndarray, at: np.ndarray, longer: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(shard, text): the words from each place `at` on, two of them or (longer) three, as normal text of the place's shard."""
    n = len(spans.start) + 2
    cell = np.unique(np.concatenate([shard * n + at, shard * n + at + 1, (shard * n + at + 2)[longer]]))
    own, at = cell // n, cell % n
    first = np.append(True, np.diff(cell) > 1)  # a run starts: a guard goes before it
    length = spans.end[at] - spans.start[at] + 1 + 2 * first
    end = np.cumsum(length)
    begin = end - length
    out = np.frombuffer(spans.text, np.uint8)[np.maximum(np.repeat(spans.start[at] - 1 - begin - 2 * first, length) + np.arange(end[-1]), 0)]
    out[begin[first]], out[begin[first] + 1] = 32, GUARD[0]
    whole, edge = out.tobytes(), np.append(np.flatnonzero(np.append(True, np.diff(own) > 0)), len(own))
    for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
        yield int(own[a]), whole[begin[a] : end[z - 1]] + b" "


def dealt(pieces: DataFrame, bitmap, bits: int) -> DataFrame:
    """lang, shard, block, text, weight: the runs of each text in which a candidate of the shard can start. pieces: also shards, blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text, weight, shards, blocks in rows_of(batches):
            spans = Spans(lang, text)
            _, two, three = heavy(spans, bitmap.value, bits)
            at = np.flatnonzero(two)
            if len(at):
                block, shard = xxhash.xxh3_64_intdigest(text) % blocks, (spans.two[at] % np.uint64(shards)).astype(np.int64)
                rows = [(lang, own, block, part, weight) for own, part in runs(spans, shard, at, three[at])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32()))], ["lang", "shard", "block", "text", "weight"])

    return pieces.select("lang", "text", "weight", "shards", "blocks").mapInArrow(run, "lang string, shard int, block long, text string, weight int")


def with_shards(phrases: DataFrame) -> DataFrame:
    """lang, phrase, shard, blocks. phrases: also shards, blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = np.zeros(b.num_rows, np.int32)
            langs, shards = np.array(b.column(0).to_pylist(), object), b.column(2).to_numpy()
            for lang in set(langs.tolist()):
                mine = np.flatnonzero(langs == lang)
                spans = Spans(lang, b" " + b" . ".join(b.column(1)[i].as_buffer().to_pybytes() for i in mine.tolist()) + b" ")
                firsts = np.flatnonzero(np.append(0, spans.one[:-1]) == 0)
                shard[mine] = spans.two[firsts[spans.one[firsts] > 0]] % shards[mine].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shard), b.column(3)], ["lang", "phrase", "shard", "blocks"])

    return phrases.select("lang", "phrase", "shards", "blocks").mapInArrow(run, "lang string, phrase string, shard int, blocks long")


def scanned(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """lang, phrase, a: what the automaton of each shard counts in each block of texts."""

    def scan(phrases: pa.Table, rows: pa.Table) -> pa.Table:
        held, counts = phrases["phrase"].to_pylist(), Counter()
        if held and rows.num_rows:
            automaton = ahocorasick.Automaton()
            for k, phrase in enumerate(held):
                automaton.add_word(f" {phrase} ", k)
            automaton.make_automaton()
            for text, weight in zip(rows["text"], rows["weight"].to_pylist()):
                found = Counter(map(itemgetter(1), automaton.iter(text.as_py())))
                if weight > 0:
                    counts.update(found)
                else:
                    counts.subtract(found)
        lang = phrases["lang"][0].as_py() if held else None
        return pa.table({"lang": pa.array([lang] * len(counts), pa.string()), "phrase": pa.array([held[k] for k in counts], pa.string()), "a": pa.array(counts.values(), pa.int64())})

    each = patterns.select("lang", "phrase", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    keys = ["lang", "shard", "block"]
    return each.groupBy(*keys).cogroup(texts.groupBy(*keys)).applyInArrow(scan, "lang string, phrase string, a long")


@contextmanager
def small_batches(spark: SparkSession, rows: int = ROWS) -> Iterator[None]:
    """Tasks started within read few rows at once and hand few to Python, also by bytes: by default a batch of either kind could
    be a whole partition of large rows, held several times over outside the heap."""
    new = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": BYTES_AT_ONCE, "spark.sql.parquet.columnarReaderBatchSize": ROWS_READ}
    before = {k: spark.conf.get(k) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def counted(docs: DataFrame, least: int = 10, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, phrase, a of all phrases of two or three words that occur `least` times; lang, word, n of all words that do, and
    maybe others; lang, n: number of words)."""
    if not 1 <= least <= 255:
        raise ValueError("the least count must be from 1 to 255")
    spark = docs.sparkSession
    pieces = written(prepared(docs, text, lang), "pieces", **PAGES)
    total, size = pieces.agg(F.coalesce(F.sum(F.col("words") * F.col("weight")), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits = min(max(int(total).bit_length(), LEAST_BITS), MOST_BITS)
    with small_batches(spark):
        bitmap = bytearray(1 << (bits - 3))  # 2^(MOST_BITS - 3) bytes at most
        for block, held in reached(sketched(pieces, bits, least), bits, least).toLocalIterator(prefetchPartitions=True):
            bitmap[block << (bits - BLOCKS - 3) : (block + 1) << (bits - BLOCKS - 3)] = held
        sent = spark.sparkContext.broadcast(bytes(bitmap))
        tasks = max(spark.sparkContext.defaultParallelism, -(-int(size) // GATHER))
        both = written(candidates(pieces.coalesce(tasks), sent, bits).groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "candidates", True)
        words, found = both.filter("n is not null").withColumnRenamed("phrase", "word"), both.filter("n is null").drop("n")
        plan = found.groupBy("lang").agg(F.ceil(F.count("*") / MOST_PATTERNS).cast("int").alias("shards"))
        plan = pieces.groupBy("lang").agg(F.sum("size").alias("size"), F.sum(F.col("words") * F.col("weight")).alias("n")).join(plan, "lang", "left")
        plan = written(plan.withColumn("blocks", F.ceil(F.col("size") / F.col("shards") / BLOCK).cast("long")).drop("size"), "plan", True)
        held = plan.filter("shards is not null").drop("n")
        counts = scanned(with_shards(found.join(held, "lang")), dealt(pieces.join(held, "lang"), sent, bits))
        counts = written(counts.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= least), "counts", True)
    discard(pieces)
    return counts, words, plan.select("lang", "n")


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of each language. share: in percent of a phrase's count,
    from which on a longer phrase around it drops it."""
    counts, words, total = counted(docs, least, text, lang)
    parts = F.split("phrase", " ")
    found = counts.withColumn("size", F.size(parts)).withColumns({"w1": parts[0], "w2": parts[1], "w3": F.get(parts, F.lit(2))})
    three = found.filter("size = 3").withColumns({"head": F.concat_ws(" ", "w1", "w2"), "tail": F.concat_ws(" ", "w2", "w3")})
    pairs = found.filter("size = 2").select("lang", "phrase", "a", "w1", "w2")
    count_of = lambda key, name: words.select("lang", F.col("word").alias(key), F.col("n").alias(name))
    pair_of = lambda key, name: pairs.select("lang", F.col("phrase").alias(key), F.col("a").alias(name))
    score = lambda l, r: F.expr(f"cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast(1000000 as decimal(7,0)) div (cast({l} as decimal(15,0)) * cast({r} as decimal(15,0)))")
    around = three.select("lang", F.explode(F.array_distinct(F.array("head", "tail"))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    two = pairs.join(count_of("w1", "l"), ["lang", "w1"]).join(count_of("w2", "r"), ["lang", "w2"]).join(around, ["lang", "phrase"], "left")
    two = two.filter(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < share * F.col("a"))).select("lang", "phrase", "a", "l", "r", score("l", "r").alias("score"))
    three = three.join(count_of("w1", "l1"), ["lang", "w1"]).join(pair_of("tail", "r1"), ["lang", "tail"]).join(pair_of("head", "l2"), ["lang", "head"]).join(count_of("w3", "r2"), ["lang", "w3"])
    three = three.withColumns({"s1": score("l1", "r1"), "s2": score("l2", "r2")}).withColumn("first", F.col("s1") <= F.col("s2"))
    three = three.select("lang", "phrase", "a", *(F.when(F.col("first"), F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("l1", "l2", "l"), ("r1", "r2", "r"), ("s1", "s2", "score"))))
    order = (F.desc("score"), F.desc("a"), "phrase")
    # the best of each part of a language first: no task ranks all phrases of a large one
    parts = two.unionByName(three).withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    parts = parts.withColumn("__r", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).filter(F.col("__r") <= top).drop("__r", "__part")
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, by language."""
    return collocations(read(spark, sf_dir, "documents"))


#: The same in DuckDB.
ORACLE = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
 p AS (SELECT lang, list_filter(string_split_regex(unnest(pieces), '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
 c AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS size)) GROUP BY ALL),
 t AS (SELECT lang, sum(f) AS n FROM c WHERE size = 1 GROUP BY 1),
 k AS (SELECT *, string_split(phrase, ' ') AS w FROM c WHERE size > 1 AND f >= 10),
 cuts AS (SELECT lang, size, phrase, f AS a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM k)),
 s AS (SELECT cuts.*, h.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (h.f::HUGEINT * r.f) AS score FROM cuts JOIN c h ON h.lang = cuts.lang AND h.phrase = head JOIN c r ON r.lang = cuts.lang AND r.phrase = tail),
 m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS least FROM s),
 o AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, f FROM k WHERE size = 3) GROUP BY ALL),
 b AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, m.phrase) AS rank FROM m LEFT JOIN o ON o.lang = m.lang AND o.phrase = m.phrase WHERE least = 1 AND (m.size > 2 OR longer IS NULL OR 100 * longer < 50 * a))
 SELECT b.lang, CAST(rank AS BIGINT) AS rank, b.phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM b JOIN t ON t.lang = b.lang WHERE rank <= 2000"""
