"""Operator 2: deletion of repeated passages by winnowing over line hashes.

Repeated passages don't keep to line breaks, so a line here is a run of GRAM words starting at any word, whatever white space
is between. The least line hash of each window of consecutive lines is a fingerprint (the rightmost if several are least):
every passage of at least `least` words (a window) has one, and copies of the passage have it at the same place. Positions
that share a fingerprint are joined, in order of id and place, each with the words around its line. From the line, a
position's match with those before it is extended both ways, word by word, as far as a passage of `least` words can reach;
where the two reaches together make up `least` words, the later words are deleted, and neighbouring ranges merge into runs.

So exactly this is deleted: each word inside some run of `least` words that occurs earlier, in a document of smaller
id or further ahead in its own. Fingerprints decide only what is looked at; words decide the result. Texts that are equal
(told by 128 bits) are one document here (that of the least id); later copies of at least `least` words lose all words.

Where the words around are the same as at an earlier position (told by 128 bits), all of them are deleted at once.

A fingerprint with more than HOT positions isn't gathered in one place. The first of its positions with the same words around
is found by a grouped minimum; the passages of `least` words around the first ones are named by 128 bits, and the first
holder of every name is found likewise.

Cases: null texts stay null, empty and short ones as they are; rows equal in id and text are treated alike (as one
document); null ids come first; texts of any length count whole; text is rebuilt from its bytes, so what isn't deleted is
unchanged, white space after a deleted word goes with it; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, mix64, read, written
from .shingles import inverse_powers, powers, word_spans, word_starts

LEAST, GRAM = 50, 15
#: Positions of one fingerprint that are gathered in one task.
HOT = 4096
#: Text bytes hashed at a time (a longer text is a part of its own), and lines ordered at a time.
PART, STRETCH = 1 << 18, 1 << 23
_STEP = 0x9E3779B97F4A7C15
_PLACE = 24  # low bits of a key that hold a line's place in its stretch


class Batch:
    """Words of several texts, one after the other, with window hashes of any width by one running sum."""

    def __init__(self, texts: list[bytes]):
        self.hash, start, end = word_spans(b"\n".join(texts), lower=False)
        self.start, self.end = start, end
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        #: words of text k: first[k] .. first[k + 1]; its bytes begin at byte[k]
        self.first, self.byte = np.searchsorted(start, at), at
        n = len(self.hash)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * powers(_STEP, n))])
        self.inverse = inverse_powers(_STEP, n + 1)

    def grams(self, width: int) -> np.ndarray:
        """A hash of the words [i, i + width), for each i at which they exist."""
        n = len(self.hash) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix64((self.total[width:] - self.total[:n]) * self.inverse[:n])

    def windows(self, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts of the windows of `least` words inside one text, the place of the fingerprint of each)."""
        n = len(self.hash) - least + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lines, span, low = self.grams(gram), least - gram + 1, np.uint64((1 << _PLACE) - 1)
        places = []
        for base in range(0, n, STRETCH):
            key = lines[base : base + STRETCH + span - 1]
            key = (key & ~low) | (low - np.arange(len(key), dtype=np.uint64))
            have = 1
            while have < span:  # minima of windows of `have` lines, doubled until `span`
                more = min(have, span - have)
                key = np.minimum(key[: len(key) - more], key[more:])
                have += more
            places.append(base + (low - (key & low)).astype(np.int64))
        place, inside = np.concatenate(places), np.zeros(n, bool)
        for a, b in zip(self.first[:-1], self.first[1:]):
            if b - a >= least:
                inside[a : b - least + 1] = True
        start = np.flatnonzero(inside)
        return start, place[start]


def _parts(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in parts of bounded size, with the index of each part's first text."""
    part: list[bytes] = []
    size = begin = 0
    for k, t in enumerate(texts):
        data = (t or "").encode()
        if part and size + len(data) > PART:
            yield begin, part
            part, size, begin = [], 0, k
        part.append(data)
        size += len(data) + 1
    if part:
        yield begin, part


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that few texts are held twice."""
    for b in batches:
        for k in range(0, max(1, b.num_rows), rows):
            yield b.slice(k, rows)


def fingerprints(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """print, doc (the text's hash), place: of docs with columns doc, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            doc = b.column(0).to_numpy()
            for begin, part in _parts(b.column(1).to_pylist()):
                words = Batch(part)
                lines = np.unique(words.windows(least, gram)[1])
                of = np.searchsorted(words.first, lines, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(words.grams(gram)[lines].view(np.int64)), pa.array(doc[begin + of]), pa.array((lines - words.first[of]).astype(np.int32))], ["print", "doc", "place"])

    return docs.select("doc", "text").mapInArrow(run, "print long, doc long, place int")


def contexts(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """print, hot, id, doc, doc2, place, before, many, words: of docs with doc, doc2, id, text, places (structs place, hot).

    words: the `many` ones of all passages of `least` words whose fingerprint is the line at `place`, from `before` words ahead of the
    line on, with a zero byte after each. Copies of a passage have their fingerprint at the same place, so no others matter."""
    kind = docs.schema["id"].dataType.simpleString()
    names = ["print", "hot", "id", "doc", "doc2", "place", "before", "many", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            doc, doc2, places = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(4)
            for begin, part in _parts(b.column(3).to_pylist()):
                batch = Batch(part)
                start, of = batch.windows(least, gram)
                mine = places.slice(begin, len(part))
                row = np.repeat(np.arange(len(part)), mine.value_lengths().to_numpy())
                place, hot = (mine.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                at = batch.first[row] + place
                lo, hi = np.searchsorted(of, at, "left"), np.searchsorted(of, at, "right")
                ok = (hi > lo) & (at < batch.first[row + 1])  # else a place of another text with this hash
                at, row, place, hot, lo, hi = (x[ok] for x in (at, row, place, hot, lo, hi))
                offset = np.concatenate([[0], np.cumsum(batch.end - batch.start + 1)])
                plain = b"\0".join(b"\n".join(part).split()) + b"\0"  # white space of bytes is what parts words here
                first, end = start[lo], start[hi - 1] + least
                words = [plain[x:y] for x, y in zip(offset[first].tolist(), offset[end].tolist())]
                ids = b.column(2).take(pa.array(begin + row))
                columns = [pa.array(batch.grams(gram)[at].view(np.int64)), pa.array(hot, pa.bool_()), ids, pa.array(doc[begin + row]), pa.array(doc2[begin + row]), pa.array(place.astype(np.int32)), pa.array((at - first).astype(np.int32)), pa.array((end - first).astype(np.int32)), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc", "doc2", "id", "text", "places").mapInArrow(run, f"print long, hot boolean, id {kind}, doc long, doc2 long, place int, before int, many int, words binary")


def reaches(contexts_: list[tuple[int, list[bytes]]], least: int, gram: int) -> list[list[tuple[int, int]]]:
    """For each of several places of a line, in order: the ranges, counted from the line's first word, that lie in
    passages of `least` words which some place before has too. contexts_: (words ahead of the line, words)."""
    reach = least - gram
    number: dict[bytes, int] = {}
    # a row each: the words ahead, nearest first, and those behind the line; -1, -2, ... where there is none
    ahead = np.empty((len(contexts_), reach), np.int64)
    behind = np.empty((len(contexts_), reach), np.int64)
    for k, (before, words) in enumerate(contexts_):
        ids = [number.setdefault(w, len(number)) for w in words]
        left, right = ids[:before][::-1], ids[before + gram :]
        ahead[k] = [*left, *([-1 - k] * (reach - len(left)))]
        behind[k] = [*right, *([-1 - k] * (reach - len(right)))]
    out: list[list[tuple[int, int]]] = [[]]
    for k in range(1, len(contexts_)):
        left = np.minimum.accumulate(ahead[:k] == ahead[k], axis=1).sum(1)
        right = np.minimum.accumulate(behind[:k] == behind[k], axis=1).sum(1)
        # the furthest right for each reach to the left or more: a passage that begins l words ahead needs reach - l behind
        best = np.full(reach + 1, -1)
        np.maximum.at(best, left, right)
        best = np.maximum.accumulate(best[::-1])[::-1]
        ranges: list[list[int]] = []
        for l in range(reach, -1, -1):
            if best[l] >= reach - l:
                if ranges and -l <= ranges[-1][1]:
                    ranges[-1][1] = -l + least
                else:
                    ranges.append([-l, -l + least])
        out.append([(a, b) for a, b in ranges])
    return out


def extended(found: DataFrame, least: int, gram: int) -> DataFrame:
    """doc, doc2, lo, hi: word ranges that occur earlier, from contexts() of fingerprints with few positions."""
    keys = ["print", "x", "y", "before"]

    def done(t: pa.Table) -> pa.RecordBatch:
        """All rows of some fingerprints; places with the same words around stand together, the first one ahead."""
        column = {c: t[c].to_numpy() for c in (*keys, "doc", "doc2", "place", "many")}
        alike = np.ones(t.num_rows, bool)
        for c in keys:
            alike[1:] &= column[c][1:] == column[c][:-1]
        alike[0] = False
        twice = alike.copy()  # one place, of a row that is repeated
        for c in ("doc", "doc2", "place"):
            twice[1:] &= column[c][1:] == column[c][:-1]
        lo = column["place"] - column["before"]
        later = np.flatnonzero(alike & ~twice)
        out = [(column["doc"][later], column["doc2"][later], lo[later], (lo + column["many"])[later])]
        first = np.flatnonzero(~alike)
        edge = np.flatnonzero(np.concatenate([[True], column["print"][first][1:] != column["print"][first][:-1], [True]]))
        some = [first[x:y] for x, y in zip(edge[:-1], edge[1:]) if y - x > 1]
        if some:
            asked = pa.array(np.concatenate(some))
            ids, words = (t[c].take(asked).to_pylist() for c in ("id", "words"))
            rows, at = [], 0
            for group in some:
                held = [((i is not None, i), *(int(column[c][k]) for c in ("doc", "doc2", "place", "before")), w.split(b"\0")[:-1]) for k, i, w in zip(group.tolist(), ids[at : at + len(group)], words[at : at + len(group)])]
                at += len(group)
                held.sort(key=lambda r: r[:4])
                lines: dict[tuple, list] = {}
                for r in held:
                    lines.setdefault(tuple(r[5][r[4] : r[4] + gram]), []).append(r)
                for same in lines.values():
                    for r, ranges in zip(same, reaches([r[4:] for r in same], least, gram)):
                        rows += [(r[1], r[2], r[3] + x, r[3] + y) for x, y in ranges]
            out.append(tuple(np.array(rows, np.int64).reshape(-1, 4).T))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k)) for c, k in zip(zip(*out), ("i8", "i8", "i4", "i4"))], ["doc", "doc2", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            rest = (t if rest is None else pa.concat_tables([rest, t])).combine_chunks()
            prints = rest["print"].to_numpy()
            cut = len(prints) and int(np.searchsorted(prints, prints[-1]))  # the last fingerprint may go on
            if cut:
                yield done(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield done(rest)

    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = found.withColumns({"x": F.xxhash64("words"), "y": F.xxhash64(F.lit(1), "words")})
    rows = rows.select(*keys, "id", "doc", "doc2", "place", "many", "words").repartition(n, "print").sortWithinPartitions(*keys, "id", "doc", "doc2", "place")
    return rows.mapInArrow(run, "doc long, doc2 long, lo int, hi int")


def first_holders(found: DataFrame, least: int, gram: int) -> DataFrame:
    """doc, doc2, ranges (lo, hi): as extended(), from contexts() of fingerprints with many positions."""
    kind = found.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 2048):
            row, lo, name = [], [], []
            for k, (place, before, words) in enumerate(zip(*(b.column(c).to_pylist() for c in (3, 4, 5)))):
                ends = [0, *(np.flatnonzero(np.frombuffer(words, np.uint8) == 0) + 1).tolist()]
                for s in range(len(ends) - least):
                    row.append(k)
                    lo.append(place - before + s)
                    name.append(hashlib.blake2b(words[ends[s] : ends[s + least]], digest_size=16).digest())
            halves = np.frombuffer(b"".join(name), np.int64).reshape(-1, 2)
            take = pa.array(row, pa.int64())
            ids = [b.column(k).take(take) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(lo, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["id", "doc", "doc2", "lo", "x", "y"])

    # the places of a document with the same words around are one row
    alike = ["print", "before", "x", "y"]
    each = found.withColumns({"x": F.xxhash64("words"), "y": F.xxhash64(F.lit(1), "words")}).groupBy(*alike, "id", "doc", "doc2")
    each = written(each.agg(F.collect_set("place").alias("places"), F.min("place").alias("place"), F.first("many").alias("many"), F.first("words").alias("words")), "hot-places")
    at = F.struct("id", "doc", "doc2", "place")
    # minima are written: each side of a join is then dealt by itself, and a hot key can be split
    first = written(each.groupBy(*alike).agg(F.min(at).alias("first")), "first-places", True)
    joined = each.join(first, alike)
    later = F.filter("places", lambda p: (F.struct("id", "doc", "doc2", p.alias("place")) != F.col("first")))
    lo = lambda p: (p - F.col("before")).cast("int")
    whole = joined.select("doc", "doc2", F.transform(later, lambda p: F.struct(lo(p).alias("lo"), (lo(p) + F.col("many")).alias("hi"))).alias("ranges")).filter(F.size("ranges") > 0)
    whole = written(whole, "ranges-of-hot", True)
    firsts = joined.filter(at == F.col("first")).select("id", "doc", "doc2", "place", "before", "words")
    rows = written(firsts.mapInArrow(run, f"id {kind}, doc long, doc2 long, lo int, x long, y long"), "hot-passages")
    at = F.struct("id", "doc", "doc2", "lo")
    first = written(rows.groupBy("x", "y").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first != last").select("x", "y", "first"), "first-holders", True)
    part = rows.join(first, ["x", "y"]).filter(at != F.col("first")).select("doc", "doc2", F.array(F.struct("lo", (F.col("lo") + least).cast("int").alias("hi"))).alias("ranges"))
    return whole.unionByName(written(part, "ranges-of-hot", True))


def _names(text: str) -> list[Column]:
    """Two 64-bit hashes of a text."""
    return [F.xxhash64(text).alias("doc"), F.xxhash64(F.lit(1), F.col(text)).alias("doc2")]


def repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc, doc2 (the text's hashes), id (the first copy), ranges (lo, hi): words inside passages that occur earlier.

    A row for each text that stands in several documents, or repeats a passage."""
    slim = docs.select(*_names(text), F.col(doc_id).alias("id"), F.col(text).alias("text")).filter(F.col(text).isNotNull())
    prints = written(fingerprints(slim, least, gram), "fingerprints")
    at = F.xxhash64("doc", "place")  # copies of a text have one
    shared = prints.groupBy("print").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("n")).filter("lo != hi")
    shared = written(shared.select("print", (F.col("n") > HOT).alias("hot")), "shared-prints", True)
    places = written(prints.join(shared, "print").select("doc", "place", "hot"), "shared-places", True)
    discard(prints)
    places = places.groupBy("doc").agg(F.collect_set(F.struct("place", "hot")).alias("places")).withColumnRenamed("doc", "__d")
    first = slim.groupBy("doc", "doc2").agg(F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("none"), F.count("*").alias("copies"))
    first = first.select("doc", "doc2", F.when(~F.col("none"), F.col("id")).alias("id"), "copies")  # null ids come first
    known = first.join(places, F.col("doc") == F.col("__d"), "left").filter("copies > 1 or places is not null")
    known = written(known.select("doc", "doc2", "id", "places"), "shared-lines", True)
    looked = known.filter("places is not null").select(F.col("doc").alias("__d"), F.col("doc2").alias("__d2"), F.col("id").alias("__i"), "places")
    same = (F.col("doc") == F.col("__d")) & (F.col("doc2") == F.col("__d2")) & F.col("id").eqNullSafe(F.col("__i"))
    texts = slim.join(looked.hint("shuffle_hash"), same).select("doc", "doc2", "id", "text", "places")
    # a row that is repeated, id and text, gives its places as often; they are one place
    found = written(contexts(texts, least, gram), "contexts")
    few, many = found.filter("not hot"), found.filter("hot")
    ranges = written(extended(few, least, gram).select("doc", "doc2", F.array(F.struct("lo", "hi")).alias("ranges")), "ranges", True)
    if not many.isEmpty():
        ranges = ranges.unionByName(first_holders(many, least, gram))
    discard(found)
    ranges = ranges.groupBy("doc", "doc2").agg(F.flatten(F.collect_set("ranges")).alias("ranges"))
    return written(known.select("doc", "doc2", "id").join(ranges, ["doc", "doc2"], "left"), "repeats", True)


def without(data: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, int, int, list[tuple[int, int]]]:
    """(text less the word ranges, its words, deleted words, deleted runs as word ranges)."""
    start = word_starts(data)
    n = len(start)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    gone = np.cumsum(edge)[:n] > 0
    turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
    runs = [(int(a), int(b)) for a, b in zip(turn[::2], turn[1::2])]
    bound = np.append(start, len(data))
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at : bound[a]])
        at = int(bound[b])
    kept.append(data[at:])
    return b"".join(kept), n, int(gone.sum()), runs


def deduplicated(docs: DataFrame, least: int = LEAST, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id", report: bool = False) -> DataFrame:
    """docs with the repeated passages deleted from text. Rows that lose all their words go.

    report: instead doc_id, text, n_words, deleted_words, runs (word ranges), for every row."""
    named = docs.withColumns({f"__{n}": c for n, c in zip(("doc", "doc2"), _names(text))})
    lists = [F.col("ranges")[n].alias(f"__{n}") for n in ("lo", "hi")]
    found = repeats(docs, least, gram, text, doc_id).select(F.col("doc").alias("__d"), F.col("doc2").alias("__d2"), F.col("id").alias("__i"), *lists)
    joined = named.join(found.hint("shuffle_hash"), (F.col("__doc") == F.col("__d")) & (F.col("__doc2") == F.col("__d2")) & F.col(text).isNotNull(), "left")
    joined = joined.withColumn("__copy", F.col("__d").isNotNull() & ~F.col(doc_id).eqNullSafe(F.col("__i"))).drop("__doc", "__doc2", "__d", "__d2", "__i")
    fields = docs.schema.fields
    if report:
        joined = joined.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), "__lo", "__hi", "__copy")
        fields = [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("text", T.StringType())]
    names, text = [f.name for f in fields], "text" if report else text
    run_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            at = b.schema.get_field_index
            texts, lo, hi, copy = b.column(at(text)).to_pylist(), b.column(at("__lo")), b.column(at("__hi")), b.column(at("__copy")).to_pylist()
            out, counts, gone, runs = [], [], [], []
            for k, t in enumerate(texts):
                if copy[k] or lo[k].is_valid:
                    data = (t or "").encode()
                    n = len(data.split())
                    if not copy[k]:
                        data, n, g, r = without(data, np.asarray(lo[k].values), np.asarray(hi[k].values))
                    elif n >= least:
                        data, g, r = b"", n, [(0, n)]
                    else:
                        g, r = 0, []
                    out.append(t if not g else data.decode())
                else:
                    out.append(t)
                    n, g, r = len(t.encode().split()) if t and report else 0, 0, []
                counts.append(n)
                gone.append(g)
                runs.append([{"first": x, "end": y} for x, y in r])
            columns = [pa.array(out, pa.string()) if c == text else b.column(at(c)) for c in names]
            if report:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32()), pa.array(gone, pa.int32()), pa.array(runs, run_type)], [*names, "n_words", "deleted_words", "runs"])
            else:
                some = pa.array([not g or g < n for n, g in zip(counts, gone)], pa.bool_())
                yield pa.RecordBatch.from_arrays(columns, names).filter(some)

    extra = [T.StructField("n_words", T.IntegerType()), T.StructField("deleted_words", T.IntegerType())] if report else []
    if report:
        extra.append(T.StructField("runs", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]))))
    return joined.mapInArrow(run, T.StructType([*fields, *extra]))


def op2_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents less every later occurrence of passages of 50 words or more."""
    return deduplicated(read(spark, sf_dir, "documents"), report=True)
