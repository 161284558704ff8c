"""Operator 10: near-duplicate documents by circulant MinHash.

A document is the set of its word shingles (64-bit hashes). All coordinates of its signature come from two permutations of
a universe of positions: one places the shingles, the other, shifted circularly by k, is minimised for coordinate k. The
shifts of one position are neighbours in memory, so a shingle updates all coordinates by one vector minimum.

Texts of one set (told by 128 bits) are one class with a number of its own and stand in the search once. Signatures are cut
into BANDS bands of ROWS coordinates; classes that agree in a band share a bucket (a pair at the threshold misses all bands
with probability 5e-7, the only thing that is left to chance). Every pair of a bucket is then decided, without listing them:

1. In two rounds, members are held against one, then up to three centres of their bucket; similar ones join one component.
2. Of buckets that still hold several components, small ones give all their pairs of different components.
3. In larger ones the members of the largest component are held against the others, and the others against each
   other, in blocks. A first pass over bit maps finds the members that may have a partner in another component; a second one
   compares the full sets of those, passes over pairs that are joined by then, and gives only enough links to join what is
   similar. A pair is compared in the first band it has in common.

Before full sets are compared, sizes and bit maps of the sets rule out pairs. The map shows at least how many shingles
of one set the other one lacks, so no pair at the threshold is ever ruled out. Every link is confirmed on full sets.

Cases: null and empty texts have no shingles and are linked with nothing; a text of fewer words is one shingle; equal
texts are one class of any size; rows of one id, or of none, are told apart by their texts; null ids never become a
component's id unless all its ids are null; very long texts count whole; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read, written
from .components import components
from .neighbours import grouped
from .shingles import shingle_hashes

BANDS, ROWS = 48, 6
UNIVERSE = 1 << 20
#: Buckets of up to so many members give all their pairs of different components; larger ones are compared in blocks of
#: SIDE members, or of fewer that have SIDE_SHINGLES together.
SMALL, SIDE, SIDE_SHINGLES = 16, 512, 1 << 20
#: 64-bit words of a set's bit map.
MAP_WORDS = 16
#: Members of one centre that are compared in one task.
STAR = 256

_permutations: list[np.ndarray] = []


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """(placing permutation, rows [i]: the shifts 0..BANDS*ROWS-1 of the other one at position i)."""
    if not _permutations:
        rng = np.random.default_rng(97)
        placing = rng.permutation(UNIVERSE)
        other = rng.permutation(UNIVERSE).astype(np.uint32)
        k = BANDS * ROWS
        _permutations.extend([placing, np.lib.stride_tricks.sliding_window_view(np.concatenate([other, other[: k - 1]]), k)])
    return _permutations[0], _permutations[1]


def name_of(shingles: np.ndarray) -> tuple[int, int] | None:
    """A name of the set, of two 64-bit halves."""
    if not len(shingles):
        return None
    name = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(name[:8], "little", signed=True), int.from_bytes(name[8:], "little", signed=True)


def signature(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS coordinates; shingles must not be empty."""
    placing, shifts = permutations()
    at = placing[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    out = shifts[at[:256]].min(0)
    for k in range(256, len(at), 256):
        np.minimum(out, shifts[at[k : k + 256]].min(0), out)
    return out


def bit_map(shingles: np.ndarray) -> np.ndarray:
    """MAP_WORDS words; each shingle sets the bit that its high bits name."""
    bits = np.zeros(MAP_WORDS * 64, np.uint8)
    bits[(shingles >> np.uint64(64 - (MAP_WORDS * 64 - 1).bit_length())).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def signed(docs: DataFrame, width: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, n_shingles, name, name2 (null if empty), bands array<long>, map array<long>."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "text_hash", "n_shingles", "name", "name2", "bands", "map"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = (np.arange(BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        mult = np.random.default_rng(11).integers(0, 1 << 62, (BANDS, ROWS), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        for b in batches:
            n, name, sigs, maps = [], [], [], []
            for t in b.column(2).to_pylist():
                s = shingle_hashes(t.encode(), width) if t else np.zeros(0, np.uint64)
                n.append(len(s))
                name.append(name_of(s) or (None, None))
                sigs.append(signature(s) if len(s) else np.zeros(BANDS * ROWS, np.uint32))
                maps.append(bit_map(s))
            sig = np.array(sigs, np.uint32).reshape(-1, BANDS * ROWS)
            mixed = (sig.reshape(-1, BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * mult
            mixed = (mixed ^ (mixed >> np.uint64(29))).sum(2, dtype=np.uint64) * salt[:, 0]
            mixed ^= mixed >> np.uint64(32)
            lists = lambda x, k: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).view(np.int64).ravel()), k).cast(pa.list_(pa.int64()))
            maps = np.array(maps, np.uint64).reshape(-1, MAP_WORDS)
            columns = [pa.array(n, pa.int64()), *(pa.array([x[k] for x in name], pa.int64()) for k in (0, 1)), lists(mixed, BANDS), lists(maps, MAP_WORDS)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, name long, name2 long, bands array<long>, map array<long>")


def may_be_near(a: str, b: str, percent: int) -> Column:
    """Whether two members (struct columns a and b: n, ones, map) can be as similar as percent."""
    both = sum((F.bit_count(F.col(f"{a}.map")[k].bitwiseAND(F.col(f"{b}.map")[k])) for k in range(MAP_WORDS)), F.lit(0))
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    # of the set with `ones` bits, each bit that the other map lacks is a shingle that the other set lacks
    most = F.least(x - F.col(f"{a}.ones"), y - F.col(f"{b}.ones")) + both
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & ((100 + percent) * most >= percent * (x + y))


def full_sets(docs: DataFrame, classes: DataFrame, width: int, text: str, doc_id: str) -> DataFrame:
    """cid, shingles (bytes of ascending 64-bit hashes) of classes: cid, id, text_hash (of one row of the class)."""
    asked = classes.select("cid", "id", F.col("text_hash").alias("h"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    texts = rows.join(asked.hint("shuffle_hash"), F.col("text_hash").eqNullSafe(F.col("h")) & F.col("doc_id").eqNullSafe(F.col("id")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([shingle_hashes((t or "").encode(), width).tobytes() for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), made], ["cid", "shingles"])

    # a row that is repeated, id and text, comes as often as it stands there
    return written(texts.select("cid", "text").mapInArrow(sets, "cid long, shingles binary").dropDuplicates(["cid"]), "shingle-sets")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    return int(np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs u, v of classes, as a and b, whose full sets share percent of their union or more.

    v should be the end that is in many pairs: its set goes once to every STAR of its partners."""
    near = written(pairs.select("u", "v").distinct(), "candidates", True)
    parts = near.groupBy("v").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    near_parts = near.join(parts, "v").select("v", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"), F.col("u").alias("cid"))
    own = parts.select("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("v").alias("cid"))
    rows = near_parts.unionByName(own).join(sets, "cid")

    def star(t: pa.Table) -> pa.RecordBatch | None:
        cid, v = t["cid"].to_numpy(), t["v"][0].as_py()
        held = [np.frombuffer(s.as_buffer(), np.uint64) for s in t["shingles"]]
        at = int(np.flatnonzero(cid == v)[0])
        x, out = held[at], []
        for k, y in enumerate(held):
            if k != at:
                both = _shared(x, y) if len(x) >= len(y) else _shared(y, x)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append(cid[k])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(out), v, np.int64)), pa.array(np.array(out, np.int64))], ["a", "b"]) if out else None

    out = written(grouped(rows, ["v", "part"], ["cid", "shingles"], star, "a long, b long"), "links", True)
    discard(near)
    return out


def _joined(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("cid"))
    return members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))


def centre_pairs(here: DataFrame, centres: int, salt: int, percent: int) -> DataFrame:
    """u, v: members and centres, of other components, of their buckets. here: bucket, cid, root, m."""
    if centres == 1:
        order = [F.xxhash64("cid", F.lit(salt))]
    else:  # of each of the first components by one hash order, a member by another
        order = [F.struct(F.xxhash64("root", "bucket", F.lit(salt + k)), "root", F.xxhash64("cid", F.lit(salt))) for k in range(centres)]
    pick = [F.min(F.struct(o.alias("o"), "cid", "root", "m")).alias(f"c{k}") for k, o in enumerate(order)]
    chosen = here.groupBy("bucket").agg(*pick, F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi")
    each = F.array_distinct(F.array(*(F.struct(f"c{k}.cid", f"c{k}.root", f"c{k}.m") for k in range(centres))))
    chosen = chosen.select("bucket", F.explode(each).alias("c")).select("bucket", F.col("c.cid").alias("v"), F.col("c.root").alias("other"), F.col("c.m").alias("c"))
    return here.join(chosen, "bucket").filter((F.col("root") != F.col("other")) & may_be_near("m", "c", percent)).select(F.col("cid").alias("u"), "v")


def left_buckets(here: DataFrame) -> DataFrame:
    """bucket, size, major (its largest component), rest and mine (blocks of the others and of major): with several roots."""
    each = here.groupBy("bucket", "root").agg(F.count("*").alias("k"), F.sum("m.n").alias("s"))
    all_ = each.groupBy("bucket").agg(F.max(F.struct("k", "root", "s")).alias("top"), F.count("*").alias("roots"), F.sum("k").alias("size"), F.sum("s").alias("s"))
    blocks = lambda k, s: F.greatest(F.ceil(k / SIDE), F.ceil(s / SIDE_SHINGLES), F.lit(1)).cast("int")
    out = all_.filter("roots > 1").select("bucket", "size", F.col("top.root").alias("major"), blocks(F.col("size") - F.col("top.k"), F.col("s") - F.col("top.s")).alias("rest"), blocks(F.col("top.k"), F.col("top.s")).alias("mine"))
    return written(out, "left-buckets", True)


def small_pairs(here: DataFrame, left: DataFrame, percent: int) -> DataFrame:
    """u, v: all pairs of different components in buckets of up to SMALL members."""
    few = here.join(left.filter(f"size <= {SMALL}").select("bucket"), "bucket")
    rest = few.select(F.col("bucket").alias("b"), F.col("cid").alias("v"), F.col("root").alias("other"), F.col("m").alias("c"))
    return few.join(rest, (F.col("bucket") == F.col("b")) & (F.col("root") < F.col("other")) & may_be_near("m", "c", percent)).select(F.col("cid").alias("u"), "v")


def in_blocks(rows: DataFrame) -> DataFrame:
    """bucket, i, j, side and the other columns of rows: each row once for every block it takes part in.

    rows: members (bucket, cid, root, ...) with major, rest, mine of their buckets. Members of other components have parts
    0 .. rest - 1, those of the largest one rest .. rest + mine - 1; a block is two parts, the first of them of the others."""
    other = F.col("root") != F.col("major")
    h = F.xxhash64("cid", F.lit(3))
    part = F.when(other, F.pmod(h, F.col("rest"))).otherwise(F.col("rest") + F.pmod(h, F.col("mine"))).cast("int")
    mates = F.when(other, F.sequence(F.lit(0), F.col("rest") + F.col("mine") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") - 1))
    rows = rows.withColumn("side", part).withColumn("o", F.explode(mates))
    return rows.withColumn("i", F.least("side", "o")).withColumn("j", F.greatest("side", "o")).drop("o", "major", "rest", "mine")


def _may_be_near(n: np.ndarray, maps: np.ndarray, ones: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """may_be_near() of members a (rows) and b (columns)."""
    x, y = n[a][:, None], n[b]
    out = 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
    if out.any():
        both = np.zeros(out.shape, np.int64)
        for k in range(MAP_WORDS):
            both += np.bitwise_count(maps[a, k][:, None] & maps[b, k])
        most = np.minimum((n - ones)[a][:, None], (n - ones)[b]) + both
        out &= (100 + percent) * most >= percent * (x + y)
    return out


def with_partners(rows: DataFrame, percent: int) -> DataFrame:
    """bucket, cid: the members that may be near one of another component. rows: of in_blocks(), with n, ones, w0, w1, ..."""
    words = [f"w{k}" for k in range(MAP_WORDS)]

    def block(t: pa.Table) -> pa.RecordBatch | None:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        side, root, n, ones = (t[c].to_numpy() for c in ("side", "root", "n", "ones"))
        maps = np.stack([t[w].to_numpy() for w in words], 1).view(np.uint64)
        a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
        hit = np.zeros(len(n), bool)
        for k in range(0, len(a), 128):
            s = a[k : k + 128]
            near = _may_be_near(n, maps, ones, s, b, percent) & (root[s][:, None] != root[b])
            hit[s] |= near.any(1)
            hit[b] |= near.any(0)
        some = pa.array(np.flatnonzero(hit))
        return pa.RecordBatch.from_arrays([t["bucket"].take(some).combine_chunks(), t["cid"].take(some).combine_chunks()], ["bucket", "cid"]) if len(some) else None

    return grouped(rows, ["bucket", "i", "j"], ["side", "cid", "root", "n", "ones", *words], block, "bucket long, cid long").distinct()


class Forest:
    """Which of the given labels are joined."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up[y]
        return x


def joined_in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: enough links of members to join all components that a link of their full sets joins, within each block.

    rows: of in_blocks(), with band (the bucket's), bands and shingles."""

    def block(t: pa.Table) -> pa.RecordBatch | None:
        i, j, band = t["i"][0].as_py(), t["j"][0].as_py(), t["band"][0].as_py()
        side, cid, root = (t[c].to_numpy() for c in ("side", "cid", "root"))
        held = [np.frombuffer(s.as_buffer(), np.uint64) for s in t["shingles"]]
        n, maps = np.array([len(s) for s in held]), np.array([bit_map(s) for s in held])
        ones = np.bitwise_count(maps).sum(1, dtype=np.int64)
        bands = np.array(t["bands"].combine_chunks().flatten()).reshape(-1, BANDS)
        a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
        found, forest = [], Forest()
        for k in range(0, len(a), 128):
            s = a[k : k + 128]
            near = _may_be_near(n, maps, ones, s, b, percent) & (root[s][:, None] != root[b])
            x, y = np.nonzero(near)
            x, y = s[x], b[y]
            for z in range(0, len(x), 1 << 14):
                first = (bands[x[z : z + (1 << 14)]] == bands[y[z : z + (1 << 14)]]).argmax(1) == band
                for p, q in zip(x[z : z + (1 << 14)][first].tolist(), y[z : z + (1 << 14)][first].tolist()):
                    g, h = forest.find(int(root[p])), forest.find(int(root[q]))
                    if g != h:
                        both = _shared(held[p], held[q])
                        if 100 * both >= percent * (n[p] + n[q] - both):
                            forest.up[g] = h
                            found.append((cid[p], cid[q]))
        ends = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"]) if found else None

    return grouped(rows, ["bucket", "i", "j"], ["band", "side", "cid", "root", "bands", "shingles"], block, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, n_shingles, root, component_id, kept: one row for each row of docs.

    root is the same for all rows of a component (null without shingles)."""
    base = written(signed(docs, width, text, doc_id), "signatures")
    slim = base.select("doc_id", "text_hash", "n_shingles", "name", "name2")
    # the copies' signatures are equal: that of the least row stands for the class
    least = F.min(F.struct(F.col("doc_id").alias("id"), "text_hash", F.col("n_shingles").alias("n"), "bands", "map")).alias("r")
    known = F.min("doc_id").alias("least")  # of the ids that aren't null
    classes = base.filter("name is not null").groupBy("name", "name2").agg(least, known)
    ones = sum((F.bit_count(F.col("r.map")[k]) for k in range(MAP_WORDS)), F.lit(0)).cast("long")
    classes = classes.select(F.monotonically_increasing_id().alias("cid"), "name", "name2", "least", "r.id", "r.text_hash", "r.n", ones.alias("ones"), "r.bands", "r.map")
    classes = written(classes, "classes")
    banded = classes.select("cid", F.posexplode("bands").alias("band", "bucket"))
    buckets = written(banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select("bucket"), "buckets", True)
    members = written(banded.join(buckets, "bucket").dropDuplicates(["bucket", "cid"]), "members")
    active = written(classes.join(members.select("cid").distinct(), "cid"), "active")
    discard(buckets)
    sets = full_sets(docs, active, width, text, doc_id)
    about = active.select("cid", F.struct("n", "ones", "map").alias("m"))
    bare, members = members, written(members.join(about, "cid"), "members-with-maps")
    discard(bare)
    links, roots = None, None

    def take(new: DataFrame) -> None:
        nonlocal links, roots
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            roots = written(components(links), "roots", True)

    take(confirmed(centre_pairs(_joined(members, None), 1, 0, percent), sets, percent))
    here = written(_joined(members, roots), "members-joined")
    left = left_buckets(here)
    inside = here.join(left.select("bucket"), "bucket")
    pairs = centre_pairs(inside, 3, 10, percent).unionByName(small_pairs(here, left, percent))
    take(confirmed(pairs, sets, percent))
    discard(here, left)
    here = written(_joined(members, roots), "members-joined")
    left = left_buckets(here)
    blocks = F.col("major"), F.col("rest"), F.col("mine")
    large = here.join(left.filter(f"size > {SMALL}").select("bucket", *blocks), "bucket")
    maps = [F.col("m.map")[k].alias(f"w{k}") for k in range(MAP_WORDS)]
    some = written(with_partners(in_blocks(large).select("bucket", "i", "j", "side", "cid", "root", "m.n", "m.ones", *maps), percent), "with-partners", True)
    again = here.join(some, ["bucket", "cid"])
    left_again = left_buckets(again)
    full = again.join(left_again.select("bucket", *blocks), "bucket").select("bucket", "band", "cid", "root", *blocks)
    whole = sets.join(active.select("cid", "bands"), "cid")
    take(written(joined_in_blocks(in_blocks(full).join(whole, "cid"), percent), "links", True))
    discard(here, left, left_again, some, members, sets)
    own = classes.select("name", "name2", F.col("cid"), "least")
    own = _joined(own, roots)
    component = own.groupBy("root").agg(F.min("least").alias("component_id"))
    own = own.join(component, "root").select(F.col("name").alias("x"), F.col("name2").alias("y"), "root", "component_id")
    out = slim.join(own, (F.col("name") == F.col("x")) & (F.col("name2") == F.col("y")), "left")
    out = out.withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "text_hash", "n_shingles", "root", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, whole, less all but one of each component (the least id, then the least hash of the text).

    Rows without shingles all stay."""
    found = written(near_duplicates(docs, width, percent, text, doc_id), "near-duplicates").filter("root is not null and kept")
    stay = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("s")).select(F.col("s.doc_id").alias("__minhash_id"), F.col("s.text_hash").alias("__minhash_text"))
    wordless = ~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    here = F.col(doc_id).eqNullSafe(F.col("__minhash_id")) & (F.xxhash64(text) == F.col("__minhash_text"))
    chosen = written(docs.filter(~wordless).join(stay.hint("shuffle_hash"), here, "left_semi"), "one-of-each")
    bare = docs.filter(wordless)
    key = F.xxhash64(text)
    twice = written(chosen.groupBy(F.col(doc_id).alias("__minhash_id"), key.alias("__minhash_text")).count().filter("count > 1").drop("count"), "repeated-rows", True)
    if twice.isEmpty():
        return bare.unionByName(chosen)
    again = chosen.withColumn("__minhash_key", key).join(twice, here, "left_semi").dropDuplicates([doc_id, "__minhash_key"]).drop("__minhash_key")
    return bare.unionByName(chosen.join(twice, here, "left_anti")).unionByName(again)


def op10_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents by four-word shingles at 80 percent."""
    return near_duplicates(read(spark, sf_dir, "documents"), 4, 80).select("doc_id", "n_shingles", "component_id", "kept")
