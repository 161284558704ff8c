"""BPE, packing, media and sharding against their libraries or by recomputation."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from strataflow.llm import bpe, media, packing, sharding

tokenizers = pytest.importorskip("tokenizers")
PIECES = ["a", "b", " ", "  ", "\n", "'s", "'", "'r", "e", "'ll", "é", "١", "½", "_", "!", "\x1c", "\x85", " ", "​", "中文", "🙂", "<|endoftext|>", "<|endof", "The", " the", "1", "23", "\r\n", "́", "\x00"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(library):
    rng, e = random.Random(3), bpe.encoder()
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    assert [e.encode(t) for t in texts] == [ids(library, t) for t in texts]


def test_streaming_equals_library_in_constant_memory(library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 16)
    monkeypatch.setattr(bpe, "STEP", 8)
    rng, e = random.Random(4), bpe.encoder()
    texts = ["a" * 3000, "!" * 900, " " * 900 + "x", "\n" * 700, "the" * 900, "1" * 300 + "'re" * 40]
    texts += ["".join(rng.choice("aeinthrso") for _ in range(2000)) for _ in range(4)]
    texts += ["".join(rng.choice(PIECES) for _ in range(40)) for _ in range(200)]
    for t in texts:
        got = [i for part in e.stream(t[k : k + 16] for k in range(0, len(t), 16)) for i in part]
        assert got == ids(library, t), t[:40]


def test_lookahead_is_bounded():
    assert 1 < bpe.encoder().lookahead < 1000


def test_decoder_equals_library(library):
    rng, v = random.Random(5), bpe.encoder().vocabulary
    for _ in range(300):
        x = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        d = bpe.Decoder(v)
        assert "".join(d.feed([i]) for i in x) + d.feed((), True) == library.decode(x, skip_special_tokens=False)


def test_round_trip_rows(spark, odd, library):
    rows = bpe.round_trip(odd).collect()
    assert len(rows) == odd.count()
    want = sorted((str(r.doc_id), len(i := ids(library, r.text)), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert bpe.round_trip(odd.limit(0)).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(odd)).collect()
    assert sorted(r.text for r in back) == sorted(r.text or "" for r in odd.collect())


def test_packing(spark, odd, library):
    rows = packing.pack(odd).collect()
    by, places = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and p[0][0] == 0 and sum(n for _, n in p) <= 1024
    x = np.array([*ids(library, "x" * 30_000), 2], "<u4")
    assert [(r.start, r.ids_crc32) for r in sorted(by[7], key=lambda r: r.piece)] == [(s, zlib.crc32(x[s : s + n].tobytes())) for s, n in [(0, len(x) % 1024 or 1024)] + [(s, 1024) for s in range(len(x) % 1024 or 1024, len(x), 1024)]]
    assert len(by[1]) == 2 and len(by[2]) == 1
    assert packing.pack(odd.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_histogram_is_used_exactly(seed):
    rng = np.random.default_rng(seed)
    h = {int(k): int(v) for k, v in zip(rng.choice(np.arange(1, 257), 80, False), rng.integers(1, 400, 80))}
    plan, used = packing.pack_histogram(h, 256), {}
    for lengths, many in plan:
        assert sum(lengths) <= 256 and many > 0
        for v in lengths:
            used[v] = used.get(v, 0) + many
    assert used == h
    n, least = sum(m for _, m in plan), -(-sum(k * v for k, v in h.items()) // 256)
    assert n <= max(least * 1.06 + 2, sum(m for _, m in packing.best_fit(np.array([h.get(k, 0) for k in range(257)]), 256)) * 1.02 + 2)


def test_media(spark, odd, tmp_path):
    folder = f"file://{tmp_path}/a"
    manifest = media.write_archives(odd, folder, archive_bytes=200)
    read = media.read_archives(spark, folder, manifest, rangeBytes=150)
    rows = media.media_features(read).collect()
    want = sorted((str(r.doc_id) if r.doc_id is not None else "None", n, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for r in odd.collect() for p, n in [media.payload_of(r.text)])
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in ("1", "9")}) == 1
    empty = media.write_archives(odd.limit(0), f"{folder}-0")
    assert media.read_archives(spark, f"{folder}-0", empty).count() == 0


def test_media_is_what_another_decoder_reads(spark):
    """The JDK's own image reader gives the payload, sample by sample."""
    for text in ("", "abc", "x" * 64, "naïve 中文 " * 50):
        payload, n = media.payload_of(text)
        png = media.to_png(payload, n)
        jvm = spark._jvm
        image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(png))
        assert (image.getWidth(), image.getHeight()) == (64, len(payload) // 64)
        got = image.getRaster().getDataBuffer().getData()
        assert bytes(got) == payload and payload[:n] == text.encode() and not any(payload[n:])


def test_unreadable_directory(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string").repartition(2)
    folder = f"file://{tmp_path}/a"
    manifest = media.write_archives(docs, folder)
    files = sorted((tmp_path / "a").glob("*.zip"))
    assert len(files) == 2
    files[0].write_bytes(files[0].read_bytes()[:40])
    rows = media.read_archives(spark, folder, manifest, onError="row", tries=2).collect()
    assert sorted((r.doc_id is None, r.error is not None, r.payload is None) for r in rows) == [(False, False, False), (True, True, True)]


def test_media_member_retry(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string").coalesce(1)
    folder = f"file://{tmp_path}/a"
    manifest = media.write_archives(docs, folder)
    (file,) = (tmp_path / "a").glob("*.zip")
    data = bytearray(file.read_bytes())
    data[data.index(b"IDAT") + 6] ^= 255
    file.write_bytes(data)
    rows = {r.doc_id: r for r in media.read_archives(spark, folder, manifest, onError="row", tries=2).collect()}
    assert rows["1"].error and rows["1"].payload is None and rows["2"].payload[:3] == b"two"
    with pytest.raises(Exception):
        media.read_archives(spark, folder, manifest, tries=1).collect()


def test_min_cost_flow_moves_least():
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randint(1, 6)
        supply = [rng.randint(0, 50) for _ in range(n)]
        caps = sharding.equal_capacities(sum(supply), n)
        flow = sharding.min_cost_flow(supply, caps, [[int(i != j) for j in range(n)] for i in range(n)])
        assert [sum(f) for f in flow] == supply and all(sum(f[j] for f in flow) <= caps[j] for j in range(n))
        assert sum(flow[i][j] for i in range(n) for j in range(n) if i != j) == sum(max(0, s - c) for s, c in zip(supply, caps))


def test_resharding(spark, odd, tmp_path):
    from pyspark.sql import functions as F

    rows = sharding.reshard(odd, F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % 3, 3).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(r.doc_id), len(b) + 1, zlib.crc32(b)) for r in odd.collect() for b in [(r.text or "").encode()])
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.reshard(odd.limit(0), F.lit(0), 3).count() == 0
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat('w', int(10 + id % 90))").alias("text"))
    placed = sharding.reshard(docs, F.when(F.col("doc_id") < 300, 0).otherwise(F.lit(1)), 4)
    size = [r[0] for r in placed.groupBy("shard").sum("size").select("sum(size)").collect()]
    assert len(size) == 4 and max(size) - min(size) <= 200
    touched = sharding.rewrite_affected(docs, placed, str(tmp_path / "out"))
    assert touched == [0, 1, 2, 3] and spark.read.parquet(str(tmp_path / "out")).count() == 400


def test_rewriting_leaves_other_shards(spark, tmp_path):
    """Shards 0 and 1 exchange rows, 3 loses all of its rows, 2 isn't affected; an id is repeated."""
    from pyspark.sql import functions as F

    path = str(tmp_path / "out")
    rows = [(1, "a", 0, 0), (1, "a", 0, 1), (1, "bb", 0, 0), (None, "c", 1, 0), (4, "d", 2, 2), (5, "e", 3, 1)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, old int")
    docs.withColumn("shard", F.col("old")).write.partitionBy("shard").parquet(path)
    body = F.col("text").cast("binary")
    placed = spark.createDataFrame(rows, "doc_id long, text string, old_shard int, shard int").select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), "old_shard", "shard", (F.col("old_shard") != F.col("shard")).alias("moved"))
    assert sharding.rewrite_affected(docs, placed, path, old_shard=F.col("old")) == [0, 1, 3]
    got = spark.read.schema("doc_id long, text string, old int, shard int").parquet(path).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, rows))


def test_resharding_reads_files_back(spark, odd):
    from pyspark.sql import functions as F

    docs, old = odd.drop("shard"), F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % 3
    columns = ["doc_id", "size", "text_crc32", "old_shard", "shard", "slot", "moved"]
    plain = lambda df: sorted(str(tuple(r)) for r in df.select(columns).collect())
    assert plain(sharding.resharded_files(docs, old, 3)) == plain(sharding.reshard(docs, old, 3))
    assert sharding.resharded_files(docs.limit(0), old, 3).count() == 0


def test_many_equal_rows_are_resharded(spark, monkeypatch, tmp_path):
    """A third of the rows and more are equal: no task or array holds them all, sizes and slots stay right."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(sharding, "HOT", 50)
    same = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x").alias("text"), F.lit("s").alias("source"))
    docs = same.unionByName(spark.range(20_000).select(F.col("id").alias("doc_id"), F.expr("repeat('w', int(1 + id % 7))").alias("text"), F.concat(F.lit("s"), F.col("id") % 5).alias("source")))
    out = sharding.resharded_files(docs, F.crc32(F.col("source").cast("binary")) % 8, 8)
    rows = out.toPandas()
    assert len(rows) == 60_000 and sorted(rows.groupby(rows["doc_id"].isna()).size()) == [20_000, 40_000]
    size = rows.groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() - size.min() <= 16
    for _, part in rows.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert ((rows["old_shard"] != rows["shard"]) == rows["moved"]).all()


def test_equal_rows_are_numbered_in_parts(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(sharding, "HOT", 50)
    rows = sharding._numbered(spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 40).alias("h")), "h").toPandas()
    for _, part in rows.groupby("h"):
        assert sorted(part["__k"]) == list(range(1, len(part) + 1))


def test_op8_query(spark):
    """The registered query, with shards that the flow leaves as they are."""
    out = sharding.op8_flow_resharding(spark, "/root/testdata/sf0.001").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    assert sorted(out["doc_id"]) == sorted(docs["doc_id"])
    crc = {i: zlib.crc32((t or "").encode()) for i, t in zip(docs["doc_id"], docs["text"])}
    assert all(crc[i] == c for i, c in zip(out["doc_id"], out["text_crc32"]))
    assert sorted(out["shard"].unique()) == list(range(8)) and (out["law"] == "bytes").all()


def test_native_and_streaming_ids_agree(library, monkeypatch):
    rng, fast = random.Random(9), packing.FastIds()
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    whole = [fast(t).tolist() for t in texts]
    monkeypatch.setattr(packing, "WHOLE", 3)
    assert whole == [fast(t).tolist() for t in texts] == [ids(library, t) for t in texts]


def least_squares(a, y):
    """Least squared distance over x >= 0 by trying every set of positive columns."""
    best = float((y**2).sum())
    for mask in range(1, 1 << a.shape[1]):
        c = [k for k in range(a.shape[1]) if mask >> k & 1]
        x, *_ = np.linalg.lstsq(a[:, c], y, rcond=None)
        if (x >= -1e-9).all():
            best = min(best, float(((a[:, c] @ x - y) ** 2).sum()))
    return best


@pytest.mark.parametrize("seed", range(5))
def test_fit_is_optimal(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.choice(np.arange(1, 24), 9, False))
    found = packing.triples(lengths, 24)
    found = found[rng.permutation(len(found))[:10]]
    counts = np.zeros(25)
    counts[lengths] = rng.integers(0, 60, len(lengths))
    a = np.zeros((25, len(found)))
    for p, row in enumerate(found):
        for v in row[row > 0]:
            a[v, p] += 1
    x = packing.fit(found, counts)
    got = float(((a @ x - counts) ** 2).sum())
    assert (x >= 0).all() and got <= least_squares(a, counts) + 1.0


def most_packed(h, capacity):
    """The fewest sequences by exhaustive search over how the longest piece's sequence is filled."""
    from functools import cache

    @cache
    def need(left):
        if not any(n for _, n in left):
            return 0
        top = max(v for v, n in left if n)
        best = 99

        def fill(rest, room, most):
            nonlocal best
            best = min(best, 1 + need(tuple(rest.items())))
            for v in list(rest):
                if rest[v] and v <= room and v <= most:
                    fill({**rest, v: rest[v] - 1}, room - v, v)

        rest = dict(left)
        rest[top] -= 1
        fill(rest, capacity - top, top)
        return best

    return need(tuple(sorted(h.items())))


@pytest.mark.parametrize("seed", range(6))
def test_packing_of_few_pieces_is_nearly_the_fewest(seed):
    rng = np.random.default_rng(seed)
    h = {int(v): int(rng.integers(1, 3)) for v in rng.choice(np.arange(2, 20), 6, False)}
    assert most_packed(h, 20) <= sum(m for _, m in packing.pack_histogram(h, 20)) <= most_packed(h, 20) + 1


def test_many_pieces_of_one_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    docs = spark.range(100).selectExpr("id as doc_id", "'same words here' as text").repartition(5)
    rows = packing.pack(docs, capacity=20).collect()
    places = {(r.sequence_id, r.offset) for r in rows}
    assert len(rows) == len(places) == 100 and len({r.sequence_id for r in rows}) == -(-100 // (20 // rows[0].length))


def test_blocks_grow_with_documents(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(sharding, "BLOCKS", 4)
    monkeypatch.setattr(sharding, "DOCS_A_BLOCK", 16)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.expr("repeat('w', int(10 + id % 90))").alias("text"))
    placed = sharding.reshard(docs, F.lit(0), 4).collect()
    size = [sum(r.size for r in placed if r.shard == s) for s in range(4)]
    assert max(size) - min(size) <= 200 and sorted((r.shard, r.slot) for r in placed) == [(s, k) for s in range(4) for k in range(sum(r.shard == s for r in placed))]
