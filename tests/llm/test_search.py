"""Operators 11 and 12 against brute force."""

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataflow.llm import collocations, hnsw

SF = "/root/testdata/sf0.001"


def brute(rows, every, k=10):
    """query -> [(score, vec_id)] of the k nearest, from (vec_id, vector) rows."""
    out = {}
    rows = [(i, np.asarray(v, float)) for i, v in rows]
    for q, v in rows:
        if q is None or q % every:
            continue
        near = {}
        for i, w in rows:
            if i != q and len(w) == len(v):
                d = float(np.sqrt(((w - v) ** 2).sum()))
                near[i] = min(d, near.get(i, d))
        best = sorted((d, i is None, i) for i, d in near.items())
        out.setdefault(q, []).extend((d, i) for d, _, i in best[:k])
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    return out


def test_graph_search_over_shards(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 200)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 12)) + 4 * rng.integers(0, 5, 1500)[:, None]
    x[700:760] = x[700]  # copies
    x[800:830] = x[800] + rng.normal(size=(30, 12)) * 1e-6
    df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    measured = []
    got, want = found(hnsw.nearest(df, lambda i: i % 20 == 0, measured=measured)), brute(rows, 20)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert hits >= 0.95 * 10 * len(want) and measured[-1][1] >= hnsw.RECALL
    true = {(q, i): np.sqrt(((x[q].astype(np.float32).astype(float) - x[i].astype(np.float32).astype(float)) ** 2).sum()) for q in got for _, i in got[q]}
    for q, near in got.items():
        assert near == sorted(near) and all(s == pytest.approx(true[q, i], abs=1e-12) for s, i in near)
    assert [i for _, i in got[700]] == list(range(701, 711)) and [i for _, i in got[720]] == list(range(700, 710))  # ties to smaller ids


def test_search_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], "a"), (0, [1.0, 0.0], "a"), (100, [1.0, 1.0], None), (7, [1.0, 0.5], "b"), (8, None, "b"), (9, [], "b"), (10, [0.0, 0.0], "b"), (11, [1.0, None], "b"), (12, [float("inf"), 1.0], "b"), (13, [1.0, 2.0, 3.0], "b"), (None, [1.0, 0.25], "b"), (200, [float("nan"), 1.0], "b"), (300, [5.0, 5.0, 5.0], "b")]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<double>, label string, cell string, rank int")
    got = found(hnsw.nearest(df, lambda i: i % 100 == 0))
    assert got == {0: [(0.25, None), (0.5, 7), (1.0, 100)], 100: [(0.5, 7), (0.75, None), (1.0, 0)], 300: [(pytest.approx(np.sqrt(29.0)), 13)]}
    assert hnsw.nearest(df.limit(0), lambda i: i % 100 == 0).count() == 0


def test_op11_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got, want = found(hnsw.op11_hnsw(spark, SF)), brute(rows, 100)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert got.keys() == want.keys() and hits >= 0.9 * sum(map(len, want.values()))


def phrases(rows, least=10, share=50, top=2000):
    """The operator's contract, word by word."""
    count, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i : i + k])
                    count[key] = count.get(key, 0) + 1
    out = {}
    for (lang, p), a in count.items():
        if len(p) < 2 or a < least:
            continue
        cuts = [(1000000 * a * a // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        longer = [b for (m, q), b in count.items() if m == lang and len(q) > len(p) and b >= least and p in (q[:2], q[1:])]
        if any(100 * b >= share * a for b in longer):
            continue
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    return {(lang, i + 1, w.decode(), -a, l, r, n[lang], -s) for lang, held in out.items() for i, (s, a, w, l, r) in enumerate(sorted(held)[:top])}


def told(df):
    return {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


@pytest.mark.parametrize("small", [False, True])
def test_collocations_equal_brute_force(spark, monkeypatch, small):
    if small:  # long texts are cut, shards are many, tasks forget what they told
        for name, value in {"CHUNK": 40, "MOST_PATTERNS": 7, "BLOCK": 600, "SLAB": 50, "WORDS": 5, "MET": 3, "LEAST_BITS": 12}.items():
            monkeypatch.setattr(collocations, name, value)
    rng = np.random.default_rng(6)
    words = ["The", "the", "of", "Éa", "x", " y", "zz", "a.b", "\x1cq"]
    rows = [(None if k % 9 == 0 else "en" if k % 3 else "fr", "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", "\n", ",", " ! "], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]) for _ in range(rng.integers(0, 60)))) for k in range(60)]
    rows += [("en", "of the one of the one of the one " * 40), ("en", None), ("fr", ""), ("de", " \t .;\n"), ("de", "wort " * 3000), ("fr", "x" * 30_000 + " the of the")]
    df = spark.createDataFrame([(*r, i, 4) for i, r in enumerate(rows)], "lang string, text string, doc_id long, n int").repartition(5)
    assert told(collocations.collocations(df)) == phrases(rows)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(df).count() == 0
    with pytest.raises(ValueError, match="least"):
        collocations.collocations(df, least=0)


def test_bounds_are_never_too_low(spark):
    """Every phrase that occurs often enough has its bit set."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = collocations.prepared(docs, "text", "lang")
    bits, least = 18, 10
    bitmap = bytearray(1 << (bits - 3))
    for block, held in collocations.reached(collocations.sketched(pieces, bits, least), bits, least).collect():
        bitmap[block << (bits - 11) : (block + 1) << (bits - 11)] = held
    seen = Counter()
    for lang, text in [(r["lang"], r["text"]) for r in docs.collect()]:
        whole = collocations.tokens(text)
        spans = collocations.Spans(lang or "und", b" %b " % b" ".join(whole))
        for size, keys, ok in zip((1, 2, 3), (spans.one, spans.two, spans.three), collocations.heavy(spans, bytes(bitmap), bits)):
            for i in np.flatnonzero(keys):
                seen[lang, b" ".join(whole[i : i + size]), bool(ok[i])] += 1
    assert all(n < least for (_, _, ok), n in seen.items() if not ok) and any(n >= least for n in seen.values())


def test_sketches_travel_packed(spark):
    """Counters of a slab take far fewer bytes than one a counter for the gap and one for the count."""
    pieces = collocations.prepared(spark.read.parquet(f"{SF}/documents.parquet"), "text", "lang")
    marks = collocations.sketched(pieces, 20, 10).collect()
    assert sum(len(m["at"]) + len(m["many"]) for m in marks) < 0.8 * sum(2 * m["size"] for m in marks)


def test_large_rows_reach_tasks_few_at_a_time(spark):
    """Pieces of 128 kB: a batch for Python and one of the reader hold a few MB of them, and the settings come back."""
    docs = spark.range(0, 120, 1, 1).selectExpr("repeat(concat('w', id, ' '), 40000) AS text", "'en' AS lang")
    pieces = collocations.written(collocations.prepared(docs, "text", "lang"), "pieces")
    assert pieces.count() > 100

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["bytes"])

    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(k) for k in keys]
    with collocations.small_batches(spark):
        sizes = [r["bytes"] for r in pieces.select("text").mapInArrow(run, "bytes long").collect()]
        assert int(spark.conf.get(keys[2])) * collocations.CHUNK <= 4 << 20
    assert max(sizes) < 8 << 20 < sum(sizes)
    assert [spark.conf.get(k) for k in keys] == before
    assert pieces.filter("size != octet_length(text)").isEmpty()
    collocations.discard(pieces)


def test_op12_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert told(collocations.op12_collocations(spark, SF)) == {tuple(r) for r in con.execute(f"SELECT {', '.join(names)} FROM ({collocations.ORACLE})").fetchall()}
