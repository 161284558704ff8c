"""Classifiers by held-out accuracy and edge cases, language-model scores against a plain implementation, the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.llm import ppm, quality, toxicity
from strataflow.llm.common import crc_mod


def plain_ppm(texts, train, order):
    coded = [(b"".join(w + b" " for w in ppm.coded(t).split()) + b"\n") for t in texts]
    counts = defaultdict(Counter)
    for s, use in zip(coded, train):
        s = b"\n" * order + s
        for k in range(order, len(s) if use else 0):
            for j in range(order + 1):
                counts[s[k - j : k]][s[k]] += 1

    def one(context, byte):
        gone, total = set(), 0.0
        for j in range(order, -1, -1):
            c = counts.get(context[order - j :])
            if not c:
                continue
            n, kinds = sum(v for b, v in c.items() if b not in gone), sum(b not in gone for b in c)
            if byte in c:
                return total + math.log10((2 * c[byte] - 1) / (2 * n))
            if kinds:
                total += math.log10(kinds / (2 * n))
            gone |= set(c)
        return total + math.log10(1 / (256 - len(gone)))

    padded = [b"\n" * order + s for s in coded]
    return [sum(one(s[k - order : k], s[k]) for k in range(order, len(s))) for s in padded]


def test_ppm_equals_plain_implementation(spark, odd):
    rng = random.Random(1)
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 7] + [(k, " ".join(rng.choice(("the", "of", "cat", f"w{rng.randint(0, 30)}")) for _ in range(30))) for k in range(20, 60)]
    got = ppm.scores(spark.createDataFrame(rows, "doc_id long, text string"), crc_mod(F.col("doc_id"), 7) == 2).collect()
    train = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2 for i, _ in rows]
    want = plain_ppm([t for _, t in rows], train, ppm.ORDER)
    tokens = [ppm.coded(t).split() + [b"\n"] for _, t in rows]
    c = Counter(x for t, use in zip(tokens, train) if use for x in t)
    n, v = sum(c.values()), len(c)
    base = [sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t) for t in tokens]
    key = lambda r: (str(r[0]), r[1], r[2], round(r[3], 6), round(r[4], 6))
    assert sorted(key((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score)) for r in got) == sorted(key((i, len(t), sum(x in c for x in t), b, s)) for (i, _), t, b, s in zip(rows, tokens, base, want))
    assert {r.train_tokens for r in got} == {n}


def test_ppm_blocks_and_deals_give_one_result(spark, odd, monkeypatch):
    held = crc_mod(F.col("doc_id"), 7) == 2
    key = lambda df: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in df.collect())
    want = key(ppm.scores(odd, held))
    monkeypatch.setattr(ppm, "BLOCK", 2)
    monkeypatch.setattr(ppm, "_GRAMS", 50)
    assert key(ppm.scores(odd.repartition(3, "text"), held)) == want


def test_ppm_lookup_refuses_what_it_does_not_know():
    known = np.array([3, 9, 27], np.int64)
    assert ppm.Lookup(known, np.array([1.0, 2.0, 3.0]))(np.array([27, 3])).tolist() == [3.0, 1.0]
    with pytest.raises(ValueError):
        ppm.Lookup(known, np.array([1.0, 2.0, 3.0]))(np.array([3, 4]))


def test_ppm_probabilities_sum_to_one():
    texts = [b"the cat sat on the mat \n", b"a cat and the hat \n"]
    key, n = ppm._counted(ppm.grams_of(texts))
    for context in np.unique(key >> 8)[:20]:
        g = np.arange(256, dtype=np.int64) + (context << 8)
        every, many = ppm._added([(key, n), (g, np.zeros(256, np.int64))])
        p = 10 ** ppm._at(every, ppm.code_lengths(every, many, {}), g)
        assert abs(p.sum() - 1) < 1e-9


def test_ppm_empty_table_and_no_training(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.scores(none, F.lit(False)).count() == 0
    one = ppm.scores(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).first()
    assert one.n_known == 0 and one.train_tokens == 0 and abs(one.score - 5 * math.log10(1 / 256)) < 1e-9


def made_up(spark, n=900):
    rng, rows, labels = random.Random(5), [], []
    for i in range(n):
        words = [rng.choice("ondet") + rng.choice("aeiou") + rng.choice("rstln") + str(rng.choice(("", "ing", "ed"))) for _ in range(rng.randint(20, 80))]
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(("vilelo", "grumt"))
        rows.append((i, " ".join(words), rng.choice(("en", "de", None)), "s", None))
        if i % 3:
            labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: (r[0] % 5 != 0, r[0] % 7 == 0) for r in rows}


def test_toxicity_held_out(spark):
    docs, labels, truth = made_up(spark)
    model = toxicity.learn(docs, labels, crc_mod(F.col("doc_id"), 5) != 0)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert np.mean([got[i] == int(t[1]) for i, t in truth.items()]) > 0.97


def test_quality_held_out(spark):
    docs, labels, truth = made_up(spark)
    model = quality.learn(docs, labels, crc_mod(F.col("doc_id"), 5) != 0)
    got = {r.doc_id: r.keep for r in quality.score(docs, model).collect()}
    assert np.mean([got[i] == t[0] for i, t in truth.items()]) > 0.97
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


@pytest.mark.parametrize("empty", [False, True])
def test_classifiers_take_odd_rows(spark, odd, labels, empty):
    table = labels.limit(0) if empty else labels
    for got in (quality.score(odd, quality.learn(odd, table)), toxicity.score(odd, toxicity.learn(odd, table))):
        rows = got.collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    if empty:
        assert all(r.keep for r in quality.score(odd, quality.learn(odd, table)).collect()) and not any(r.predicted for r in toxicity.score(odd, toxicity.learn(odd, table)).collect())
    assert quality.score(odd.limit(0), quality.learn(odd, table)).count() == 0


def made_sets(rng, n=3000):
    y = rng.random(n) < 0.2
    x = rng.random((n, 5)) < np.where(y[:, None], [0.8, 0.7, 0.5, 0.5, 0.5], [0.02, 0.1, 0.5, 0.5, 0.5])
    return y, x, [np.flatnonzero(r).astype(np.uint32).tobytes() for r in x]


def test_nnpu_risk_stays_sane():
    y, x, rows = made_sets(np.random.default_rng(1))
    p = toxicity.sets_of([rows[k] for k in np.flatnonzero(y)[:200]], np.ones(200))
    u = toxicity.sets_of(rows[1000:], np.ones(2000))
    w, b = toxicity.nnpu(p, lambda w, b: toxicity.negative_sums(u, w, b), 2000, 5, 0.2)
    assert np.mean(((x @ w + b) > 0) == y) > 0.9


def test_sums_equal_brute_force_on_the_driver_and_by_spark(spark, monkeypatch):
    rng = np.random.default_rng(2)
    _, x, rows = made_sets(rng, 400)
    many = rng.integers(1, 9, 400)
    table = spark.createDataFrame([(bytes(r), int(n)) for r, n in zip(rows, many)], "features binary, n long").repartition(3)
    w, b = rng.standard_normal(5), -0.3
    z = x @ w + b
    want = [(many * np.log1p(np.exp(z))).sum(), *((many / (1 + np.exp(-z)))[:, None] * x).sum(0), (many / (1 + np.exp(-z))).sum()]
    assert np.allclose(toxicity.summed(table)(w, b), want)
    monkeypatch.setattr(toxicity, "MOST_SETS", 10)
    assert np.allclose(toxicity.summed(table)(w, b), want)


def test_all_texts_train_and_copies_count_once(spark):
    """Distinct texts that share common words are all examples; a copied one, whole or nearly, is one."""
    rng = random.Random(8)
    common = [f"common{chr(97 + k)}" for k in range(20)]
    rows = [(i, " ".join(rng.sample(common, 15) + [f"own{chr(97 + i % 26)}{chr(97 + i // 26)}" for _ in range(3)])) for i in range(200)]
    rows += [(i, rows[0][1]) for i in range(200, 260)] + [(i, rows[1][1] + " tail") for i in range(260, 300)] + [(300, rows[2][1])] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names, kept = toxicity.candidates(docs)
    assert 200 <= kept.count() <= 202 and set(names) >= {f"{w} " for w in common}


def test_surest_documents_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (300, quality.WORDS + quality.SHAPES + 2)).astype(np.uint8)
    b = np.column_stack([rng.integers(0, quality.CATEGORIES, (300, 2)), rng.integers(0, 256, (300, 8))]).astype(np.uint8)
    a[200:], b[200:] = a[:100], b[:100]  # copies
    pool = spark.createDataFrame([(x.tobytes(), y.tobytes()) for x, y in zip(a, b)], "a binary, b binary").repartition(5)
    weights = [rng.standard_normal(quality.WORDS + quality.SHAPES + 3) * 3, rng.standard_normal(2 * quality.CATEGORIES + 9) * 3]
    surest = quality.surest_of(pool, 2)
    z = [quality.raw(quality.text_matrix(list(a[:200])), weights[0]), quality.raw(quality.meta_matrix(list(b[:200]), 2), weights[1])]
    first = surest(weights, [set(), set()], (7, 9))
    for v in (0, 1):
        for label, n in ((0, 7), (1, 9)):
            s = z[v] if label else -z[v]
            order = [k for k in np.argsort(-s) if s[k] > 2][:n]
            assert {r[1:] for r in first[v][label]} == {(a[k].tobytes(), b[k].tobytes()) for k in order}
    taken = [{r[0] for label in (0, 1) for r in first[v][label]} for v in (0, 1)]
    again = surest(weights, taken, (7, 9))
    assert all(r[0] not in taken[v] for v in (0, 1) for label in (0, 1) for r in again[v][label])


def test_nominations_take_one_pass(spark, tmp_path):
    spark.range(1000).selectExpr("cast(id % 2 as int) v", "cast(id div 2 % 2 as int) label", "cast(cast(id as string) as binary) key", "id % 37.0D z", "cast('a' as binary) a", "cast('b' as binary) b").write.parquet(f"{tmp_path}/found")
    found = spark.read.parquet(f"{tmp_path}/found")
    best = quality.most(found, (3, 5))
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "WindowGroupLimit" in plan
    want = []
    for v in (0, 1):
        for label, n in ((0, 3), (1, 5)):
            want += sorted((r for r in found.collect() if (r.v, r.label) == (v, label)), key=lambda r: (-r.z, r.key))[:n]
    assert {bytes(r.key) for r in best.collect()} == {bytes(r.key) for r in want} and best.count() == 16


def test_pseudo_labels_cross_views():
    """Labels show the text view alone what to learn; the metadata view learns it from what the text view is sure of."""
    rng = np.random.default_rng(6)
    n, width = 400, quality.WORDS + quality.SHAPES + 2
    y = (rng.random(n) < 0.5).astype(float)
    a = np.zeros((n, width), np.float32)
    a[:, 0], a[:, 1] = y, 1 - y
    b = np.zeros((n, 2 * quality.CATEGORIES + 8), np.float32)  # labelled documents have no metadata that says anything
    seen = []

    def surest(weights, taken, asked):
        seen.append([len(t) for t in taken])
        out = []
        for v in (0, 1):
            sides = []
            for label in (0, 1):
                views = []
                for k in range(asked[label] if v == 0 and len(seen) == 1 else 0):
                    x, m = np.zeros(width, np.uint8), np.zeros(10, np.uint8)
                    x[0 if label else 1], m[0] = 255, 5 if label else 9
                    views.append((bytes([label, k % 256, k // 256]), x.tobytes(), m.tobytes()))
                sides.append(views)
            out.append(tuple(sides))
        return out

    model = quality.co_train(a, b, y, surest, 2, np.arange(n) % 5 == 0)
    text, meta = model.parts[0], model.parts[1]
    assert seen[1][0] > 100 and seen[1][1] == 0  # taken by view 0 for view 1
    assert text[0] > 1 > -1 > text[1] and meta[5] > 1 and meta[9] < -1


def test_pipeline_stages(spark, odd, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
