"""Near duplicates and repeated passages against brute force."""

import math
import random
import re

import numpy as np
import pytest

from strataflow.llm import components, linededup, minhash, neighbours
from strataflow.llm.shingles import shingle_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return [rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(rng.randint(0, 60)) for _ in range(n)]


def closure(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [tuple(rng.sample(range(200, 400), 2)) for _ in range(120)]
    rows = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = closure({x for e in edges for x in e}, edges)
    assert {r.node: r.root for r in rows} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def texts():
    rng, out = random.Random(7), []
    for g in range(12):
        base = prose(rng, 80)
        for c in range(rng.choice((1, 2, 5, 25))):
            words = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                words[rng.randrange(80)] = f"new{rng.random()}"
            out.append(" ".join(words))
    out += ["one two", "ONE two", "", "   ", "a b c", *[" ".join(prose(rng, 60)) for _ in range(20)]]
    rng.shuffle(out)
    return list(enumerate(out))


def test_near_duplicates_equal_brute_force(spark, texts):
    docs = spark.createDataFrame([*texts, (1000, None)], "doc_id long, text string").repartition(5)
    rows = {r.doc_id: r for r in minhash.near_duplicates(docs, 4, 80).collect()}
    sets = {}
    for i, t in texts:
        w = WORD.findall(t.lower())
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closure(sets, linked)
    assert {i: (rows[i].n_shingles, rows[i].component_id, rows[i].kept) for i in sets} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert (rows[1000].n_shingles, rows[1000].component_id, rows[1000].kept) == (0, 1000, True)
    one = minhash.one_of_each(docs, 4, 80)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted([i for i in want if want[i] == i] + [1000])


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and {r.component_id for r in rows if r.doc_id in (1, 9)} == {1}
    kept = minhash.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "None", "5", "6", "7", "8"])
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_shingles():
    assert len(shingle_hashes(b"a b c d e", 4)) == 2 and len(shingle_hashes(b"a b", 4)) == 1 and len(shingle_hashes(b" \n", 4)) == 0
    assert np.array_equal(shingle_hashes(b"A b\x0bC", 4), shingle_hashes(b" a B c ", 4))


def removed(rows, least):
    seen, texts, out = set(), {}, {}
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        if t in texts and len(w) >= least:
            gone = [True] * len(w)
        elif t not in texts:
            texts[t] = i
            for k in range(len(w) - least + 1):
                key = tuple(w[k : k + least])
                if key in seen:
                    gone[k : k + least] = [True] * least
                seen.add(key)
        out[i] = [x for x, g in zip(w, gone) if not g]
    return out


def test_repeats_equal_brute_force(spark):
    rng = random.Random(9)
    passages = [prose(rng, rng.randint(45, 90)) for _ in range(6)]
    rows = []
    for i in range(60):
        words = prose(rng, rng.randint(0, 60))
        for p in rng.sample(passages, rng.choice((0, 1, 1, 2))):
            at = rng.randint(0, len(words))
            words[at:at] = p
        if i % 9 == 0:
            words += ["again", "and"] * 40
        rows.append((i, "".join(w + rng.choice((" ", "\n", "  ")) for w in words)))
    rows += [(70, rows[3][1]), (71, rows[3][1]), (72, None), (73, ""), (74, "short text")]
    got = {r.doc_id: r for r in linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), report=True).collect()}
    want = removed(rows, 50)
    assert {i: WORD.findall(r.text or "") for i, r in got.items()} == want
    assert all(r.n_words - r.deleted_words == len(want[i]) for i, r in got.items()) and got[72].text is None


def test_repeats_of_odd_rows(spark, odd):
    rows = linededup.deduplicated(odd)
    assert rows.columns == odd.columns and rows.count() == odd.count() and linededup.deduplicated(odd.limit(0)).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(20):
        centre = rng.standard_normal(16)
        for _ in range(rng.choice((1, 2, 30))):
            rows.append((len(rows), [float(v) for v in np.float32(centre + 0.12 * rng.standard_normal(16))], int(c % 3)))
    rows += [(len(rows), rows[0][1], rows[0][2]), (len(rows) + 1, None, 1), (len(rows) + 2, [0.0] * 16, 1), (len(rows) + 3, [float("nan")] * 16, 1), (len(rows) + 4, rows[0][1], None), (len(rows) + 5, [1.0, None], 1), (len(rows) + 6, [], 1)]
    got = {r.vec_id: r for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    ok = [(i, np.array(e, float) / np.linalg.norm(e), l) for i, e, l in rows if e and l is not None and None not in e and np.isfinite(e).all() and any(e)]
    linked = [(i, j) for i, a, l in ok for j, b, m in ok if i < j and l == m and a @ b >= 0.93]
    want = closure([r[0] for r in rows], linked)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_links for i, r in got.items()} == {i: sum(i in p for p in linked) for i in want}
    assert neighbours.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_links_between_clumps(spark):
    """Each vector has more near neighbours in its own clump than a list holds, and every pair across is a link too."""
    rng = np.random.default_rng(8)
    a, b = np.eye(16)[0], 0.945 * np.eye(16)[0] + (1 - 0.945**2) ** 0.5 * np.eye(16)[1]
    rows = [(k, [float(v) for v in np.float32((a, b)[k % 2] + 0.003 * rng.standard_normal(16))], 1) for k in range(60)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert (x @ x.T).min() >= 0.93
    got = neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(59, 0)}


def clumped(n_clumps, n_lone, seed):
    """Vectors of one label: clumps of 3 to 250 with spreads around the threshold, and others alone."""
    rng = np.random.default_rng(seed)
    x = [rng.standard_normal((n_lone, 24))]
    for size in rng.choice((3, 10, 40, 250), n_clumps, p=(0.5, 0.3, 0.17, 0.03)):
        x.append(rng.standard_normal(24) + rng.uniform(0.05, 0.4) * rng.standard_normal((size, 24)))
    x = np.float32(np.concatenate(x))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    return [(i, [float(c) for c in v], 1) for i, v in enumerate(x)], [tuple(p) for p in np.argwhere(np.triu(u @ u.T >= 0.93, 1)).tolist()]


def test_thousands_of_a_label_descend_to_brute_force(spark, monkeypatch):
    """Far more vectors than a bucket, links beyond LIST and beyond MOST_LIST: what the lists alone find, and the result."""
    rows, links = clumped(120, 1500, 3)
    degree = np.bincount(np.array(links).ravel(), minlength=len(rows))
    assert len(rows) > 3000 and degree.max() > neighbours.MOST_LIST and ((degree > neighbours.LIST) & (degree < neighbours.MOST_LIST)).sum() > 50
    asked = []
    blocks = neighbours.compared
    monkeypatch.setattr(neighbours, "AUDITED", 200)
    monkeypatch.setattr(neighbours, "compared", lambda members, threshold: asked.append(members.filter("asked").count()) or blocks(members, threshold))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = {r.vec_id: r for r in neighbours.near_duplicates(df).collect()}
    assert len(asked) == 1 and asked[0] < len(rows) / 4, "only full lists and the audited go through blocks"
    have = np.array([got[i].n_links for i in range(len(rows))])
    assert (have <= degree).all() and have.sum() >= 0.99 * degree.sum()
    assert {i: r.component_id for i, r in got.items()} == closure(range(len(rows)), links)


def test_failed_audit_ends_exact(spark, monkeypatch):
    """Lists that never get anywhere: more trees, then every node by blocks."""
    rows, links = clumped(20, 300, 5)
    monkeypatch.setattr(neighbours, "projected", lambda nodes, trees: spark.createDataFrame([], "u long, v long, sim double"))
    got = {r.vec_id: r for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: sum(i in p for p in links) for i in got}
    assert {i: r.component_id for i, r in got.items()} == closure(range(len(rows)), links)


def test_embeddings_in_double_precision_repeats_and_clashes(spark):
    """Doubles that float32 would move over the threshold, repeated and null ids, columns named like the operator's own."""
    turn = math.acos(0.93)
    pair = lambda a: [math.cos(a), math.sin(a)]
    rows = [(1, pair(0.0), 1, 0, 0.5), (2, pair(turn * (1 - 1e-9)), 1, 0, 0.5), (3, pair(10.0), 1, 0, 0.5), (4, pair(10.0 + turn * (1 + 1e-9)), 1, 0, 0.5), (5, pair(20.0), 1, 0, 0.5), (5, pair(20.0), 1, 0, 0.5), (None, [1e300, 1e300], 2, 0, 0.5)]
    got = neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node int, sim double")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got if r.vec_id) == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 1, 5), (5, 1, 5)]
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]


def linked(rows, width=4):
    """Components by brute force: 100 * intersection >= 80 * union of the shingle sets."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(t.lower())
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    near = []
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                near.append((a, b))
    return closure(sets, near)


def test_pairs_hidden_by_boilerplate(spark):
    """Texts of one boilerplate agree at 0.785, partners at 0.82: mostly in buckets that hold hundreds of others too."""
    rng = random.Random(6)
    new = lambda n: [f"w{rng.random()}" for _ in range(n)]
    same, rows = new(193), []
    for g in range(300):
        shared = new(5)
        rows += [(2 * g + k, " ".join(same + shared + new(21))) for k in range(2)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i, _ in rows}


@pytest.mark.parametrize("side", [512, 40])
def test_mutants_of_one_text(spark, monkeypatch, side):
    """Each text has four words of 200 replaced, so some pairs are links, and all stand in large buckets; blocks of any side."""
    monkeypatch.setattr(minhash, "SIDE", side)
    rng, base, rows = random.Random(12), [f"b{k}" for k in range(200)], []
    for i in range(900):
        words = list(base)
        for k in rng.sample(range(200), 4):
            words[k] = f"new{rng.random()}"
        rows.append((i, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == linked(rows)


def test_repeated_and_missing_ids(spark):
    """Rows of one id, or of none, are told apart by their texts; copies of one row stay one by one in the result."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(7, text)] * 40 + [(None, text + " more")] * 40 + [(7, " ".join(f"v{k}" for k in range(60)))] * 3 + [(None, f"alone {k}") for k in range(50)] + [(1, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = minhash.near_duplicates(docs, 4, 80).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(7, 1, False), (None, 1, False), (7, 7, True), (None, None, True), (1, 1, True)}
    assert sorted((str(r.doc_id), r.text[:5]) for r in minhash.one_of_each(docs, 4, 80).collect()) == sorted([("1", "w0 w1"), ("7", "v0 v1"), *(("None", "alone") for _ in range(50))])


def test_bit_maps_never_rule_out_links():
    rng = np.random.default_rng(3)
    for n in (1, 5, 100, 3000):
        for shared in range(0, n + 1, max(1, n // 20)):
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.int64).astype(np.uint64) * np.uint64(2)
            x, y = np.unique(pool[:n]), np.unique(pool[n - shared : 2 * n - shared])
            held, size = np.array([minhash.bit_map(x), minhash.bit_map(y)]), np.array([len(x), len(y)])
            near = minhash._may_be_near(size, held, np.bitwise_count(held).sum(1, dtype=np.int64), np.array([0]), np.array([1]), 80)[0, 0]
            both = len(np.intersect1d(x, y))
            assert near or 100 * both < 80 * (len(x) + len(y) - both)


@pytest.mark.parametrize("hot", [4096, 3])
def test_repeats_of_common_passages(spark, monkeypatch, hot):
    """A line and a passage that most documents share, whole and in part; a fingerprint of many positions, or of few."""
    monkeypatch.setattr(linededup, "HOT", hot)
    rng = random.Random(21)
    line, passage, rows = prose(rng, 30), prose(rng, 120), []
    for i in range(80):
        words = prose(rng, rng.randint(0, 70))
        for piece in rng.sample([line, passage, passage[: rng.randint(30, 110)], passage[rng.randint(5, 60) :]], rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = piece
        rows.append((i, " ".join(words)))
    rows += [(90, " ".join(prose(rng, 20) * 300))]  # long, and repeats itself
    again = [rows[0], rows[0], rows[40], rows[90 - 10]]  # repeated rows, which are one document each
    got = {r.doc_id: r for r in linededup.deduplicated(spark.createDataFrame(rows + again, "doc_id long, text string").repartition(4), report=True).collect()}
    assert {i: WORD.findall(r.text) for i, r in got.items()} == removed(rows, 50)


def test_fingerprints_of_a_text_longer_than_a_stretch(monkeypatch):
    rng = random.Random(2)
    text = " ".join(prose(rng, 900)).encode()
    want = linededup.Batch([text]).windows(50, 25)
    monkeypatch.setattr(linededup, "STRETCH", 64)
    got = linededup.Batch([text]).windows(50, 25)
    assert all(np.array_equal(a, b) for a, b in zip(got, want)) and ((got[1] >= got[0]) & (got[1] <= got[0] + 25)).all()
