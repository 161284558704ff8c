"""Operator 3: quality by co-training of a text-content and a page-metadata classifier.

Two views of a document: what its words look like (word and word-shape hashes, repetition), and its metadata (source,
language, length and the layout of the page: lines, and shares of kinds of characters). Each view has a logistic
classifier of its own. In each round, each view names the unlabelled documents it is surest of, of both classes, and the
other view learns them as labelled. At last each view is calibrated on labelled documents that were kept apart, the
calibrated log-odds are combined by a logistic model on the same documents, and every document is scored.

The labelled set is a bounded sample (MOST_LABELLED: a documented bound, least hash of the id first). The unlabelled pool is
every other document that may be learnt from: each round passes over all of their features, which are computed once and
kept as a byte a number; a task gives its surest documents, of those alike one, and the surest of all are taken.

Cases: null and empty texts have zero features and are scored; null metadata is a category of its own; texts of any length
count whole; equal rows score alike; with no label, or labels of one class, every text scores 1 (nothing is rejected
without a counterexample); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BoundedCache, crc_mod, discard, least_hashed, read, written

#: Bound of the labelled sample (documents).
MOST_LABELLED = 6000
ROUNDS, EACH = 5, 200
#: Hash buckets of words and of word shapes, and of each metadata category.
WORDS, SHAPES, CATEGORIES = 256, 128, 64
META = ("source", "lang")
#: Documents below this probability of being good are rejected: a wrong rejection weighs three times a wrong acceptance.
KEEP_FROM = 0.25

_kinds = ((re.compile(r"[a-z]+"), "a"), (re.compile(r"[A-Z]+"), "A"), (re.compile(r"[^\W\d_]+"), "l"), (re.compile(r"\d+"), "0"))


def _shape(word: str) -> str:
    """Runs of ASCII lower case, upper case, other letters and digits as one sign each; the rest, repeats once, as is."""
    out, at = [], 0
    while at < len(word) and len(out) < 12:
        for pattern, sign in _kinds:
            if m := pattern.match(word, at):
                out.append("A" if sign == "l" and m[0].isupper() else "a" if sign == "l" else sign)
                at = m.end()
                break
        else:
            out.append(word[at])
            at += 1
    return "".join(c for k, c in enumerate(out) if k == 0 or c != out[k - 1])


def _places(word: str) -> int:
    return (zlib.crc32(word.lower().encode()) % WORDS) | (zlib.crc32(_shape(word).encode()) % SHAPES) << 16


_cache = BoundedCache(_places)


def text_view(text: str | None) -> np.ndarray:
    """WORDS + SHAPES root shares of word and shape hashes, then repetition, in 255ths."""
    out = np.zeros(WORDS + SHAPES + 2, np.float32)
    words = text.split() if text else []
    if words:
        at = np.fromiter(map(_cache.__getitem__, words), np.int64, len(words))
        out[:WORDS] = np.bincount(at & 0xFFFF, minlength=WORDS)
        out[WORDS : WORDS + SHAPES] = np.bincount(at >> 16, minlength=SHAPES)
        out[:-2] = np.sqrt(out[:-2] / len(words))
        out[-2] = np.count_nonzero(at[1:] == at[:-1]) / len(words)
        out[-1] = len(set(words)) / len(words)
    return np.rint(out * 255).astype(np.uint8)


_signs = bytes(0 if 97 <= b <= 122 or b >= 128 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in (32, 9, 13) else 4 if b == 10 else 5 for b in range(256))


def meta_view(text: str | None, categories: tuple) -> np.ndarray:
    """The bucket of each category, then size and layout in 255ths (sizes in 100ths)."""
    out = np.zeros(len(categories) + 8, np.float32)
    data = (text or "").encode()
    if data:
        kinds = np.bincount(np.frombuffer(data.translate(_signs), np.uint8), minlength=6)
        out[-8:-2] = np.sqrt(kinds / len(data)) * 255
        out[-2] = np.log1p(len(data)) * 10
        out[-1] = np.log1p(len(data) / (1 + kinds[4])) * 10
    for k, c in enumerate(categories):
        out[k] = zlib.crc32(repr(c).encode()) % CATEGORIES
    return np.rint(np.minimum(out, 255)).astype(np.uint8)


def text_matrix(views: list[bytes] | list[np.ndarray]) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(v) for v in views), np.uint8).reshape(len(views), WORDS + SHAPES + 2).astype(np.float32) / 255


def meta_matrix(views: list[bytes] | list[np.ndarray], categories: int) -> np.ndarray:
    """One column for each bucket of each category, then size and layout."""
    raw_ = np.frombuffer(b"".join(bytes(v) for v in views), np.uint8).reshape(len(views), categories + 8)
    out = np.zeros((len(views), CATEGORIES * categories + 8), np.float32)
    for k in range(categories):
        out[np.arange(len(views)), CATEGORIES * k + raw_[:, k]] = 1
    out[:, -8:-2] = raw_[:, -8:-2] / np.float32(255)
    out[:, -2:] = raw_[:, -2:] / np.float32(100)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))]).astype(float)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty * len(x) * 0.01 + 1e-9)
        step = np.linalg.solve(h, x.T @ (p - y) + penalty * len(x) * 0.01 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def raw(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


class Quality:
    """Two views' weights, their calibration (slope, intercept) and the combination; None: everything scores 1."""

    def __init__(self, parts: tuple | None):
        self.parts = parts

    def score(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores of the views, then the combined ones."""
        if self.parts is None:
            one = np.ones(len(a))
            return one, one, one
        wa, wb, ca, cb, both = self.parts
        za, zb = ca[0] * raw(a, wa) + ca[1], cb[0] * raw(b, wb) + cb[1]
        squash = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return squash(za), squash(zb), squash(raw(np.column_stack([za, zb]), both))


#: surest(weights, taken): of each view a list of (sure it is bad, sure it is good), each a list of (key, text view, meta
#: view), at most as many as asked for, without the keys that are taken.
Surest = Callable[[list[np.ndarray], list[set[bytes]], tuple[int, int]], list[tuple[list, list]]]


def co_train(a: np.ndarray, b: np.ndarray, y: np.ndarray, surest: Surest, categories: int, apart: np.ndarray, rounds: int = ROUNDS, each: int = EACH) -> Quality:
    """a, b, y: the labelled documents' views and classes; apart: those kept for calibration."""
    if len(set(y[~apart].tolist())) < 2 or len(set(y[apart].tolist())) < 2:
        return Quality(None)
    use = ~apart
    views_, share = (a, b), y[use].mean()
    own: list[dict[bytes, tuple[bytes, int]]] = [{}, {}]  # what view 0 and view 1 learn from the other: key -> (view, label)
    matrix = (text_matrix, lambda v: meta_matrix(v, categories))

    def fit(v: int) -> np.ndarray:
        got = [own[v][k] for k in sorted(own[v])]
        x, t = [views_[v][use]], [y[use]]
        if got:
            x.append(matrix[v]([g[0] for g in got]))
            t.append(np.array([g[1] for g in got], float))
        return logistic(np.concatenate(x), np.concatenate(t))

    weights = [fit(0), fit(1)]
    for _ in range(rounds):
        asked = max(1, round(each * (1 - share))), max(1, round(each * share))
        found = surest(weights, [set(own[1]), set(own[0])], asked)
        for v in (0, 1):  # what view v is sure of, the other one learns
            for label in (0, 1):
                for key, *both in found[v][label]:
                    own[1 - v][key] = both[1 - v], label
        if not any(x for f in found for x in f):
            break
        weights = [fit(0), fit(1)]
    calibrated, zs = [], []
    for v in (0, 1):
        z = raw(views_[v][apart], weights[v])
        slope, at = logistic(z[:, None], y[apart], ridge=1.0)
        if slope <= 0:  # a view that says nothing
            slope, at = 0.0, float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
        calibrated.append((float(slope), float(at)))
        zs.append(slope * z + at)
    both = logistic(np.column_stack(zs), y[apart], ridge=1.0)
    return Quality((weights[0], weights[1], *calibrated, both))


def featured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", meta: tuple[str, ...] = META) -> DataFrame:
    """doc_id, a, b: both views of every row, as bytes."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *(F.col(m).cast("string") if m in docs.columns else F.lit(None).cast("string").alias(m) for m in meta))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            text_, *meta_ = (x.column(k).to_pylist() for k in range(1, x.num_columns))
            a = pa.array([text_view(t).tobytes() for t in text_], pa.binary())
            b = pa.array([meta_view(t, m).tobytes() for t, m in zip(text_, zip(*meta_))], pa.binary())
            yield pa.RecordBatch.from_arrays([x.column(0), a, b], ["doc_id", "a", "b"])

    return rows.mapInArrow(run, f"doc_id {kind}, a binary, b binary")


def most(found: DataFrame, asked: tuple[int, int]) -> DataFrame:
    """The rows of highest z of each (v, label), as many as asked for of the label, in one pass over found: every partition
    ranks its own first (the literal limit lets Spark do so before the exchange)."""
    best = Window.partitionBy("v", "label").orderBy(F.desc("z"), "key")
    own = F.when(F.col("label") == 0, F.lit(asked[0])).otherwise(F.lit(asked[1]))
    return found.withColumn("rank", F.row_number().over(best)).filter((F.col("rank") <= max(asked)) & (F.col("rank") <= own)).drop("rank")


def surest_of(pool: DataFrame, categories: int) -> Surest:
    """surest() over a table of a, b. Rows whose views are alike have one key and count once."""

    def surest(weights: list[np.ndarray], taken: list[set[bytes]], asked: tuple[int, int]) -> list[tuple[list, list]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, int], dict[bytes, tuple]] = {(v, label): {} for v in (0, 1) for label in (0, 1)}
            for x in batches:
                a, b = (x.column(k).to_pylist() for k in (0, 1))
                for v, views in enumerate((text_matrix(a), meta_matrix(b, categories))):
                    z = raw(views, weights[v])
                    for label in (0, 1):
                        held, n = best[v, label], asked[label]
                        score_ = z if label else -z
                        new = 0
                        for k in np.argsort(-score_, kind="stable"):
                            if score_[k] <= 2 or new >= n:
                                break
                            key = hashlib.blake2b(a[k] + b[k], digest_size=16).digest()
                            if key not in taken[v] and key not in held:
                                held[key] = (float(score_[k]), a[k], b[k])
                                new += 1
                        if len(held) > n:
                            best[v, label] = dict(sorted(held.items(), key=lambda i: (-i[1][0], i[0]))[:n])
            rows = [(v, label, key, *r) for (v, label), held in best.items() for key, r in held.items()]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["v", "label", "key", "z", "a", "b"])

        found = pool.mapInArrow(run, "v int, label int, key binary, z double, a binary, b binary").dropDuplicates(["v", "label", "key"])
        rows = most(found, asked).collect()  # twice EACH at most
        return [tuple([(bytes(r.key), bytes(r.a), bytes(r.b)) for r in rows if r.v == v and r.label == label] for label in (0, 1)) for v in (0, 1)]

    return surest


def learn_from(features: DataFrame, labels: DataFrame, may_learn: Column | None = None, label: str = "quality", doc_id: str = "doc_id", categories: int = len(META)) -> Quality:
    """learn() from the table of featured()."""
    allowed = F.lit(True) if may_learn is None else may_learn
    labels = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & allowed)
    labels = labels.groupBy("doc_id").agg(F.min("y").alias("y"))
    some = least_hashed(labels, MOST_LABELLED, "doc_id")
    # a repeated id can bring many rows
    rows = least_hashed(features.join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id", "a", "b"]), MOST_LABELLED, "doc_id", "a", "b")
    got = rows.select("y", F.col("doc_id").cast("string").alias("id"), "a", "b").toArrow()
    if not got.num_rows:
        return Quality(None)
    y, a, b = got["y"].to_numpy().astype(float), got["a"].to_pylist(), got["b"].to_pylist()
    part = np.array([zlib.crc32(f"part {i}".encode()) for i in got["id"].to_pylist()])
    pool = written(features.filter(allowed).join(labels.select("doc_id"), "doc_id", "left_anti").select("a", "b"), "unlabelled-views")
    out = co_train(text_matrix(a), meta_matrix(b, categories), y, surest_of(pool, categories), categories, part % 5 == 0)
    discard(pool)
    return out


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, label: str = "quality", text: str = "text", doc_id: str = "doc_id", meta: tuple[str, ...] = META) -> Quality:
    """A model from labels of the documents for which may_learn (of the column doc_id) is true; a fifth calibrates."""
    features = written(featured(docs, text, doc_id, meta), "views")
    out = learn_from(features, labels, may_learn, label, doc_id, len(meta))
    discard(features)
    return out


def score_features(features: DataFrame, model: Quality, categories: int = len(META)) -> DataFrame:
    """doc_id, text_score, meta_score, score, keep, from the table of featured()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(text_matrix(b.column(1).to_pylist()), meta_matrix(b.column(2).to_pylist(), categories))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x.astype(float)) for x in s), pa.array(s[2] >= KEEP_FROM)], ["doc_id", "text_score", "meta_score", "score", "keep"])

    kind = features.schema["doc_id"].dataType.simpleString()
    return features.mapInArrow(run, f"doc_id {kind}, text_score double, meta_score double, score double, keep boolean")


def score(docs: DataFrame, model: Quality, text: str = "text", doc_id: str = "doc_id", meta: tuple[str, ...] = META) -> DataFrame:
    """score_features() of the rows of docs."""
    return score_features(featured(docs, text, doc_id, meta), model, len(meta))


def accepted(docs: DataFrame, model: Quality, text: str = "text", meta: tuple[str, ...] = META) -> DataFrame:
    """The rows of docs, whole, that score KEEP_FROM or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index
            cells = lambda n: [None if x is None else str(x) for x in b.column(at(n)).to_pylist()] if at(n) >= 0 else [None] * b.num_rows
            texts = b.column(at(text)).to_pylist()
            views = [text_view(t) for t in texts], [meta_view(t, m) for t, m in zip(texts, zip(*map(cells, meta)))]
            yield b.filter(pa.array(model.score(text_matrix(views[0]), meta_matrix(views[1], len(meta)))[2] >= KEEP_FROM))

    return docs.mapInArrow(run, docs.schema)


def op3_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents scored; labels of a fifth of the ids are held out."""
    docs = read(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 5) == 0
    features = written(featured(docs), "views")
    model = learn_from(features, read(spark, sf_dir, "labels"), ~held)
    return score_features(features, model).select("doc_id", held.alias("held_out"), "text_score", "meta_score", "score", "keep")
