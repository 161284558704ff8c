"""Operator 6: toxicity by non-negative positive-unlabelled learning.

A linear classifier is trained with numpy from confirmed toxic examples (P) and unlabelled text (U). With the class
prior c, the risk is c R_P(+) + max(0, R_U(-) - c R_P(-)): the second part estimates the risk on the non-toxic texts
hidden in U, and where it falls below zero (the model then fits U's toxic texts as non-toxic) the step is taken against
it. Features are the presence of words and word beginnings; those whose share in P exceeds their share in U by a
clear margin take part. Labels, language, source and ids are no features.

P is a bounded sample of labelled documents (MOST_POSITIVE: a documented bound, least hash of the id first), where near copies
(texts that agree in one of BANDS bands of three minima over their shingles of five words) count once. U is every document that may be learnt
from; its labels, if any, are not looked at. What training needs of U is exact and small: how many documents have each
candidate feature, and how many have each set of the chosen ones. Risk and gradient are sums over those sets, taken on the
driver if there are at most MOST_SETS of them, else by a pass over their table for each step. The prior is a count over all
labels that may be learnt from.

Cases: null and empty texts have no features and score as the intercept says; texts of any length count each word once;
repeated rows score alike; null ids are in U; with no positive example every text scores 0; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, discard, least_hashed, read, text_scores, written
from .shingles import shingle_hashes

#: Bound of the labelled sample (documents), and of the candidate features it gives (the most frequent ones).
MOST_POSITIVE, MOST_CANDIDATES = 4000, 1 << 16
#: Bands by which near copies among them are told.
BANDS = 12
#: Feature sets that are summed up on the driver (more of them are summed up by Spark).
MOST_SETS = 1 << 18
#: Beginnings of words that count as features, in characters.
BEGINNINGS = (4, 5, 6)
#: A feature takes part if its share in P exceeds that in U by so many standard errors and it is in so many texts of P.
MARGIN, LEAST_DOCS = 4.5, 5

_letters = re.compile(r"[^\W\d_]+")


def features_of_word(word: str) -> tuple[str, ...]:
    return (f"{word} ", *(word[:n] for n in BEGINNINGS if len(word) >= n))


def words_of(text: str | None) -> Iterator[str]:
    """The runs of letters, some of them more than once; white space parts words, so each of a text's tokens is split once."""
    for t in set(text.lower().split()) if text else ():
        if t.isalpha():
            yield t
        else:
            yield from _letters.findall(t)


def features_of(text: str | None) -> set[str]:
    return {f for w in words_of(text) for f in features_of_word(w)}


class Present:
    """Which of the given features a text has, as ascending numbers."""

    def __init__(self, names: list[str]):
        self.number = {f: k for k, f in enumerate(names)}
        least = min(BEGINNINGS)
        # a word and its features begin alike
        self.heads, self.least = {f.rstrip(" ")[:least] for f in names}, least

    def __call__(self, text: str | None) -> np.ndarray:
        found: set[int] = set()
        heads, least, get, add = self.heads, self.least, self.number.get, found.add
        for w in words_of(text):
            if w[:least] in heads:
                add(get(w + " ", -1))
                size = len(w)
                for n in BEGINNINGS:
                    if size < n:
                        break
                    add(get(w[:n], -1))
        found.discard(-1)
        return np.sort(np.fromiter(found, np.uint32, len(found)))


class Toxicity:
    """weights: feature -> weight."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self._present = None

    def __getstate__(self):
        return self.__dict__ | {"_present": None}

    def score(self, texts: list[str | None]) -> list[float]:
        if self._present is None:
            names = sorted(self.weights)
            self._present, self._w = Present(names), np.array([self.weights[f] for f in names])
        z = [self.bias + float(self._w[self._present(t)].sum()) for t in texts]
        return [float(1 / (1 + np.exp(-min(max(x, -500), 500)))) for x in z]


#: Sets of features, one after the other, with the number of texts that have each: (numbers, first of each set, texts).
Sets = tuple[np.ndarray, np.ndarray, np.ndarray]


def sets_of(rows: list[bytes], many: np.ndarray) -> Sets:
    size = np.array([len(r) // 4 for r in rows], np.int64)
    return np.frombuffer(b"".join(rows), np.uint32).astype(np.int64), np.concatenate([[0], np.cumsum(size)]), np.asarray(many, float)


def logits(sets: Sets, w: np.ndarray, b: float) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(w[sets[0]])])
    return b + total[sets[1][1:]] - total[sets[1][:-1]]


def pull(sets: Sets, d: np.ndarray, width: int) -> np.ndarray:
    """The sum over sets of d at each of their features, and of d, as one vector of width + 1."""
    return np.append(np.bincount(sets[0], np.repeat(d, np.diff(sets[1])), width), d.sum())


def negative_sums(sets: Sets, w: np.ndarray, b: float) -> np.ndarray:
    """Over all texts: loss of being called negative, then its gradient."""
    z = logits(sets, w, b)
    return np.append((sets[2] * np.logaddexp(0, z)).sum(), pull(sets, sets[2] / (1 + np.exp(-np.clip(z, -50, 50))), len(w)))


def nnpu(positive: Sets, unlabelled: Callable[[np.ndarray, float], np.ndarray], n_unlabelled: int, width: int, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-5, slack: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model with logistic loss and the non-negative risk, by Adam on all of both samples.

    unlabelled: negative_sums() of U for weights and bias."""
    n_p = positive[2].sum()
    w, b = np.zeros(width), -1.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        of_u, of_p = unlabelled(w, b) / n_unlabelled, negative_sums(positive, w, b) / n_p
        if of_u[0] - prior * of_p[0] >= -slack:
            # of c R_P(+) + R_U(-) - c R_P(-): the losses of P differ by the logit alone
            g = of_u[1:] - prior * pull(positive, positive[2], width) / n_p
        else:
            g = prior * of_p[1:] - of_u[1:]
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def numbered(texts: DataFrame, names: list[str], extra: str = "") -> DataFrame:
    """features (bytes of ascending 32-bit numbers in names) of each row of texts: text, and the columns of extra."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = Present(names)
        for b in batches:
            found = pa.array([present(t).tobytes() for t in b.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([found, *b.columns[1:]], ["features", *b.schema.names[1:]])

    return texts.mapInArrow(run, "features binary" + extra)


_steps = np.random.default_rng(41).integers(0, 1 << 62, BANDS * 3, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(text: str | None) -> list[int]:
    """BANDS numbers: texts of which five-word shingles are mostly the same agree in some of them."""
    s = shingle_hashes((text or "").encode(), 5)
    if not len(s):
        return []
    least = np.full(len(_steps), np.iinfo(np.uint64).max)
    for k in range(0, len(s), 4096):
        np.minimum(least, (s[k : k + 4096, None] * _steps).min(0), out=least)
    return (least.reshape(BANDS, 3) * _steps[:3]).sum(1, dtype=np.uint64).view(np.int64).tolist()


def apart(sketches: list[list[int]]) -> list[int]:
    """The first of each group of texts that agree in a band."""
    first, up = {}, list(range(len(sketches)))

    def find(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    for k, bands in enumerate(sketches):
        for band, x in enumerate(bands):
            a, b = find(first.setdefault((band, x), k)), find(k)
            up[max(a, b)] = min(a, b)
    return [k for k in range(len(sketches)) if find(k) == k]


def candidates(positive: DataFrame) -> tuple[list[str], DataFrame]:
    """(features in LEAST_DOCS or more texts of P, in order; P as a table of key, text without near copies)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            key = [hashlib.blake2b((t or "").encode(), digest_size=16).digest() for t in texts]
            names = pa.array([sorted(features_of(t)) for t in texts], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), b.column(0), pa.array(list(map(sketch, texts)), pa.list_(pa.int64())), names], ["key", "text", "bands", "names"])

    rows = positive.select("text").mapInArrow(keyed, "key binary, text string, bands array<long>, names array<string>")
    # copies are one; a repeated id can bring many rows
    rows = written(least_hashed(rows.dropDuplicates(["key"]), MOST_POSITIVE, "key"), "positive")
    known = rows.select("key", "bands").orderBy("key").collect()  # MOST_POSITIVE rows at most
    keys = [(bytes(known[k].key),) for k in apart([list(r.bands) for r in known])]
    rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(keys, "key binary")), "key")
    many = rows.select(F.explode("names").alias("f")).groupBy("f").count().filter(F.col("count") >= LEAST_DOCS)
    return sorted(r.f for r in many.orderBy(F.desc("count"), "f").limit(MOST_CANDIDATES).collect()), rows.select("key", "text")


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, label: str = "toxic", text: str = "text", doc_id: str = "doc_id") -> Toxicity:
    """A model from labels of the documents for which may_learn (of the column doc_id) is true."""
    allowed = F.lit(True) if may_learn is None else may_learn
    labels = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & allowed)
    n, toxic = labels.agg(F.count("*"), F.sum("y")).first()
    prior = (toxic or 0) / n if n else 0.0
    if not 0 < prior < 1:
        return Toxicity({}, 0.0 if prior >= 1 else -500.0)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ids = least_hashed(labels.filter("y = 1").select("doc_id").distinct(), MOST_POSITIVE, "doc_id")
    names, positive = candidates(texts.join(F.broadcast(ids), "doc_id"))
    if not names:
        return Toxicity({}, -500.0)
    rows = written(numbered(texts.filter(allowed).select("text"), names), "candidate-features")
    p = numbered(positive.select("text", "key"), names, ", key binary").orderBy("key").toArrow()  # MOST_POSITIVE rows at most
    in_p, in_u, n_p = np.zeros(len(names)), np.zeros(len(names)), p.num_rows
    for x in p["features"]:
        in_p[np.frombuffer(x.as_buffer(), np.uint32)] += 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, n = np.zeros(len(names), np.int64), 0
        for b in batches:
            many += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint32), minlength=len(names))
            n += b.num_rows
        at = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(many[at], n))], ["f", "n"])

    for r in rows.mapInArrow(counted, "f long, n long").groupBy("f").agg(F.sum("n")).collect():  # a row for each candidate
        if r[0] < 0:
            n_u = r[1]
        else:
            in_u[r[0]] = r[1]
    if not n_p or not n_u:
        return Toxicity({}, -500.0)
    share = (in_p + in_u) / (n_p + n_u)
    margin = (in_p / n_p - in_u / n_u) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_p + 1 / n_u))
    chosen = margin >= MARGIN
    if not chosen.any():
        chosen = margin >= np.sort(margin)[-min(len(margin), 20)]
    place = np.where(chosen, np.cumsum(chosen) - 1, -1)
    width = int(chosen.sum())

    def of_chosen(x: bytes) -> bytes:
        k = place[np.frombuffer(x, np.uint32)]
        return k[k >= 0].astype(np.uint32).tobytes()

    def grouped_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many: dict[bytes, int] = {}
        for b in batches:
            for x in b.column(0).to_pylist():
                k = of_chosen(x)
                many[k] = many.get(k, 0) + 1
            if len(many) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(list(many), pa.binary()), pa.array(list(many.values()), pa.int64())], ["features", "n"])
                many = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(many), pa.binary()), pa.array(list(many.values()), pa.int64())], ["features", "n"])

    of_u = written(rows.mapInArrow(grouped_sets, "features binary, n long").groupBy("features").agg(F.sum("n").alias("n")), "feature-sets", True)
    discard(rows)
    one = sets_of([of_chosen(x) for x in p["features"].to_pylist()], np.ones(n_p))
    w, b = nnpu(one, summed(of_u), n_u, width, prior)
    return Toxicity({names[k]: float(w[place[k]]) for k in np.flatnonzero(chosen)}, b)


def summed(sets: DataFrame) -> Callable[[np.ndarray, float], np.ndarray]:
    """negative_sums() of a table of features, n: on the driver if its rows are few, else by a pass of Spark each time."""
    if sets.limit(MOST_SETS + 1).count() <= MOST_SETS:
        t = sets.orderBy("features").toArrow()
        held = sets_of(t["features"].to_pylist(), t["n"].to_numpy())
        return lambda w, b: negative_sums(held, w, b)

    def of_spark(w: np.ndarray, b: float) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(w) + 2)
            for x in batches:
                total += negative_sums(sets_of(x.column(0).to_pylist(), x.column(1).to_numpy()), w, b)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "s"])

        out = np.zeros(len(w) + 2)
        for k, s in sets.mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s")).collect():  # a row for each feature
            out[k] = s
        return out

    return of_spark


def score(docs: DataFrame, model: Toxicity, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score, predicted."""

    def both(texts):
        s = model.score(texts)
        return s, [int(x >= 0.5) for x in s]

    return text_scores(docs, both, "score double, predicted int", text, doc_id)


def op6_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents scored; labels of a fifth of the ids are held out."""
    docs = read(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = learn(docs, read(spark, sf_dir, "labels"), ~held)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
