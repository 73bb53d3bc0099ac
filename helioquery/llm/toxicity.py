"""Toxicity by a factorization machine over hashed terms.

A text is the set of its distinct words, hashed. Of the hash buckets, those whose presence says most about the label in
the training sample (a likelihood ratio statistic over ``floor``, the ``terms`` largest) are the machine's inputs; each
has a linear weight and a vector of ``factors`` numbers, and the inner product of two terms' vectors is the weight of
their meeting, so that an insult beside a group's name can weigh more than both alone. The bias is set by cross-fitting
so that a score of 0.7 parts the labels best. Presence, not frequency, keeps
long texts comparable with short ones. It is fitted with Adam on a sample of labelled rows, those with the least hashes of
their ids: about ``sample_rows``, or fewer where their terms take more than ``sample_bytes`` (4 bytes each). The whole text of
every row is read.

Null and empty texts have no terms and score like a text of unknown words. Rows without a label or with a null one are
not learned from; of several labels of an id the highest counts. Without labels every score is 0; with fewer than 20 of
either kind the bias stays as it was fitted. Repeated rows get
equal results; an empty table gives an empty result; further columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLD_WORDS, crc32_of_id, sampled, ship, slices, word_hashes, written

BUCKETS = 1 << 31  # so many that a long text's rare words don't fall on a chosen term by chance


def terms(text: str | None) -> np.ndarray:
    """Distinct hash buckets of the words of a text."""
    words = word_hashes((text or "").encode().translate(FOLD_WORDS))
    return np.unique((words >> np.uint64(33)).astype(np.int32))


@dataclass
class Model:
    buckets: np.ndarray  # of the inputs, sorted
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, found: list[np.ndarray]) -> np.ndarray:
        """Likelihood of label 1, 0 to 1, of arrays of buckets."""
        return 1 / (1 + np.exp(-np.clip(self.value(found), -30, 30)))

    def inputs(self, t: np.ndarray) -> np.ndarray:
        """Numbers of the inputs that are among buckets."""
        return _inputs(self.buckets, t)

    def value(self, found: list[np.ndarray]) -> np.ndarray:
        at = [self.inputs(t) for t in found]
        row = np.repeat(np.arange(len(at)), [len(a) for a in at])
        col = np.concatenate(at) if at else np.zeros(0, int)
        linear = np.bincount(row, self.weights[col], len(at))
        both = np.zeros(len(at))
        for v in self.factors.T:
            both += np.bincount(row, v[col], len(at)) ** 2 - np.bincount(row, v[col] ** 2, len(at))
        return self.bias + linear + both / 2


def _inputs(buckets: np.ndarray, t: np.ndarray) -> np.ndarray:
    if not len(buckets):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(buckets, t), len(buckets) - 1)
    return at[buckets[at] == t]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def choose(found: list[np.ndarray], y: np.ndarray, count: int, floor: float) -> np.ndarray:
    """Buckets by likelihood ratio of presence and label, best first."""
    seen, flat = np.unique(np.concatenate(found), return_inverse=True)
    owner = np.repeat(y, [len(f) for f in found])
    n, n1 = float(len(y)), float(y.sum())
    a, every = np.bincount(flat, owner, len(seen)), np.bincount(flat, minlength=len(seen)).astype(float)
    b, c = every - a, n1 - a
    d = n - n1 - b
    g = 2 * (_xlogx(a) + _xlogx(b) + _xlogx(c) + _xlogx(d) - _xlogx(every) - _xlogx(n - every) - _xlogx(np.array(n1)) - _xlogx(np.array(n - n1)) + _xlogx(np.array(n)))
    g[every < 5] = 0
    best = np.argsort(-g, kind="stable")[:count]
    return seen[best[g[best] >= floor]]


def train(found: list[np.ndarray], y: np.ndarray, count: int = 1024, floor: float = 24.0, factors: int = 8, steps: int = 200,
          rate: float = 0.05, decay: float = 1e-5, seed: int = 0) -> Model:
    """Fit on sets of buckets and 0/1 labels."""
    y = np.asarray(y, np.float32)
    chosen = np.sort(choose(found, y, count, floor))
    x = np.zeros((len(y), len(chosen)), np.float32)
    for i, f in enumerate(found):
        x[i, _inputs(chosen, f)] = 1
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    p = [np.array([np.log(prior / (1 - prior))], np.float32), np.zeros(len(chosen), np.float32),
         np.random.default_rng(seed).normal(0, 0.05, (len(chosen), factors)).astype(np.float32)]
    m, s = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for t in range(1, steps + 1):
        xv = x @ p[2]
        z = p[0] + x @ p[1] + ((xv**2).sum(axis=1) - x @ (p[2] ** 2).sum(axis=1)) / 2
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = [e.sum(keepdims=True), x.T @ e + decay * p[1], x.T @ (e[:, None] * xv) - p[2] * (x.T @ e)[:, None] + decay * p[2]]
        for k in range(3):
            m[k], s[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * s[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return Model(chosen, float(p[0][0]), p[1].astype(float), p[2].astype(float))


#: The score from which a text counts as toxic.
LIMIT = 0.7


def calibrated(found: list[np.ndarray], y: np.ndarray, seed: int = 0, **options) -> Model:
    """A machine whose score passes ``LIMIT`` where label 1 is told best from label 0 (largest F1).

    That place is found on texts the machine has not seen: each half of the sample is scored by a machine of the other."""
    y = np.asarray(y)
    model = train(found, y, seed=seed, **options)
    if min(y.sum(), len(y) - y.sum()) < 20:
        return model
    half = np.random.default_rng(seed).permutation(len(y)) % 2
    value = np.empty(len(y))
    for h in (0, 1):
        own, other = np.flatnonzero(half == h), np.flatnonzero(half != h)
        value[own] = train([found[i] for i in other], y[other], seed=seed, **options).value([found[i] for i in own])
    order = np.argsort(-value, kind="stable")
    ranked, right = value[order], np.cumsum(y[order])
    f1 = 2 * right / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][ranked[:-1] == ranked[1:]] = 0  # no cut within equal values
    best = int(np.flatnonzero(f1 >= f1.max() - 0.005)[0])  # of equally good places the one that flags least
    below = ranked[best + 1] if best + 1 < len(y) else ranked[best] - 1
    model.bias += float(np.log(LIMIT / (1 - LIMIT)) - (ranked[best] + below) / 2)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 24_000,
        sample_bytes: int = 128 << 20) -> Model | None:
    """A model from the documents that ``labels`` (id, label) names; None without any."""
    ship(docs.sparkSession)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    n = known.count()
    known = known.withColumn("_mark", F.shiftrightunsigned(F.xxhash64(id_col), 2))
    if n > sample_rows:
        known = sampled(known, F.xxhash64(id_col), sample_rows / n)
    known = known.orderBy("_mark", id_col).limit(2 * sample_rows)  # the bound of what is broadcast; the hash gives half of that

    def termed(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([terms(t).tobytes() for t in batch.column(2).to_pylist()], pa.binary())], names=["mark", "y", "x"])

    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known.select(F.col(id_col).alias("_id"), "_y", "_mark")), "_id")
    found = written(named.select("_mark", "_y", "_text").mapInArrow(termed, "mark long, y int, x binary"), "terms")
    table = bounded(found, sample_rows, sample_bytes).toArrow()
    if not table.num_rows:
        return None
    return calibrated([np.frombuffer(x, np.int32) for x in table["x"].to_pylist()], table["y"].to_numpy())


def bounded(found: DataFrame, sample_rows: int, sample_bytes: int) -> DataFrame:
    """The rows (mark, y, x) with the least marks that fit into three times ``sample_rows`` rows and into ``sample_bytes``, in a
    fixed order. Rows are counted by 1,000 ranges of marks, and whole ranges are left out."""
    most = found.agg(F.max("mark")).first()[0]
    if most is None:
        return found
    step = most // 1000 + 1
    part = F.call_function("div", F.col("mark"), F.lit(step).cast("long"))
    rows = size = 0
    for k, n, more in sorted(map(tuple, found.groupBy(part.alias("part")).agg(F.count(F.lit(1)), F.sum(F.length("x") + 16)).collect())):
        rows, size = rows + n, size + more
        if rows > 3 * sample_rows or size > sample_bytes:
            found = found.filter(part < k)
            break
    return found.orderBy("mark", "y", "x")


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with its columns and score."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("score")
    shipped = spark.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    place = docs.columns.index(text_col)

    def scored(batches):
        model = shipped.value
        for batch in slices(batches):
            texts = batch.column(place).to_pylist()
            scores = np.zeros(len(texts)) if model is None else model.score([terms(t) for t in texts])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(scored, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc32_of_id(id_col) % 3 == 1, F.lit(False))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


ORACLE: dict[str, str] = {}
