"""Language identification by error-correcting output codes.

Each language is a word of +1/-1 bits, far from the others; one logistic classifier over hashed byte n-grams (2 and 3
bytes of the lower-cased text, digits and ASCII signs made spaces, square roots of relative counts) predicts each bit.
Decoding sums each bit's logistic loss against every codeword, weighted by how well the bit was learned, and takes the
nearest codeword; the softmax of the negative losses is the score, and a text is ambiguous where the score is below 0.6, or
below 0.9 and the bits are farther from the chosen word than the code can correct.

The model is fitted on a sample of about ``sample_rows`` labelled rows, dealt by a hash of id and text, language by language: each
in proportion to its rows, but ``least`` rows (all, if it has fewer) where that gives less, which is at most as many again.

Null texts and texts without a letter are ``und`` with score 0 and not ambiguous. Null languages are not learned; with
no language to learn all texts are ``und``, with one all others are that language. Repeated rows get equal results; an
empty table gives an empty result; further columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLD_WORDS, crc32_of_id, share_bound, ship, slices, trim

DIMENSIONS = 4096
_LETTERS_ONLY = bytes(32 if 48 <= b <= 57 else b for b in FOLD_WORDS)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Square roots of the relative counts of hashed byte bigrams and trigrams."""
    a = np.frombuffer(b" %b " % text.encode().translate(_LETTERS_ONLY), np.uint8).astype(np.uint32)
    two = a[:-1] * np.uint32(257) + a[1:]
    three = two[:-1] * np.uint32(65599) + a[2:] * np.uint32(31) + np.uint32(7)
    seen = np.bincount((two * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)
    seen += np.bincount((three * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)
    return np.sqrt(seen / max(1, len(two) + len(three))).astype(np.float32)


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """n words of +1/-1, about ten bits for each doubling of n; of many random codes, the one with the farthest words."""
    bits = max(3, int(np.ceil(10 * np.log2(max(2, n)))))
    best, far = None, -1
    for k in range(200):
        rng = np.random.default_rng(seed * 1000 + k)
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        flat = np.abs(code.sum(axis=0)) == n
        code[0, flat] *= -1  # no constant bit
        d = (bits - code.astype(int) @ code.T.astype(int)) // 2 + bits * np.eye(n, dtype=int)
        if d.min() > far:
            best, far = code, int(d.min())
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score and ambiguity of rows of features."""
        f = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -f * word) * self.trust).sum(axis=1) for word in self.code], axis=1)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        score = p[np.arange(len(p)), best]
        d = (len(self.bias) - self.code.astype(int) @ self.code.T.astype(int)) // 2 + 10**6 * np.eye(len(self.code), dtype=int)
        wrong = (np.where(f >= 0, 1, -1) != self.code[best]).sum(axis=1)
        return best, score, (score < 0.6) | (score < 0.9) & (wrong > (d.min() - 1) // 2)


def train(x: np.ndarray, labels: list[str], steps: int = 150, rate: float = 0.1, decay: float = 1e-5) -> Model:
    languages = sorted(set(labels))
    code = codewords(len(languages))
    at = np.searchsorted(languages, labels)
    weight = (1 / np.bincount(at)[at]).astype(np.float32)
    weight /= weight.sum()
    y = code[at].astype(np.float32)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        margin = y * (x @ w + b)
        g = -y * (weight[:, None] / (1 + np.exp(np.clip(margin, -30, 30))))
        gw = x.T @ g + decay * w
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * g.sum(axis=0)
    right = (((x @ w + b) * y > 0) * weight[:, None]).sum(axis=0)
    trust = np.maximum(2 * right - 1, 0.01).astype(np.float32)
    return Model(languages, code, w, b, trust / trust.mean())


def fit(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_rows: int = 4000, id_col: str = "doc_id", least: int = 50) -> Model | None:
    """A model from labelled rows; None where no row has a language and a letter."""
    ship(rows.sparkSession)
    rows = rows.filter(F.col(lang_col).isNotNull())
    counts = dict(map(tuple, rows.groupBy(lang_col).count().collect()))  # reads no text
    n = sum(counts.values())
    rows = rows.filter(F.col(text_col).isNotNull())
    mark = F.xxhash64(*[c for c in (id_col, text_col) if c in rows.columns])
    if n > sample_rows:
        least = min(least, sample_rows // len(counts))
        shares = {k: min(1, max(sample_rows / n, least / c)) for k, c in counts.items()}
        upto = F.create_map(*[F.lit(x) for k, share in shares.items() for x in (k, share_bound(share))])
        rows = rows.filter(F.shiftrightunsigned(mark, 2) < upto[F.col(lang_col)])

    def featured(batches):
        for batch in slices(batches):
            kept = [(lang, m, features(t).astype(np.float16).tobytes()) for lang, m, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k for k, _, _ in kept], pa.string()), "mark": pa.array([m for _, m, _ in kept], pa.int64()), "x": pa.array([x for *_, x in kept], pa.binary())})

    found = rows.select(lang_col, mark, text_col).mapInArrow(featured, "lang string, mark long, x binary")
    # A bound, by the least marks; the sample stays below, unless a third of all rows are one text without an id.
    table = found.orderBy("mark", "lang").limit(3 * sample_rows).toArrow()
    if not table.num_rows:
        return None
    x = np.empty((table.num_rows, DIMENSIONS), np.float32)
    for i, row in enumerate(table["x"]):
        x[i] = np.frombuffer(row.as_buffer(), np.float16)
    labels = table["lang"].to_pylist()
    del table
    model = train(x, labels)
    del x
    trim()
    return model


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with its columns and lang_pred, score and ambiguous."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("lang_pred", "score", "ambiguous")
    shipped = spark.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    place = docs.columns.index(text_col)

    def predicted(batches):
        model = shipped.value
        for batch in slices(batches):
            texts = batch.column(place).to_pylist()
            known = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            langs, scores, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            for start in range(0, len(known), 512):
                part = known[start : start + 512]
                best, score, ambiguous = model.predict(np.stack([features(texts[i]) for i in part]))
                scores[part], unsure[part] = score, ambiguous
                for i, k in zip(part, best, strict=True):
                    langs[i] = model.languages[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs), pa.array(scores), pa.array(unsure)], names=schema.names)

    return docs.mapInArrow(predicted, schema)


def lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a letter: those that are not ``und`` with a model."""
    ship(docs.sparkSession)
    place = docs.columns.index(text_col)

    def kept(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array([has_letter(t) for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc32_of_id(id_col) % 4 == 2, F.lit(False))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out()))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


ORACLE: dict[str, str] = {}
