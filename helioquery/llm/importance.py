"""Quality by importance resampling with hashed n-gram models.

Two generative models over hashed word unigrams and bigrams are estimated: of the raw text, from every row, and of the
target text, from the rows of the best label: all of them up to ``sample_rows``, beyond that as many, those with the least
hashes of their ids. A text's log importance weight is the sum of its n-grams' log ratios, the logarithm of the ratio of
the two models' likelihoods, or their mean (``per_gram``). Adding Gumbel noise, computed from the seed and the id, and
taking the k largest draws k texts without replacement in proportion to the ratios.

Null and empty texts have weight 0 (ratio 1). Without target rows all weights are 0. Null ids and repeated rows draw
equal noise; ties go by id, then by hashes of all columns, so only equal rows are interchangeable. An empty table gives an
empty result; further columns stay, those named like the ones added are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLD_WORDS, mix, sampled, ship, slices, unused, word_hashes
from .sharding import with_row_numbers

BUCKETS = 10_000


def grams(text: str | None) -> np.ndarray:
    """Hash buckets of all words and word pairs of a text, in no order."""
    w = word_hashes((text or "").encode().translate(FOLD_WORDS))
    with np.errstate(over="ignore"):
        pairs = mix(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:])
    return (np.concatenate((w, pairs)) % np.uint64(BUCKETS)).astype(np.int64)


def count_grams(docs: DataFrame, text_col: str, flag_col: str) -> np.ndarray:
    """Counts of each bucket in all rows and in flagged ones, as two rows."""

    def counted(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in slices(batches):
            for text, flag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = np.bincount(grams(text), minlength=BUCKETS)
                total[0] += seen
                if flag:
                    total[1] += seen
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total[0]), pa.array(total[1])], names=["b", "r", "t"])

    rows = docs.select(text_col, flag_col).mapInArrow(counted, "b long, r long, t long")
    out = np.zeros((2, BUCKETS))
    for b, r, t in rows.groupBy("b").agg(F.sum("r"), F.sum("t")).collect():  # at most BUCKETS rows
        out[:, b] = r, t
    return out


def log_ratio(counts: np.ndarray) -> np.ndarray:
    if not counts[1].sum():
        return np.zeros(BUCKETS)
    p = (counts + 1) / (counts.sum(axis=1, keepdims=True) + BUCKETS)
    return np.log(p[1]) - np.log(p[0])


def weigh(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample_rows: int = 200_000, per_gram: bool = False) -> DataFrame:
    """``docs`` with its columns and log_weight. Of the labelled rows at most about ``sample_rows`` make the target model."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("log_weight")
    good = labels.filter((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(id_col).distinct()
    n = good.count()
    if n > sample_rows:
        good = sampled(good, F.xxhash64(id_col), sample_rows / n).orderBy(F.xxhash64(id_col), id_col).limit(2 * sample_rows)
    good = F.broadcast(good.select(F.col(id_col).alias("id"), F.lit(True).alias("good")))
    counts = count_grams(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(good, "id", "left"), "text", "good")
    shipped = spark.sparkContext.broadcast(log_ratio(counts))
    schema = T.StructType([*docs.schema.fields, T.StructField("log_weight", T.DoubleType())])
    place = docs.columns.index(text_col)

    def weighed(batches):
        ratio = shipped.value
        for batch in slices(batches):
            weights = []
            for text in batch.column(place).to_pylist():
                g = grams(text)
                weights.append(float(ratio[g].sum()) / (max(1, len(g)) if per_gram else 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weights, pa.float64())], names=schema.names)

    return docs.mapInArrow(weighed, schema)


def resample(weighed: DataFrame, fraction: float, seed: int = 0, id_col: str = "doc_id", temperature: float = 1.0) -> DataFrame:
    """``weighed`` with its columns, gumbel_key, rank (from 0) and selected: the ``fraction`` of rows with the largest keys."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(2**52).cast("long")) + 0.5) / float(2**52)
    weighed = weighed.drop("gumbel_key", "rank", "selected")
    every = F.struct(*[weighed[c] for c in weighed.columns])
    tied, other = unused(weighed.columns, "tied", "other")
    keyed = weighed.withColumns({tied: F.xxhash64(every), other: F.xxhash64(F.lit(1), every), "gumbel_key": F.col("log_weight") / temperature - F.log(-F.log(u))})
    ranked, n = with_row_numbers(keyed, [-F.col("gumbel_key"), id_col, tied, other], "rank")
    return ranked.drop(tied, other).withColumn("selected", F.col("rank") < F.lit(int(np.ceil(fraction * n))))


def op4_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Half of all documents, drawn by their likeness to those of label quality = 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weighed = weigh(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return resample(weighed.withColumn("text", F.xxhash64("text")), 0.5).drop("text")


ORACLE: dict[str, str] = {}
