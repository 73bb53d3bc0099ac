"""Exact dedup against a minimal perfect hash of historical digests.

History is cut into shards by digest, each of some ``shard_keys`` distinct digests. A shard holds a minimal perfect
hash (levels of bit arrays; a key rests in the first level where no other key shares its position, and its slot is the
rank of that bit) and, per slot, the full SHA-256 digest, the winner's id and the number of rows. A new digest is
looked up by hash, then compared byte by byte with the digest in its slot: members are repeats of history, whose counts are
added to their slot's; nonmembers group among themselves. Only digests and ids are shuffled, and rows are counted per digest before that, so a text that
a third of all rows hold is one row by then.

Null texts count as empty; null ids are ordinary rows that win only where a group has no other id; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, mix, ship, written

#: A run of white space that is not one plain space already.
_RUN = "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+"
_GAMMA = 2.0
_INDEX = "shard int, levels array<long>, bits binary, digests binary, winners binary, counts binary"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and SHA-256 of the text with every run of white space made one space."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), _RUN, " ")
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def _level_hash(words: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(len(words), level * 2 + 1, np.uint64)
        for i in range(4):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[:, i])
    return h


def build_mph(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and all levels' bits of a minimal perfect hash over distinct rows of four 64-bit words."""
    sizes: list[int] = []
    parts: list[np.ndarray] = []
    rest = np.arange(len(keys))
    while len(rest):
        if len(sizes) > 200:
            raise ValueError("keys are not distinct")
        size = int(len(rest) * _GAMMA) + 1
        at = (_level_hash(keys[rest], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        parts.append(alone)
        rest = rest[~alone[at]]
    return sizes, np.concatenate(parts) if parts else np.zeros(0, bool)


def mph_slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each key, or -1 where no level has its bit; a nonmember may get any slot."""
    rank = np.cumsum(bits) - 1
    slots = np.full(len(keys), -1, np.int64)
    rest, base = np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = base + (_level_hash(keys[rest], level) % np.uint64(size)).astype(np.int64)
        hit = bits[at]
        slots[rest[hit]] = rank[at[hit]]
        rest, base = rest[~hit], base + size
    return slots


def _words(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, 4)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = _words(pdf["digest"])
    sizes, bits = build_mph(keys)
    slots = mph_slots(keys, sizes, bits)
    order = np.argsort(slots)
    return pd.DataFrame({
        "shard": [int(pdf["shard"].iloc[0])],
        "levels": [sizes],
        "bits": [np.packbits(bits).tobytes()],
        "digests": [keys[order].tobytes()],
        "winners": [pdf["winner"].to_numpy(np.int64)[order].tobytes()],
        "counts": [pdf["n"].to_numpy(np.int64)[order].tobytes()],
    })


def _merge(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """A shard's slots with members' counts added, then the nonmembers as they are."""
    out = new[["digest", "winner", "n"]]
    if not len(index):
        return out
    row = index.iloc[0]
    held = np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
    counts = np.frombuffer(row["counts"], np.int64).copy()
    if len(new):
        sizes = [int(x) for x in row["levels"]]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
        keys = _words(new["digest"])
        slots = mph_slots(keys, sizes, bits)
        known = (slots >= 0) & (held[np.maximum(slots, 0)] == keys).all(axis=1)
        np.add.at(counts, slots[known], new["n"].to_numpy(np.int64)[known])
        out = out[~known]
    slot = pd.DataFrame({"digest": [k.tobytes() for k in held], "winner": np.frombuffer(row["winners"], np.int64), "n": counts})
    return pd.concat([slot, out], ignore_index=True) if len(out) else slot


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    first = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    return groups.withColumn("shard", F.pmod(first, F.lit(shards)).cast("int"))


def build_index(history: DataFrame, shard_keys: int = 100_000) -> tuple[DataFrame, int]:
    """Index table and its number of shards, from one row per digest (digest, winner, n)."""
    ship(history.sparkSession)
    shards = max(1, -(-history.count() // shard_keys))
    return written(_sharded(history, shards).groupBy("shard").applyInPandas(_build, _INDEX), "mph"), shards


def merged(new: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """digest, winner, n of history's slots and of nonmembers; members' counts are in their slots. ``new`` has one row per digest."""
    return (
        _sharded(new, shards).groupBy("shard").cogroup(index.groupBy("shard"))
        .applyInPandas(_merge, "digest binary, winner long, n long")
    )


_NO_ID = 2**63 - 1


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = 100_000) -> DataFrame:
    """Per row of ``docs``: id, keep_id, group_size, kept, digest.

    The lower half of the ids is history, the upper half is what arrives; ids order both.
    """
    rows = written(digests(docs, id_col, text_col), "digests")
    total, middle = rows.agg(F.count(F.lit(1)), F.percentile_approx("id", 0.5)).first()
    old = F.col("id") <= F.lit(middle if middle is not None else 0).cast("long")

    def grouped(part: DataFrame) -> DataFrame:
        return part.groupBy("digest").agg(F.coalesce(F.min("id"), F.lit(_NO_ID)).cast("long").alias("winner"), F.count(F.lit(1)).alias("n"))

    history = written(grouped(rows.filter(old)), "history")
    index, shards = build_index(history, shard_keys)
    # A member the index did not find would be a second group of its digest: nothing groups by digest again.
    groups = written(merged(grouped(rows.filter(~F.coalesce(old, F.lit(False)))), index, shards), "groups")
    out = join_hot(rows, groups, "digest", "n", total)
    keep = F.when(F.col("winner") != _NO_ID, F.col("winner"))
    return out.select(
        F.col("id").alias("doc_id"), keep.alias("keep_id"), F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), "digest",
    )


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = exact_dedup(docs)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = {
    "op7_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
}
