"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers.

Rows are numbered 0 .. n-1 by id (then by the other columns given): a range partitioning sorts them, each partition
counts its rows, and the counts' prefix sums are added. A Feistel network over Z_a x Z_b, with a*b just above n, permutes
the numbers; a number that leaves 0 .. n-1 walks along its cycle until it is back. Place p goes to shard ``p % shards``,
slot ``p // shards``: counts are at most one apart and slots have no gaps (law ``rows``). :func:`place_of` computes the
same in plain Python for one row number, and :func:`row_of` inverts it.

Nulls, empty texts and repeated rows are numbered like any other row; equal rows are interchangeable. An empty table
gives an empty result; columns named like the ones added are replaced.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, unused, written

_PRIME = 2**31 - 1
ROUNDS = 8


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Multiplier and addend of each round, from the seed."""
    keys, x = [], (seed * 2 + 1) % _PRIME
    for _ in range(ROUNDS):
        pair = []
        for _ in range(2):
            x = (x * 48271 + 11) % _PRIME
            pair.append(x)
        keys.append((pair[0] | 1, pair[1]))
    return keys


def halves(n: int) -> tuple[int, int]:
    """a, b with n <= a * b < n + a."""
    a = isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def _f(x: int, key: tuple[int, int]) -> int:
    x %= _PRIME
    return (((x * x + key[1]) % _PRIME) * key[0] + x) % _PRIME


def _once(p: int, a: int, b: int, keys: list[tuple[int, int]]) -> int:
    left, right = p // b, p % b
    for i, key in enumerate(keys):
        if i % 2:
            right = (right + _f(left, key)) % b
        else:
            left = (left + _f(right, key)) % a
    return left * b + right


def _back(p: int, a: int, b: int, keys: list[tuple[int, int]]) -> int:
    left, right = p // b, p % b
    for i, key in reversed(list(enumerate(keys))):
        if i % 2:
            right = (right - _f(left, key)) % b
        else:
            left = (left - _f(right, key)) % a
    return left * b + right


def place_of(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number."""
    a, b = halves(n)
    p = _once(row, a, b, round_keys(seed))
    while p >= n:
        p = _once(p, a, b, round_keys(seed))
    return p % shards, p // shards


def row_of(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """Row number at a shard and slot."""
    a, b = halves(n)
    p = _back(slot * shards + shard, a, b, round_keys(seed))
    while p >= n:
        p = _back(p, a, b, round_keys(seed))
    return p


def _div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by).cast("long"))


def permuted(row: Column, n: int, seed: int = 0) -> Column:
    """The place of each row number, as a native expression."""
    a, b = halves(n)
    keys = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(c).cast("long").alias("c"), F.lit(i % 2 == 1).alias("odd")) for i, (m, c) in enumerate(round_keys(seed))])

    def f(x: Column, key: Column) -> Column:
        x = x % F.lit(_PRIME)
        return (((x * x + key["c"]) % F.lit(_PRIME)) * key["m"] + x) % F.lit(_PRIME)

    def one_round(s: Column, key: Column) -> Column:
        return F.struct(
            F.when(key["odd"], s["l"]).otherwise((s["l"] + f(s["r"], key)) % F.lit(a)).alias("l"),
            F.when(key["odd"], (s["r"] + f(s["l"], key)) % F.lit(b)).otherwise(s["r"]).alias("r"),
        )

    def once(p: Column) -> Column:
        start = F.struct(_div(p, b).alias("l"), (p % F.lit(b).cast("long")).alias("r"))
        return F.aggregate(keys, start, one_round, lambda s: s["l"] * F.lit(b).cast("long") + s["r"])

    first = once(row)
    if a * b == n:
        return first
    # Fewer than a numbers lie outside, so a walk of a steps always comes back.
    return F.transform(F.array(first), lambda p: F.when(p < n, p).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.lit(a)), p, lambda q, _: F.when(q < n, q).otherwise(once(q)))))[0]


def with_row_numbers(df: DataFrame, order: list[str | Column], name: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with numbers 0 .. n-1 in the order given, and n; no task sees more than its range."""
    spark = df.sparkSession
    tie, at, part, before = unused(df.columns, "tie", "at", "part", "before")
    keys = unused(df.columns, *[f"key{i}" for i in range(len(order))])
    keyed = df.withColumns({k: o if isinstance(o, Column) else df[o] for k, o in zip(keys, order, strict=True)})
    # The tie column only spreads equal rows over partitions.
    tied = keyed.withColumn(tie, F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(partitions(spark), *keys, tie).sortWithinPartitions(*keys, tie).drop(tie, *keys)
    held = written(dealt.withColumn(at, F.monotonically_increasing_id()), "numbered")
    number = F.shiftright(at, 33)
    counts = held.groupBy(number.alias(part)).agg(F.count(F.lit(1)).alias(before)).orderBy(part).collect()  # one row a partition
    base, n = [], 0
    for k, m in counts:
        base.append((k, n))
        n += m
    sums = F.broadcast(spark.createDataFrame(base, f"{part} long, {before} long"))  # as many rows as partitions
    out = held.withColumn(part, number).join(sums, part)
    return out.withColumn(name, F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at, part, before), n


def shard(df: DataFrame, shards: int = 16, order: list[str | Column] | None = None, seed: int = 0) -> DataFrame:
    """``df`` with its columns and row_number, shard (int) and slot (long)."""
    df = df.drop("row_number", "shard", "slot")
    numbered, n = with_row_numbers(df, order or ["doc_id"])
    (place,) = unused(df.columns, "place")
    placed = numbered.withColumn(place, permuted(F.col("row_number"), n, seed))
    return placed.withColumn("shard", (F.col(place) % shards).cast("int")).withColumn("slot", _div(F.col(place), shards)).drop(place)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """Law ``rows``: every document gets one of 16 shards and a slot there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    keys = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    out = shard(keys, 16, ["doc_id", "size", "text_crc32"], seed=20)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def _oracle(shards: int, seed: int) -> str:
    """The same in SQL: CRC-32 by its table, the rounds as nested selects, walks as recursion."""
    rounds = "SELECT row_number, p // b AS l, p % b AS r FROM {} , k"
    for i, (m, c) in enumerate(round_keys(seed)):
        x, own, size = ("l", "r", "b") if i % 2 else ("r", "l", "a")
        x = f"({x} % {_PRIME})"
        moved = f"({own} + ((({x} * {x} + {c}) % {_PRIME}) * {m} + {x}) % {_PRIME}) % {size} AS {own}"
        rounds = f"SELECT row_number, {'l, ' + moved if i % 2 else moved + ', r'} FROM ({rounds}), k"
    rounds = f"SELECT row_number, l * b + r AS p FROM ({rounds}), k"
    return f"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(list_concat([CAST(i AS BIGINT)], [0, 0, 0, 0, 0, 0, 0, 0]),
         lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
         list_transform(range(len(h) // 2), lambda i: CAST(strpos('0123456789ABCDEF', h[2 * i + 1]) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 17 AS BIGINT))),
         lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]))) AS text_crc32 FROM d, tab),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row_number FROM e),
k AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM documents)),
w AS (
  {rounds.format("(SELECT row_number, row_number AS p FROM n)")}
  UNION ALL
  {rounds.format("(SELECT row_number, p FROM w, k WHERE p >= n)")})
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(p % {shards} AS INTEGER) AS shard, p // {shards} AS slot,
       CAST(NULL AS INTEGER) AS grown_shard, n.row_number
FROM n JOIN w USING (row_number), k WHERE p < k.n
"""


ORACLE = {"op2_sharding": _oracle(16, 20)}
