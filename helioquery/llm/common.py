"""Shared helpers: written intermediate tables, skew-safe joins, Arrow maps and text hashing."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship as _ship

_BATCH, _BATCH_DEFAULT, _BATCH_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 8 << 20


def ship(spark: SparkSession) -> None:
    """Send the package to Python workers, and let texts reach them in batches of 8 MB unless the session says otherwise."""
    _ship(spark)
    if spark.conf.get(_BATCH).rstrip("b") == str(_BATCH_DEFAULT):
        spark.conf.set(_BATCH, str(_BATCH_OWN))


_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []
_SCRATCH: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="helioquery-")
    return _OWN[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/hq-{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    if (held := _SCRATCH.get()) is not None:
        held.append(path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    give_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def outcome(work: Callable[[], DataFrame], spark: SparkSession, tag: str) -> DataFrame:
    """What ``work`` returns, written; all tables written on the way are deleted."""
    mine: list[str] = []
    token = _SCRATCH.set(mine)
    try:
        df = work()
        _SCRATCH.reset(token)
        token = None
        return written(df, tag)
    finally:
        if token is not None:
            _SCRATCH.reset(token)
        for path in mine:
            delete(spark, path)
        release(spark)
        gone = set(mine)
        _WRITTEN[:] = [w for w in _WRITTEN if w[1] not in gone]


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage, which ended plans hold: Spark cleans their broadcasts and shuffles, on executors too, only then."""
    spark.sparkContext._jvm.java.lang.System.gc()
    give_back(spark)
    trim()


def give_back(spark: SparkSession) -> None:
    """Return what malloc holds free in the driver's JVM, much of it the compilers', to the system. A few milliseconds; nothing where Java
    before 17.0.9 or another C library than glibc runs."""
    jvm = spark.sparkContext._jvm
    arguments = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    with contextlib.suppress(Py4JError):
        arguments[0], arguments[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), arguments)


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """``names`` with a prefix that none of ``columns`` begins with, for helper columns beside a user's."""
    prefix, taken = "_hq_", [c.lower() for c in columns]
    while any(c.startswith(prefix) for c in taken):
        prefix = f"_{prefix}"
    return [f"{prefix}{n}" for n in names]


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # the JVM has gone already
            return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sampled(rows: DataFrame, mark: Column, share: float) -> DataFrame:
    """The rows whose mark, a 64-bit hash, is in the lowest ``share`` of its range; shares down to 2**-62 hold."""
    return rows.filter(F.shiftrightunsigned(mark, 2) < F.lit(share_bound(share)))


def share_bound(share: float) -> int:
    return min(2**62, int(2**62 * share))


def join_hot(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per ``key`` in ``groups``.

    Keys with more than a quarter of a mean partition of rows are joined by broadcast; there are at
    most ``4 * partitions`` of them whatever the data. The others are shuffled.
    """
    limit = max(1000, total // (4 * partitions(rows.sparkSession)))
    hot = F.broadcast(groups.filter(F.col(size) > limit))
    cold = rows.join(hot.select(key), key, "left_anti").join(groups.filter(F.col(size) <= limit), key)
    return rows.join(hot, key).unionByName(cold)


def crc32_of_id(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string"))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in short slices, so that few rows are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    trim()


def trim() -> None:
    """Give freed memory back; workers live on after their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


# -- hashing of words in numpy ---------------------------------------------------------------------

_U = np.uint64
#: ASCII lower-casing, with the white space characters 09-0D turned into spaces.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
#: As FOLD, with every ASCII character that is neither letter nor digit turned into a space.
FOLD_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)
)
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64 bits; a bijection."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            with np.errstate(over="ignore"):
                tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers


def word_hashes(folded: bytes) -> np.ndarray:
    """A 64-bit hash of each run of bytes other than the space, in order."""
    a = np.frombuffer(folded, np.uint8)
    inside = a != 32
    if not inside.any():
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(a))
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    with np.errstate(over="ignore"):
        value = _BYTE[a] * power[: len(a)]
        value[~inside] = 0
        return mix(np.add.reduceat(value, starts) * inverse[starts])


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of ``width`` consecutive words, sorted; fewer words make one shingle, none make none."""
    if not len(words):
        return words
    w = min(width, len(words))
    n = len(words) - w + 1
    with np.errstate(over="ignore"):
        h = np.full(n, w, np.uint64)
        for i in range(w):
            h = mix(h * _U(0xD6E8FEB86659FD93) + words[i : n + i])
    return np.unique(h)
