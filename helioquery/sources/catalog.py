"""A database is a directory; each table in it is ``<name>.parquet`` (file or directory) or ``<name>.arrow`` (Arrow IPC file)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from . import arrow_ipc

SUFFIXES = (".parquet", ".arrow")


def tables(spark: SparkSession, db_dir: str) -> dict[str, str]:
    """Path of every table, by name, listed through the directory's own file system."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(db_dir)
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in store.listStatus(top))
    return {n.rpartition(".")[0]: f"{db_dir.rstrip('/')}/{n}" for n in names if n.endswith(SUFFIXES)}


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A table, with only the columns given; Parquet prunes them in the scan, the Arrow source by its option."""
    if path.endswith(".arrow"):
        return arrow_ipc.read(spark, path, columns)
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def table_schema(spark: SparkSession, path: str) -> StructType:
    """The schema in the file's footer; no rows are read."""
    return read_table(spark, path).schema


def register(spark: SparkSession, db_dir: str, names: list[str] | None = None, views: bool = True) -> dict[str, DataFrame]:
    """DataFrames of the tables, and temporary views of their names."""
    found = {n: read_table(spark, p) for n, p in tables(spark, db_dir).items() if names is None or n in names}
    for n, df in found.items() if views else ():
        df.createOrReplaceTempView(n)
    return found


def used_columns(df: DataFrame) -> dict[str, list[str]]:
    """Of each Arrow source that a query reads (by path), the columns that the optimized plan refers to."""
    referred: set[int] = set()
    scans: list[tuple[str, list[tuple[int, str]]]] = []

    def each(seq):
        return [seq.apply(i) for i in range(seq.size())]

    def walk(node) -> None:
        referred.update(a.exprId().id() for a in each(node.references().toSeq()))
        for inner in (*each(node.children()), *each(node.subqueries())):
            walk(inner)
        if node.nodeName() == "DataSourceV2ScanRelation" and (path := node.relation().options().get("path")):
            scans.append((path, [(a.exprId().id(), a.name()) for a in each(node.output())]))

    plan = df._jdf.queryExecution().optimizedPlan()
    walk(plan)
    referred.update(a.exprId().id() for a in each(plan.output()))
    out: dict[str, list[str]] = {}
    for path, columns in scans:
        held = out.setdefault(path, [])
        held += [name for i, name in columns if i in referred and name not in held]
    return out


def preload(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The table or some columns of it, kept on the executors (memory, then disk) for repeated queries."""
    return (df.select(*columns) if columns else df).persist()
