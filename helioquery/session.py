"""The engine: a directory of tables, queried by SQL text, SQL files or textual plans as lazy DataFrames."""

from __future__ import annotations

import contextlib
import io
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .operators.relational import result_count
from .operators.sinks import to_text
from .plans.text import build
from .sources import catalog

#: Two ways to run a query, which must give the same results: row-wise code for whole stages, or columnar scans with
#: an operator at a time.
PARADIGMS = {
    "non-vectorised": {"spark.sql.codegen.wholeStage": "true", "spark.sql.parquet.enableVectorizedReader": "false"},
    "vectorised": {"spark.sql.codegen.wholeStage": "false", "spark.sql.parquet.enableVectorizedReader": "true"},
}


def new_session(app: str = "helioquery", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with adaptive execution and UTC; on a cluster make your own."""
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


@contextlib.contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings for a while."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@dataclass
class PreparedQuery:
    """A planned query; nothing runs before :meth:`execute` or :meth:`lines`."""

    df: DataFrame
    timings: dict[str, float] = field(default_factory=dict)
    paradigm: str | None = None

    def _conf(self):
        return settings(self.df.sparkSession, PARADIGMS[self.paradigm] if self.paradigm else {})

    def execute(self) -> list:
        """All rows on the driver."""
        start = time.perf_counter()
        with self._conf():
            rows = self.df.select("*").collect()  # planned now, under these settings
        self._ran(start)
        return rows

    def lines(self) -> Iterator[str]:
        start = time.perf_counter()
        with self._conf():
            yield from to_text(self.df)
        self._ran(start)

    def _ran(self, start: float) -> None:
        self.timings |= phases(self.df)
        self.timings["execution"] = (time.perf_counter() - start) * 1000
        self.timings["total"] = sum(v for k, v in self.timings.items() if k != "total")

    def timing_json(self) -> str:
        return json.dumps({k: round(v, 3) for k, v in self.timings.items()})


def phases(df: DataFrame) -> dict[str, float]:
    """Milliseconds of the analysis, optimization and planning of a DataFrame."""
    df._jdf.queryExecution().executedPlan()
    tracked, out = df._jdf.queryExecution().tracker().phases(), {}
    for name in ("parsing", "analysis", "optimization", "planning"):
        found = tracked.get(name)
        if found.isDefined():
            out[name] = float(found.get().durationMs())
    return out


class Engine:
    """Queries over the tables of one directory."""

    def __init__(self, spark: SparkSession, db_dir: str, paradigm: str | None = None):
        if paradigm is not None and paradigm not in PARADIGMS:
            raise ValueError(f"no such paradigm: {paradigm}; there are {', '.join(PARADIGMS)}")
        self.spark, self.db_dir, self.paradigm = spark, db_dir, paradigm
        self.tables = catalog.register(spark, db_dir)
        self._arrow = {n: p for n, p in catalog.tables(spark, db_dir).items() if p.endswith(".arrow")}

    def table(self, name: str, columns: list[str] | None = None) -> DataFrame:
        return self.tables[name].select(*columns) if columns else self.tables[name]

    def schema(self, name: str):
        return self.tables[name].schema

    def sql(self, text: str) -> DataFrame:
        """The result of a query, lazily; names are those of this engine's tables."""
        text = text.strip().rstrip(";")
        for n, df in self.tables.items():  # another engine may have taken the names meanwhile
            df.createOrReplaceTempView(n)
        whole = self.spark.sql(text)
        if not self._arrow:
            return whole
        # The optimizer doesn't prune what a Python data source reads, so the query is analysed again over the columns it uses.
        used = catalog.used_columns(whole)
        for n, path in self._arrow.items():
            if columns := used.get(path):
                catalog.read_table(self.spark, path, columns).createOrReplaceTempView(n)
        pruned = self.spark.sql(text)
        for n in self._arrow:
            self.tables[n].createOrReplaceTempView(n)
        return pruned

    def prepare(self, text: str, summarise: bool = False) -> PreparedQuery:
        start = time.perf_counter()
        df = self.sql(text)
        df = result_count(df) if summarise else df
        return PreparedQuery(df, {"parse": (time.perf_counter() - start) * 1000}, self.paradigm)

    def prepare_file(self, path: str, summarise: bool = False) -> PreparedQuery:
        return self.prepare(Path(path).read_text(), summarise)

    def plan(self, text: str) -> DataFrame:
        """The result of a textual plan, lazily."""
        return build(self.spark, self.db_dir, text)

    def summarise(self, text: str) -> DataFrame:
        return result_count(self.sql(text))

    def explain(self, text: str, mode: str = "formatted") -> str:
        """The plan as text; ``mode``: simple, extended, codegen, cost or formatted."""
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            self.sql(text).explain(mode)
        return out.getvalue()

    def cache(self, name: str, columns: list[str] | None = None) -> DataFrame:
        """Keep a table on the executors; later queries of the name read it from there."""
        kept = catalog.preload(self.tables[name], columns)
        kept.createOrReplaceTempView(name)
        self.tables[name] = kept
        self._arrow.pop(name, None)
        return kept
