"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, exact_dedup, importance, jaccard_join, langid, line_dedup, mixing, records, sharding, toxicity

_MODULES = (langid, sharding, toxicity, importance, decontam, records, exact_dedup, mixing, line_dedup, jaccard_join)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {n: f for m in _MODULES for n, f in vars(m).items() if n.startswith("op") and n[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {n: q for m in _MODULES for n, q in m.ORACLE.items()}
