"""Every query with SQL agrees with it; every query runs on the small tables."""

import pytest
from compare import same

from helioquery.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, data, duck, name):
    sql = queries.oracle_sql()[name]
    if name == "op8_mixing":  # doubles of another order of sums
        sql = f"SELECT doc_id, size, source_size, ROUND(target, 6) AS target, taken FROM ({sql})"
        from pyspark.sql import functions as F

        return same(queries.queries()[name](spark, data).withColumn("target", F.round("target", 6)), duck, sql)
    return same(queries.queries()[name](spark, data), duck, sql)


def test_all_operators_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
