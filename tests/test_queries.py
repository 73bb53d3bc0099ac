import duckdb
import pytest
from compare import rows, same

from helioquery import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_agrees_with_sql(spark, data, duck, name):
    same(queries.QUERIES[name](spark, data), duck, queries.ORACLE[name])


def test_cast_of_halves_agrees_with_sql(spark, tmp_path):
    prices = [None, -200000.5, 99999.5, 100000.0, 199999.5, 200000.49999999997, 200000.5, 200000.50000000003, 200000.51, 200001.5, 9e18]
    priorities = [None, "1-URGENT", "2-HIGH", "5-LOW"]
    table = [(i, *x) for i, x in enumerate((p, q) for p in prices for q in priorities)]
    spark.createDataFrame(table, "o_orderkey long, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    found = queries.filter_null_in_cast(spark, str(tmp_path))
    same(found, con, queries.ORACLE["filter_null_in_cast"])
    assert (table.index((27, 200000.5, "5-LOW")),) in rows(found)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["l_orderkey", "revenue", "o_orderdate"]
    assert set(e.oracle_sql()) <= set(e.queries())
