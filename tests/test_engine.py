import json
import time

import pyarrow as pa
import pyarrow.ipc as ipc
import pytest
from compare import rows, same
from pyspark.sql import functions as F

from helioquery import queries
from helioquery.cli import main
from helioquery.operators.columnar import equal
from helioquery.plans import text as P
from helioquery.session import PARADIGMS, Engine, phases, settings
from helioquery.sources import arrow_ipc, catalog

Q = "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderpriority"


@pytest.fixture(scope="module")
def engine(spark, data):
    return Engine(spark, data)


def test_catalog(spark, data, engine):
    assert {"lineitem", "orders", "region"} <= set(catalog.tables(spark, data))
    assert catalog.table_schema(spark, f"{data}/region.parquet").names == ["r_regionkey", "r_name"]
    assert engine.table("region", ["r_name"]).columns == ["r_name"] and engine.schema("region").names[0] == "r_regionkey"


def test_sql_prepare_and_summarise(engine, duck, tmp_path):
    same(engine.sql(Q + ";"), duck, Q)
    f = tmp_path / "q.sql"
    f.write_text(Q)
    query = engine.prepare_file(str(f))
    assert len(query.execute()) == engine.summarise(Q).first()["result_count"]
    assert {"planning", "execution", "total"} <= set(json.loads(query.timing_json()))
    assert list(engine.prepare(Q, summarise=True).lines()) == [str(len(query.execute()))]
    assert phases(engine.sql(Q))["planning"] >= 0


def test_two_engines_share_a_session(spark, engine, tmp_path):
    spark.createDataFrame([(9, "X")], "r_regionkey int, r_name string").coalesce(1).write.parquet(str(tmp_path / "db/region.parquet"))
    other = Engine(spark, str(tmp_path / "db"))
    assert other.sql("SELECT * FROM region").count() == 1 and engine.sql("SELECT * FROM region").count() == 5


@pytest.mark.parametrize("name", ["tpch_q1_no_sort", "tpch_q3_no_sort", "tpch_q6", "join_bushy", "group_by_date", "project_div"])
def test_paradigms_agree(spark, data, duck, name):
    for conf in PARADIGMS.values():
        with settings(spark, conf):
            same(queries.QUERIES[name](spark, data), duck, queries.ORACLE[name])


def test_unknown_paradigm(spark, data):
    with pytest.raises(ValueError, match="paradigm"):
        Engine(spark, data, "sideways")


def test_plans_prune_push_and_broadcast(engine):
    text = engine.explain(queries.ORACLE["tpch_q6"])
    assert "PushedFilters" in text and "l_shipdate" in text
    scan = next(x for x in text.splitlines() if x.startswith("ReadSchema"))
    assert "l_comment" not in scan and scan.count(":") == 5 and "l_tax" not in scan
    assert "WholeStageCodegen" in engine.explain(Q, "codegen") or "Generated code" in engine.explain(Q, "codegen")
    assert "BroadcastHashJoin" in engine.explain("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")


def test_cache(spark, data):
    e = Engine(spark, data)
    kept = e.cache("nation", ["n_nationkey", "n_name"])
    assert kept.storageLevel.useMemory and e.sql("SELECT COUNT(*) FROM nation").first()[0] == 25
    kept.unpersist()
    Engine(spark, data)


def test_command_line(spark, data, tmp_path, capsys):
    f = tmp_path / "q.sql"
    f.write_text("SELECT r_regionkey, r_name FROM region WHERE r_regionkey = 1")
    assert main(["-d", data, "-q", str(f), "-t", "-p", "vectorised"]) == 0
    out = capsys.readouterr()
    assert out.out.startswith("1, ") and "execution" in json.loads(out.err.strip().splitlines()[-1])
    assert main(["-d", data, "-q", str(f), "-s"]) == 0 and capsys.readouterr().out == "1\n"
    p = tmp_path / "q.plan"
    p.write_text("S;region;true;0\nA;0;;COUNT()")
    assert main(["-d", data, "-q", str(p)]) == 0 and capsys.readouterr().out == "5\n"
    assert main(["-d", data, "-q", str(f), "-e", "formatted"]) == 0 and "Physical Plan" in capsys.readouterr().out


def test_plan_text_strings_and_arithmetic(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,(b);'c'", -2.0), (2, "x", 4.0), (None, None, None)], "i int, s string, d double")
    df.coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    run = lambda plan: P.build(spark, str(tmp_path), plan)
    assert run("S;t;false;0,1,2\nF;0;=($1, 'a,(b);''c''')").count() == 1
    assert rows(run("S;t;true;0,2\nF;0;<>($0, 1)\nP;1;[+($0, 1), *($1, $0), /(1, $0), -($0, 5)]")) == [(3, 8.0, 0.5, -3)]
    assert rows(run("S;t;true;0\nP;0;[CASE(=($0, 1), 10, 20), null:DOUBLE]")) == [(10, None), (20, None), (20, None)]
    assert run("S;t;true;1\nA;0;0;").count() == 3
    assert rows(run("S;t;true;0,2\nF;0;>($1, -2.5)\nP;1;[-($0, -5)]")) == [(6,), (7,)]
    assert rows(run("S;t;true;0\nS;t;true;0,1\nJ;0;1;0;1")) == [(1, 1, "a,(b);'c'"), (2, 2, "x")]


@pytest.mark.parametrize("plan", ["", "X;1", "S;nothing;true;0", "S;region;true;9", "S;region;true;0\nF;0;OR($0, 1)", "S;region;true;0\nF;0;=($0", "S;region;true;0\nP;0;[$5]", "S;region;true;0\nP;0;[null:BLOB]"])
def test_bad_plans(spark, data, plan):
    with pytest.raises(P.PlanError):
        P.build(spark, data, plan)


def test_arrow_files(spark, tmp_path):
    table = pa.table({"a": pa.array(range(100), pa.int32()), "b": [f"s{i}" for i in range(100)], "c": [None if i % 3 else i / 2 for i in range(100)]})
    with ipc.new_file(str(tmp_path / "t.arrow"), table.schema) as w:
        w.write_table(table, max_chunksize=3)
    df = arrow_ipc.read(spark, str(tmp_path / "t.arrow"))
    assert df.rdd.getNumPartitions() > 1 and equal(df, spark.createDataFrame(table))
    assert catalog.read_table(spark, str(tmp_path / "t.arrow"), ["c", "a"]).columns == ["c", "a"]
    assert Engine(spark, str(tmp_path)).sql("SELECT SUM(a) AS s FROM t").first()["s"] == 4950
    for compression in (None, "zstd", "lz4"):
        out = str(tmp_path / f"out-{compression}")
        assert len(arrow_ipc.write(df.repartition(3), out, compression=compression)) == 3
        assert equal(arrow_ipc.read(spark, out), df)
    (name,) = arrow_ipc.write(df.coalesce(1), str(tmp_path / "stream"), stream=True)
    assert arrow_ipc.read_stream(str(tmp_path / "stream" / name)).num_rows == 100


def test_stream_agrees_with_table(spark, data, tmp_path):
    from helioquery.streaming import events as E

    static = spark.read.parquet(f"{data}/events.parquet")
    static.coalesce(2).write.parquet(str(tmp_path / "in"))
    q = E.windowed(E.read_events(spark, str(tmp_path / "in"), static)).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = E.windowed(static).withColumn("total", F.round("total", 6))
    assert rows(spark.table("windows").withColumn("total", F.round("total", 6)).select("event_type", "n", "total")) == rows(want.select("event_type", "n", "total"))


def test_prepared_query_is_lazy(engine):
    start = time.perf_counter()
    engine.prepare("SELECT SUM(a.l_quantity) FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey")
    assert time.perf_counter() - start < 5


def test_arrow_scans_read_the_columns_used(spark, data, duck):
    top = queries._arrow(spark, data, "customer", "nation")
    over = Engine(spark, top)

    def read(df):
        plan, out = df._jdf.queryExecution().optimizedPlan().toString(), {}
        for line in filter(lambda x: "RelationV2" in x, plan.splitlines()):
            names = line.split("RelationV2", 1)[1].split("[", 1)[1].split("]", 1)[0]
            out[len(out)] = sorted(x.split("#")[0].strip() for x in names.split(",") if x.strip())
        return sorted(out.values())

    assert read(over.sql("SELECT c_acctbal FROM customer")) == [["c_acctbal"]]
    assert read(over.plan("S;customer;true;0")) == [["c_custkey"]]
    q = "SELECT n_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
    assert read(over.sql(q)) == [["c_nationkey"], ["n_name", "n_nationkey"]]
    same(over.sql(q), duck, q)
    for q in (queries._ARROW_SQL, "SELECT COUNT(*) AS n FROM customer",
              "WITH x AS (SELECT * FROM customer) SELECT a.c_custkey, b.c_name FROM x a JOIN x b ON a.c_custkey = b.c_custkey WHERE a.c_nationkey = 3",
              "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 0)"):
        same(over.sql(q), duck, q)
    over.cache("nation")
    assert over.sql("SELECT n_name FROM nation").count() == over.sql("SELECT * FROM nation").count()
