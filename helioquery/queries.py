"""The reference queries: one for each operator and expression, and the three flagships, with the SQL they must agree with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import columnar, relational
from .plans.text import build
from .sources import arrow_ipc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return relational.scan(spark, f"{d}/{name}.parquet", list(columns) or None)


def _simple(name: str, table: str, columns: list[str], condition: Callable[[], object], where: str) -> None:
    """A filter query over one table."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _t(spark, d, table).filter(condition()).select(*columns)

    QUERIES[name] = run
    ORACLE[name] = f"SELECT {', '.join(columns)} FROM {table} WHERE {where}"


c = F.col


def _date(text: str):
    return F.lit(text).cast("date")


# -- scans -------------------------------------------------------------------------------------------


@_query("SELECT r_regionkey, r_name FROM region")
def scan_full(spark, d):
    return _t(spark, d, "region")


@_query("SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem")
def scan_pruned(spark, d):
    return _t(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_returnflag")


# -- filters -----------------------------------------------------------------------------------------

_LINE = ["l_orderkey", "l_linenumber", "l_quantity"]
_simple("filter_eq_int", "nation", ["n_nationkey", "n_name"], lambda: c("n_regionkey") == 1, "n_regionkey = 1")
_simple("filter_eq_string", "customer", ["c_custkey", "c_mktsegment"], lambda: c("c_mktsegment") == "BUILDING", "c_mktsegment = 'BUILDING'")
_simple("filter_eq_date", "orders", ["o_orderkey"], lambda: c("o_orderdate") == _date("1996-03-15"), "o_orderdate = DATE '1996-03-15'")
_simple("filter_eq_double", "lineitem", _LINE, lambda: c("l_quantity") == 24.0, "l_quantity = 24")
_simple("filter_gt", "lineitem", _LINE, lambda: c("l_quantity") > 45, "l_quantity > 45")
_simple("filter_ge", "part", ["p_partkey", "p_size"], lambda: c("p_size") >= 40, "p_size >= 40")
_simple("filter_lt", "lineitem", _LINE, lambda: c("l_shipdate") < _date("1995-06-01"), "l_shipdate < DATE '1995-06-01'")
_simple("filter_le", "part", ["p_partkey", "p_size"], lambda: c("p_size") <= 5, "p_size <= 5")
_simple("filter_and_chain", "lineitem", _LINE, lambda: X.all_of([c("l_quantity") < 10, c("l_returnflag") == "R", c("l_discount") > 0.05, c("l_linenumber") >= 2]), "l_quantity < 10 AND l_returnflag = 'R' AND l_discount > CAST(0.05 AS DOUBLE) AND l_linenumber >= 2")
_simple("filter_between", "lineitem", [*_LINE, "l_discount"], lambda: X.between(c("l_discount"), 0.05, 0.07), "l_discount BETWEEN CAST(0.05 AS DOUBLE) AND CAST(0.07 AS DOUBLE)")
_simple("filter_between_date", "lineitem", _LINE, lambda: X.between(c("l_shipdate"), _date("1996-01-01"), _date("1996-03-01"), closed=False), "l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-03-01'")
_simple("filter_interval_day", "lineitem", _LINE, lambda: c("l_shipdate") > X.date_shift("2001-12-01", -90, "DAY"), "l_shipdate > DATE '2001-12-01' - INTERVAL 90 DAY")
_simple("filter_interval_week", "lineitem", _LINE, lambda: c("l_shipdate") < X.date_shift("1995-01-01", 8, "WEEK"), "l_shipdate < DATE '1995-01-01' + INTERVAL 56 DAY")
_simple("filter_interval_month", "orders", ["o_orderkey"], lambda: (c("o_orderdate") >= _date("1996-01-31")) & (c("o_orderdate") < X.date_shift("1996-01-31", 1, "MONTH")), "o_orderdate >= DATE '1996-01-31' AND o_orderdate < DATE '1996-01-31' + INTERVAL 1 MONTH")
_simple("filter_interval_year", "orders", ["o_orderkey"], lambda: c("o_orderdate") >= X.date_shift("2002-02-28", -1, "YEAR"), "o_orderdate >= DATE '2002-02-28' - INTERVAL 1 YEAR")
_simple("filter_col_col", "supplier", ["s_suppkey", "s_nationkey"], lambda: c("s_nationkey") < c("s_suppkey"), "s_nationkey < s_suppkey")
_simple("filter_ne", "nation", ["n_nationkey", "n_regionkey"], lambda: c("n_regionkey") != 2, "n_regionkey <> 2")
_simple("filter_contains", "part", ["p_partkey", "p_name"], lambda: X.contains(c("p_name"), "l ri"), "p_name LIKE '%l ri%'")
_simple("filter_bool_ops", "part", ["p_partkey"], lambda: ~(c("p_size") % 2 == 0) | (c("p_size") == 10), "NOT (p_size % 2 = 0) OR p_size = 10")

# -- projections -------------------------------------------------------------------------------------


@_query("SELECT n_nationkey, CAST(7 AS INTEGER) AS seven, CAST(1.5 AS DOUBLE) AS half, CAST(NULL AS DOUBLE) AS nothing FROM nation")
def project_literals(spark, d):
    return relational.project(_t(spark, d, "nation"), n_nationkey=c("n_nationkey"), seven=F.lit(7), half=F.lit(1.5), nothing=F.lit(None).cast("double"))


@_query("SELECT l_orderkey, l_linenumber, l_linenumber + 2 AS plus, l_linenumber - 2 AS minus, l_linenumber * 3 AS times, ROUND(l_linenumber * l_tax, 4) AS int_dbl, ROUND(l_extendedprice * l_discount, 6) AS dbl_dbl FROM lineitem")
def project_arith(spark, d):
    n = c("l_linenumber")
    return relational.project(_t(spark, d, "lineitem"), l_orderkey=c("l_orderkey"), l_linenumber=n, plus=n + 2, minus=n - 2, times=n * 3, int_dbl=F.round(n * c("l_tax"), 4), dbl_dbl=F.round(c("l_extendedprice") * c("l_discount"), 6))


@_query("SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount) * (1 + l_tax), 8) AS charge FROM lineitem")
def project_nested(spark, d):
    return relational.project(_t(spark, d, "lineitem"), l_orderkey=c("l_orderkey"), l_linenumber=c("l_linenumber"), charge=F.round(c("l_extendedprice") * (1 - c("l_discount")) * (1 + c("l_tax")), 8))


@_query("SELECT p_partkey, ROUND(p_retailprice / p_size, 6) AS dbl, p_size / 4 AS whole, CASE WHEN p_size - 5 = 0 THEN NULL ELSE ROUND(1.0::DOUBLE / (p_size - 5), 6) END AS safe FROM part")
def project_div(spark, d):
    return relational.project(_t(spark, d, "part"), p_partkey=c("p_partkey"), dbl=F.round(X.divide(c("p_retailprice"), c("p_size")), 6), whole=X.divide(c("p_size"), F.lit(4)), safe=F.round(X.divide(F.lit(1), c("p_size") - 5), 6))


@_query("SELECT o_orderstatus, CASE WHEN COUNT(*) = 0 THEN NULL ELSE ROUND(SUM(o_totalprice), 2) END AS total, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_f FROM orders GROUP BY o_orderstatus")
def project_case_eq(spark, d):
    out = relational.aggregate(_t(spark, d, "orders"), ["o_orderstatus"], n=F.count(F.lit(1)), s=X.sum0(c("o_totalprice")))
    return relational.project(out, o_orderstatus=c("o_orderstatus"), total=X.case_eq(c("n"), F.lit(0), F.lit(None).cast("double"), F.round("s", 2)), is_f=X.case_eq(c("o_orderstatus"), F.lit("F"), F.lit(1), F.lit(0)))


# -- aggregation -------------------------------------------------------------------------------------


@_query("SELECT COUNT(*) AS n FROM lineitem")
def agg_count(spark, d):
    return relational.aggregate(_t(spark, d, "lineitem"), [], n=F.count(F.lit(1)))


@_query("SELECT CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem")
def agg_sum_int(spark, d):
    return relational.aggregate(_t(spark, d, "lineitem"), [], s=X.sum0(c("l_linenumber")))


@_query("SELECT ROUND(SUM(l_extendedprice), 2) AS s FROM lineitem WHERE l_quantity < 10")
def agg_sum_double(spark, d):
    return relational.aggregate(_t(spark, d, "lineitem").filter(c("l_quantity") < 10), [], s=F.round(F.sum("l_extendedprice"), 2))


@_query("SELECT COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s, ROUND(SUM(l_quantity), 2) AS q, ROUND(AVG(l_quantity), 6) AS a FROM lineitem")
def agg_multi(spark, d):
    return relational.aggregate(_t(spark, d, "lineitem"), [], n=F.count(F.lit(1)), s=F.sum("l_linenumber"), q=F.round(F.sum("l_quantity"), 2), a=F.round(X.average(c("l_quantity")), 6))


@_query("SELECT COUNT(*) AS n, SUM(l_quantity) AS s, AVG(l_quantity) AS a, CAST(COALESCE(SUM(l_linenumber), 0) AS BIGINT) AS s0 FROM lineitem WHERE l_quantity < 0")
def agg_empty(spark, d):
    rows = _t(spark, d, "lineitem").filter(c("l_quantity") < 0)
    return relational.aggregate(rows, [], n=F.count(F.lit(1)), s=X.sum_or_null(c("l_quantity")), a=X.average(c("l_quantity")), s0=X.sum0(c("l_linenumber")))


@_query("SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag")
def group_count(spark, d):
    return relational.aggregate(_t(spark, d, "lineitem"), ["l_returnflag"], n=F.count(F.lit(1)))


@_query("SELECT p_brand, CAST(SUM(p_size) AS BIGINT) AS s FROM part GROUP BY p_brand")
def group_sum_int(spark, d):
    return relational.aggregate(_t(spark, d, "part"), ["p_brand"], s=F.sum("p_size"))


@_query("SELECT c_mktsegment, ROUND(SUM(c_acctbal), 2) AS s FROM customer GROUP BY c_mktsegment")
def group_sum_double(spark, d):
    return relational.aggregate(_t(spark, d, "customer"), ["c_mktsegment"], s=F.round(F.sum("c_acctbal"), 2))


@_query("SELECT o_orderpriority, ROUND(AVG(o_totalprice), 4) AS a FROM orders GROUP BY o_orderpriority")
def group_avg(spark, d):
    return relational.aggregate(_t(spark, d, "orders"), ["o_orderpriority"], a=F.round(X.average(c("o_totalprice")), 4))


@_query("SELECT l_returnflag, l_linestatus, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber")
def group_multi_key(spark, d):
    return relational.aggregate(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], n=F.count(F.lit(1)))


@_query("SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, COUNT(*) AS n FROM orders GROUP BY CAST(o_orderdate AS DATE)")
def group_by_date(spark, d):
    days = relational.project(_t(spark, d, "orders"), day=c("o_orderdate").cast("date"))
    return relational.aggregate(days, ["day"], n=F.count(F.lit(1))).withColumn("day", c("day").cast("string"))


@_query("SELECT l_discount, COUNT(*) AS n FROM lineitem GROUP BY l_discount")
def group_by_double(spark, d):
    return relational.aggregate(_t(spark, d, "lineitem"), ["l_discount"], n=F.count(F.lit(1)))


@_query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def group_no_aggregate(spark, d):
    return relational.aggregate(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@_query("SELECT n, COUNT(*) AS customers FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n")
def agg_of_agg(spark, d):
    return relational.aggregate(relational.aggregate(_t(spark, d, "orders"), ["o_custkey"], n=F.count(F.lit(1))), ["n"], customers=F.count(F.lit(1)))


@_query("SELECT l_orderkey, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 150")
def having_filter(spark, d):
    return relational.aggregate(_t(spark, d, "lineitem"), ["l_orderkey"], q=F.round(F.sum("l_quantity"), 2)).filter(c("q") > 150)


# -- joins -------------------------------------------------------------------------------------------


@_query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_two(spark, d):
    return relational.inner_join(_t(spark, d, "region"), _t(spark, d, "nation"), "r_regionkey", "n_regionkey").select("n_nationkey", "n_name", "r_name")


@_query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_acctbal < 0")
def join_many_to_many(spark, d):
    poor = _t(spark, d, "customer").filter(c("c_acctbal") < 0)
    return relational.inner_join(_t(spark, d, "supplier"), poor, "s_nationkey", "c_nationkey", build="left").select("s_suppkey", "c_custkey")


@_query("SELECT c_custkey, o_orderkey, l_linenumber FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_mktsegment = 'BUILDING' AND l_quantity > 48")
def join_three(spark, d):
    inner = relational.inner_join(_t(spark, d, "customer").filter(c("c_mktsegment") == "BUILDING"), _t(spark, d, "orders"), "c_custkey", "o_custkey")
    return relational.inner_join(inner, _t(spark, d, "lineitem").filter(c("l_quantity") > 48), "o_orderkey", "l_orderkey").select("c_custkey", "o_orderkey", "l_linenumber")


@_query("SELECT s_suppkey, r_name, l_orderkey, p_size FROM (supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) JOIN (lineitem JOIN part ON l_partkey = p_partkey) ON s_suppkey = l_suppkey WHERE p_size = 1")
def join_bushy(spark, d):
    left = relational.inner_join(relational.inner_join(_t(spark, d, "nation"), _t(spark, d, "supplier"), "n_nationkey", "s_nationkey"), _t(spark, d, "region"), "n_regionkey", "r_regionkey")
    right = relational.inner_join(_t(spark, d, "part").filter(c("p_size") == 1), _t(spark, d, "lineitem"), "p_partkey", "l_partkey")
    return relational.inner_join(left, right, "s_suppkey", "l_suppkey").select("s_suppkey", "r_name", "l_orderkey", "p_size")


@_query("SELECT l_orderkey, l_linenumber, ROUND(p_retailprice * l_quantity, 2) AS worth FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_quantity > 45")
def join_project(spark, d):
    out = relational.inner_join(_t(spark, d, "part"), _t(spark, d, "lineitem").filter(c("l_quantity") > 45), "p_partkey", "l_partkey")
    return relational.project(out, l_orderkey=c("l_orderkey"), l_linenumber=c("l_linenumber"), worth=F.round(c("p_retailprice") * c("l_quantity"), 2))


@_query("SELECT n_name, COUNT(*) AS n, ROUND(SUM(c_acctbal), 2) AS s FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name")
def join_group(spark, d):
    out = relational.inner_join(_t(spark, d, "nation"), _t(spark, d, "customer"), "n_nationkey", "c_nationkey")
    return relational.aggregate(out, ["n_name"], n=F.count(F.lit(1)), s=F.round(F.sum("c_acctbal"), 2))


@_query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE s_acctbal < c_acctbal AND c_acctbal > 9900")
def join_residual_filter(spark, d):
    out = relational.inner_join(_t(spark, d, "supplier"), _t(spark, d, "customer").filter(c("c_acctbal") > 9900), "s_nationkey", "c_nationkey")
    return out.filter(c("s_acctbal") < c("c_acctbal")).select("s_suppkey", "c_custkey")


@_query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'NOWHERE'")
def join_empty(spark, d):
    return relational.inner_join(_t(spark, d, "region").filter(c("r_name") == "NOWHERE"), _t(spark, d, "nation"), "r_regionkey", "n_regionkey").select("n_name", "r_name")


@_query("SELECT COUNT(*) AS result_count FROM (SELECT o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' GROUP BY o_custkey)")
def summarise_count(spark, d):
    out = relational.inner_join(_t(spark, d, "customer").filter(c("c_mktsegment") == "MACHINERY"), _t(spark, d, "orders"), "c_custkey", "o_custkey")
    return relational.result_count(relational.aggregate(out, ["o_custkey"]))


# -- flagships ---------------------------------------------------------------------------------------

_Q6 = """SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount >= CAST(0.05 AS DOUBLE) AND l_discount <= CAST(0.07 AS DOUBLE) AND l_quantity < 24"""
_Q3 = """SELECT l_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate
FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
AND o_orderdate < DATE '1996-03-15' AND l_shipdate > DATE '1996-03-15' GROUP BY l_orderkey, CAST(o_orderdate AS DATE)"""


@_query(_Q6)
def tpch_q6(spark, d):
    rows = relational.filter_all(_t(spark, d, "lineitem"), X.between(c("l_shipdate"), _date("1996-01-01"), _date("1997-01-01"), closed=False), X.between(c("l_discount"), 0.05, 0.07), c("l_quantity") < 24)
    return relational.aggregate(rows, [], revenue=F.round(F.sum(c("l_extendedprice") * c("l_discount")), 2))


@_query("""SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base_price,
ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
ROUND(AVG(l_quantity), 6) AS avg_qty, ROUND(AVG(l_extendedprice), 4) AS avg_price, ROUND(AVG(l_discount), 8) AS avg_disc, COUNT(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL 90 DAY GROUP BY l_returnflag, l_linestatus""")
def tpch_q1_no_sort(spark, d):
    rows = _t(spark, d, "lineitem").filter(c("l_shipdate") <= X.date_shift("1998-12-01", -90, "DAY"))
    sold = c("l_extendedprice") * (1 - c("l_discount"))
    return relational.aggregate(
        rows, ["l_returnflag", "l_linestatus"], sum_qty=F.round(F.sum("l_quantity"), 2), sum_base_price=F.round(F.sum("l_extendedprice"), 2),
        sum_disc_price=F.round(F.sum(sold), 2), sum_charge=F.round(F.sum(sold * (1 + c("l_tax"))), 2), avg_qty=F.round(F.avg("l_quantity"), 6),
        avg_price=F.round(F.avg("l_extendedprice"), 4), avg_disc=F.round(F.avg("l_discount"), 8), count_order=F.count(F.lit(1)))


@_query(_Q3)
def tpch_q3_no_sort(spark, d):
    customers = _t(spark, d, "customer").filter(c("c_mktsegment") == "BUILDING").select("c_custkey")
    orders = _t(spark, d, "orders").filter(c("o_orderdate") < _date("1996-03-15")).select("o_orderkey", "o_custkey", c("o_orderdate").cast("date").cast("string").alias("o_orderdate"))
    lines = _t(spark, d, "lineitem").filter(c("l_shipdate") > _date("1996-03-15"))
    out = relational.inner_join(relational.inner_join(customers, orders, "c_custkey", "o_custkey"), lines, "o_orderkey", "l_orderkey")
    return relational.aggregate(out, ["l_orderkey", "o_orderdate"], revenue=F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 4)).select("l_orderkey", "revenue", "o_orderdate")


_PLAN_Q6 = """S;lineitem;true;4,5,6,10
F;0;AND(>=($3, 1996-01-01), <($3, +(1996-01-01, *(12, 1:INTERVAL MONTH))), >=($2, 0.05:DECIMAL(3, 2)), <=($2, 0.07:DECIMAL(3, 2)), <($0, 24))
P;1;[*($1, $2)]
A;2;;COUNT(),$SUM0($0)
P;3;[CASE(=($0, 0), null:DOUBLE, $1)]"""
_PLAN_Q3 = """S;customer;true;0,4
F;0;=($1, 'BUILDING')
S;orders;true;0,1,4
F;2;<($2, 1996-03-15)
J;1;3;0;3
S;lineitem;true;0,5,6,10
F;5;>($3, 1996-03-15)
P;6;[$0,*($1, -(1, $2))]
J;4;7;2;5
A;8;5,4;$SUM0($6)"""


@_query(_Q6)
def plan_text_q6(spark, d):
    return build(spark, d, _PLAN_Q6).select(F.round("_0", 2).alias("revenue"))


@_query(_Q3)
def plan_text_q3(spark, d):
    return build(spark, d, _PLAN_Q3).select(c("_0").alias("l_orderkey"), F.round("_2", 4).alias("revenue"), c("_1").cast("date").cast("string").alias("o_orderdate"))


# -- columnar helpers --------------------------------------------------------------------------------


@_query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS o_orderpriority FROM orders")
def dict_encode(spark, d):
    return columnar.dictionary_encode(_t(spark, d, "orders", "o_orderkey", "o_orderpriority"), "o_orderpriority")


@_query("SELECT p_partkey, p_brand FROM part")
def dict_decode_roundtrip(spark, d):
    part = _t(spark, d, "part", "p_partkey", "p_brand")
    codes = columnar.dictionary(part, "p_brand")
    return columnar.dictionary_decode(columnar.dictionary_encode(part, "p_brand", codes), "p_brand", codes)


@_query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def append_union_all(spark, d):
    return columnar.append(_t(spark, d, "nation").select(c("n_nationkey").alias("k"), c("n_name").alias("name")), _t(spark, d, "region").select(c("r_regionkey").alias("k"), c("r_name").alias("name")))


@_query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 100")
def slice_rows(spark, d):
    return columnar.slice_rows(_t(spark, d, "customer", "c_custkey", "c_name"), ["c_custkey"], 100, 20)


@_query("SELECT r_regionkey || chr(9) || r_name AS line FROM region")
def render_tsv(spark, d):
    return columnar.to_tsv(_t(spark, d, "region", "r_regionkey", "r_name"))


@_query("SELECT n_nationkey || ', ' || n_name AS line FROM nation")
def render_text(spark, d):
    from .operators.sinks import text_rows

    return text_rows(_t(spark, d, "nation", "n_nationkey", "n_name"))


# -- the Arrow source --------------------------------------------------------------------------------


def _arrow(spark: SparkSession, d: str, *names: str) -> str:
    """A directory with tables as Arrow IPC files, in the folder that ``spark.checkpoint.dir`` names (local mode: a temporary one)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    top = f"{(base or tempfile.gettempdir()).rstrip('/')}/hq-arrow-{uuid.uuid4().hex}"
    for name in names:
        arrow_ipc.write(_t(spark, d, name), f"{top}/{name}.arrow")
    return top


@_query("SELECT * FROM nation")
def arrow_scan_full(spark, d):
    return arrow_ipc.read(spark, f"{_arrow(spark, d, 'nation')}/nation.arrow")


@_query("SELECT c_custkey, c_acctbal FROM customer")
def arrow_scan_pruned(spark, d):
    return arrow_ipc.read(spark, f"{_arrow(spark, d, 'customer')}/customer.arrow", ["c_custkey", "c_acctbal"])


_ARROW_SQL = "SELECT n_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer) GROUP BY n_name"


@_query(_ARROW_SQL)
def arrow_sql(spark, d):
    from .session import Engine

    return Engine(spark, _arrow(spark, d, "customer", "nation")).sql(_ARROW_SQL)


@_query("SELECT c_custkey, c_acctbal - (-5) AS moved FROM customer WHERE c_acctbal > -500")
def arrow_plan_text(spark, d):
    plan = "S;customer;true;0,{}\nF;0;>($1, -500)\nP;1;[$0, -($1, -5)]"
    at = _t(spark, d, "customer").columns.index("c_acctbal")
    return build(spark, _arrow(spark, d, "customer"), plan.format(at)).toDF("c_custkey", "moved")


# -- further conditions and payloads -----------------------------------------------------------------


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE ((CAST(l_linenumber AS BIGINT) << 2) & 12) = 4")
def filter_shift_and(spark, d):
    rows = _t(spark, d, "lineitem", "l_orderkey", "l_linenumber")
    return rows.filter(F.shiftleft(c("l_linenumber").cast("long"), 2).bitwiseAND(F.lit(12)) == 4)


@_query("""SELECT o_orderkey FROM orders WHERE (CASE WHEN o_totalprice < 100000 THEN NULL ELSE o_orderpriority END) IS NULL
OR NOT (o_orderpriority IN ('1-URGENT', '2-HIGH') OR CAST(o_totalprice AS BIGINT) > 200000)""")
def filter_null_in_cast(spark, d):
    cheap = F.when(c("o_totalprice") < 100000, F.lit(None)).otherwise(c("o_orderpriority"))
    whole = F.rint("o_totalprice").cast("long")  # as the SQL's cast: halves to the even number
    return _t(spark, d, "orders").filter(cheap.isNull() | ~(c("o_orderpriority").isin("1-URGENT", "2-HIGH") | (whole > 200000))).select("o_orderkey")


@_query("SELECT c_custkey, c_acctbal > 0 AS paid FROM customer WHERE c_acctbal > 0")
def filter_bool_column(spark, d):
    return _t(spark, d, "customer").select("c_custkey", (c("c_acctbal") > 0).alias("paid")).filter("paid")


@_query("SELECT n_nationkey, hex(encode(n_name)) AS bytes FROM nation WHERE encode(n_name) = encode('FRANCE') OR encode(n_name) = encode('NATION_3')")
def filter_eq_binary(spark, d):
    raw = _t(spark, d, "nation", "n_nationkey", "n_name").select("n_nationkey", c("n_name").cast("binary").alias("raw"))
    return raw.filter((c("raw") == F.lit(b"FRANCE")) | (c("raw") == F.lit(b"NATION_3"))).select("n_nationkey", F.hex("raw").alias("bytes"))


@_query("""SELECT c_custkey, hex(encode(c_name)) AS name_bytes, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS ordered
FROM customer JOIN orders ON c_custkey = o_custkey""")
def join_payloads(spark, d):
    left = _t(spark, d, "customer", "c_custkey", "c_name").select("c_custkey", c("c_name").cast("binary").alias("raw"))
    right = _t(spark, d, "orders", "o_custkey", "o_orderdate").select("o_custkey", c("o_orderdate").cast("date").alias("day"))
    return relational.inner_join(left, right, "c_custkey", "o_custkey").select("c_custkey", F.hex("raw").alias("name_bytes"), c("day").cast("string").alias("ordered"))


@_query("SELECT -n_nationkey AS negated, n_nationkey - 30 AS below FROM nation")
def project_negative(spark, d):
    return _t(spark, d, "nation", "n_nationkey").select((-c("n_nationkey")).alias("negated"), (c("n_nationkey") + F.lit(-30)).alias("below"))


@_query("SELECT l_returnflag, CAST(SUM(CAST(l_extendedprice AS DECIMAL(12, 2))) AS VARCHAR) AS total FROM lineitem GROUP BY l_returnflag")
def group_sum_decimal(spark, d):
    rows = _t(spark, d, "lineitem", "l_returnflag", "l_extendedprice").withColumn("price", c("l_extendedprice").cast("decimal(12, 2)"))
    return relational.aggregate(rows, ["l_returnflag"], total=F.sum("price").cast("string"))


@_query("SELECT r_regionkey, r_regionkey + 100 AS moved FROM region")
def add_remove_column(spark, d):
    return columnar.remove_column(columnar.add_column(_t(spark, d, "region"), "moved", c("r_regionkey") + 100), "r_name")


@_query("SELECT 0 AS k, 'a' AS v WHERE FALSE")
def equal_tables(spark, d):
    region = _t(spark, d, "region")
    return columnar.same_rows(region, region.repartition(3)).select(c("r_regionkey").cast("int").alias("k"), c("r_name").alias("v"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
