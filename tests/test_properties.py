"""Random expressions through the textual front end agree with plain Python."""

import operator

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helioquery.plans.text import Node, parse, to_column

OPS = {"+": operator.add, "-": operator.sub, "*": operator.mul}
TESTS = {"=": operator.eq, "<>": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
ROW = (7, -3, 12)

leaf = st.one_of(st.integers(0, 50).map(lambda v: (str(v), v)), st.integers(0, 2).map(lambda i: (f"${i}", ROW[i])))
number = st.recursive(leaf, lambda inner: st.tuples(st.sampled_from(sorted(OPS)), inner, inner).map(lambda x: (f"{x[0]}({x[1][0]}, {x[2][0]})", OPS[x[0]](x[1][1], x[2][1]))), max_leaves=6)
test = st.tuples(st.sampled_from(sorted(TESTS)), number, number).map(lambda x: (f"{x[0]}({x[1][0]}, {x[2][0]})", TESTS[x[0]](x[1][1], x[2][1])))
condition = st.lists(test, min_size=1, max_size=4).map(lambda xs: (f"AND({', '.join(t for t, _ in xs)})", all(v for _, v in xs)))
chosen = st.tuples(test, number, number).map(lambda x: (f"CASE({x[0][0]}, {x[1][0]}, {x[2][0]})", x[1][1] if x[0][1] else x[2][1]))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(number, condition, chosen), min_size=1, max_size=5))
def test_expressions(spark, found):
    df = spark.createDataFrame([ROW], "_0 long, _1 long, _2 long")
    nodes = parse("[" + ",".join(t for t, _ in found) + "]")
    got = df.select(*[to_column(n, df).alias(f"x{i}") for i, n in enumerate(nodes)]).first()
    assert list(got) == [v for _, v in found]


@given(st.text(min_size=0, max_size=30))
def test_any_string_survives_quoting(text):
    quoted = "'" + text.replace("'", "''") + "'"
    assert parse(f"=($0, {quoted})") == [Node("call", "=", (Node("column", 0), Node("string", text)))]
