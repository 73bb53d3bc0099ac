"""Textual plans as a second front end.

A plan has one operator a line, inputs named by line number, the root last; columns are ordinals:

    S;table;projecting;1,4,5          scan (of the columns listed if projecting is true)
    F;input;condition                 filter
    P;input;[expression, ..]          project
    A;input;0,1;aggregate, ..         aggregate (no group columns: global)
    J;left;right;left key;right key   inner equi-join; the right key counts over both inputs' columns

Expressions: ``$3`` (column), ``f(a, b)`` with AND CASE = <> > >= < <= + - * /, ``COUNT()``, ``$SUM0($1)``, and literals
12, 1.5:DECIMAL(2, 1), 'text' (a quote is doubled), 1994-01-01, 12:INTERVAL MONTH, null:DOUBLE, null:INTEGER.
A count times an interval, added to or taken from a date, moves the date by that many units.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import all_of, case_eq, date_shift, divide, sum0
from ..sources.catalog import read_table, table_schema, tables

_TOKEN = re.compile(
    r"\s*(?:(?P<date>\d{4}-\d\d-\d\d)|(?P<number>-?\d+(?:\.\d+)?)(?P<type>:\s*[A-Z]+(?:\s+[A-Z]+)?(?:\(\s*\d+(?:\s*,\s*\d+)*\s*\))?)?"
    r"|(?P<string>'(?:[^']|'')*')(?::\s*[A-Z]+(?:\(\s*\d+\s*\))?)?|null:(?P<null>[A-Z]+)|\$(?P<column>\d+)"
    r"|(?P<name>\$?[A-Za-z_][A-Za-z_0-9]*|<>|>=|<=|[=<>+\-*/])|(?P<sign>[(),\[\]]))"
)


class PlanError(ValueError):
    """A plan that can't be read."""


@dataclass(frozen=True)
class Node:
    """A call (name, args), a column (ordinal) or a literal (kind, value)."""

    kind: str
    value: object
    args: tuple[Node, ...] = ()


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise PlanError(f"can't read: {text[at:]}")
            self.tokens.append(m)
            at = m.end()
        self.at = 0

    def sign(self) -> str | None:
        return self.tokens[self.at]["sign"] if self.at < len(self.tokens) else None

    def many(self, end: str | None) -> list[Node]:
        out: list[Node] = []
        while self.at < len(self.tokens) and (end is None or self.sign() != end):
            if out:
                if self.sign() != ",":
                    raise PlanError("a comma is missing")
                self.at += 1
            out.append(self.one())
        if end is not None:
            if self.sign() != end:
                raise PlanError(f"{end} is missing")
            self.at += 1
        return out

    def one(self) -> Node:
        if self.at >= len(self.tokens):
            raise PlanError("an expression is missing")
        m = self.tokens[self.at]
        self.at += 1
        if m["column"]:
            return Node("column", int(m["column"]))
        if m["date"]:
            return Node("date", m["date"])
        if m["string"]:
            return Node("string", m["string"][1:-1].replace("''", "'"))
        if m["null"]:
            return Node("null", m["null"])
        if m["number"]:
            kind = (m["type"] or "").lstrip(": ")
            if kind.startswith("INTERVAL"):
                return Node("interval", kind.split()[1])
            return Node("double", float(m["number"])) if kind.startswith(("DECIMAL", "DOUBLE", "FLOAT")) or "." in m["number"] else Node("int", int(m["number"]))
        if m["name"] and self.sign() == "(":
            self.at += 1
            return Node("call", m["name"], tuple(self.many(")")))
        raise PlanError(f"unexpected {m[0].strip()}")


def parse(text: str) -> list[Node]:
    """Expressions separated by commas, in brackets or not."""
    parser = _Parser(text)
    if parser.sign() == "[":
        parser.at += 1
        out = parser.many("]")
    else:
        out = parser.many(None)
    if parser.at != len(parser.tokens):
        raise PlanError(f"more than expressions: {text}")
    return out


_NULLS = {"DOUBLE": "double", "INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DATE": "date"}
_BINARY = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide,
}


def _interval(node: Node) -> tuple[int, str] | None:
    """count * interval, in either order."""
    if node.kind == "interval":
        return 1, str(node.value)
    if node.kind == "call" and node.value == "*" and {a.kind for a in node.args} == {"int", "interval"}:
        count, unit = sorted(node.args, key=lambda a: a.kind == "interval")
        return int(count.value), str(unit.value)
    return None


def to_column(node: Node, df: DataFrame) -> Column:
    """The expression over a DataFrame whose columns are ``_0``, ``_1``, .."""
    if node.kind == "column":
        if int(node.value) >= len(df.columns):
            raise PlanError(f"no column {node.value}")
        return F.col(f"_{node.value}")
    if node.kind == "null":
        if node.value not in _NULLS:
            raise PlanError(f"null of an unknown type: {node.value}")
        return F.lit(None).cast(_NULLS[node.value])
    if node.kind == "date":
        return F.lit(node.value).cast("date")
    if node.kind != "call":
        return F.lit(node.value)
    name, args = node.value, node.args
    if name in ("+", "-") and len(args) == 2 and (moved := _interval(args[1])):
        return date_shift(to_column(args[0], df), moved[0] if name == "+" else -moved[0], moved[1])
    if name == "COUNT" and not args:
        return F.count(F.lit(1))
    if name in ("$SUM0", "SUM") and len(args) == 1:
        return sum0(to_column(args[0], df)) if name == "$SUM0" else F.sum(to_column(args[0], df))
    columns = [to_column(a, df) for a in args]
    if name == "AND" and columns:
        return all_of(columns)
    if name == "CASE" and len(args) == 3:
        test = args[0]
        if test.kind == "call" and test.value == "=":
            return case_eq(*[to_column(a, df) for a in test.args], *columns[1:])
        return F.when(columns[0], columns[1]).otherwise(columns[2])
    if name in _BINARY and len(columns) == 2:
        return _BINARY[name](*columns)
    raise PlanError(f"no function {name} of {len(args)} operands")


def _numbers(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x.strip()]


def _ordinal(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def build(spark: SparkSession, db_dir: str, plan: str) -> DataFrame:
    """The plan's result, with columns ``_0``, ``_1``, .. ; lazy as any DataFrame."""
    paths = tables(spark, db_dir)
    made: list[DataFrame] = []
    for line in filter(None, (x.strip() for x in plan.strip().splitlines())):
        kind, _, rest = line.partition(";")
        parts = rest.split(";", {"S": 2, "F": 1, "P": 1, "A": 2, "J": 3}.get(kind, 0))
        try:
            if kind == "S":
                if parts[0] not in paths:
                    raise PlanError(f"no table {parts[0]}")
                names = table_schema(spark, paths[parts[0]]).names
                wanted = [names[i] for i in _numbers(parts[2])] if parts[1].strip().lower() == "true" else names
                df = read_table(spark, paths[parts[0]], list(dict.fromkeys(wanted))).select(*wanted)
            elif kind == "F":
                source = made[int(parts[0])]
                (condition,) = parse(parts[1])
                df = source.filter(to_column(condition, source))
            elif kind == "P":
                source = made[int(parts[0])]
                df = source.select(*[to_column(e, source).alias(f"p{i}") for i, e in enumerate(parse(parts[1]))])
            elif kind == "A":
                source, keys = made[int(parts[0])], [f"_{i}" for i in _numbers(parts[1])]
                aggregates = [to_column(e, source).alias(f"a{i}") for i, e in enumerate(parse(parts[2] if len(parts) > 2 else ""))]
                df = (source.groupBy(*keys) if keys else source).agg(*aggregates) if aggregates else source.select(*keys).distinct()
            elif kind == "J":
                left, right = made[int(parts[0])], made[int(parts[1])]
                shift = len(left.columns)
                right = right.toDF(*[f"r{i}" for i in range(len(right.columns))])
                df = left.join(right, left[f"_{int(parts[2])}"] == right[f"r{int(parts[3]) - shift}"])
            else:
                raise PlanError(f"no operator {kind}")
        except (IndexError, KeyError) as e:
            raise PlanError(f"can't read the line {line}") from e
        made.append(_ordinal(df))
    if not made:
        raise PlanError("an empty plan")
    return made[-1]
