"""Command line: ``python -m helioquery -d DIR -q FILE [-p PARADIGM] [-s] [-t]``."""

from __future__ import annotations

import argparse
import sys

from .session import PARADIGMS, Engine, new_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("helioquery", description="Run a query over a directory of tables.")
    p.add_argument("-d", "--dbFolder", required=True, help="directory of the tables")
    p.add_argument("-q", "--query", required=True, help="file with the SQL text, or with a textual plan if it ends in .plan")
    p.add_argument("-p", "--paradigm", choices=sorted(PARADIGMS), help="how queries run; the results are the same")
    p.add_argument("-s", "--summarise", action="store_true", help="print the number of rows instead of the rows")
    p.add_argument("-t", "--timing", action="store_true", help="print the phases' milliseconds as JSON on stderr")
    p.add_argument("-e", "--explain", choices=("simple", "extended", "codegen", "cost", "formatted"), help="print the plan and don't run it")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    engine = Engine(new_session(), args.dbFolder, args.paradigm)
    text = open(args.query).read()
    if args.explain:
        print(engine.explain(text, args.explain))
        return 0
    if args.query.endswith(".plan"):
        from .operators.relational import result_count
        from .session import PreparedQuery

        df = engine.plan(text)
        query = PreparedQuery(result_count(df) if args.summarise else df, {}, args.paradigm)
    else:
        query = engine.prepare(text, args.summarise)
    for line in query.lines():
        print(line)
    if args.timing:
        print(query.timing_json(), file=sys.stderr)
    return 0
