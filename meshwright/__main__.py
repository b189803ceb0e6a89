"""Run operations from a shell: python -m meshwright NAME SF_DIR [--json] [--limit N] | --list | report SF_DIR."""

from __future__ import annotations

import argparse
import sys

from meshwright.functions.envelope import Result, refuse
from meshwright.plans import catalog
from meshwright.plans.report import build_report
from meshwright.runtime import session


def main(argv: list[str] | None = None) -> int:
    """0: an answer; 1: a refusal; 2: an unknown operation."""
    parser = argparse.ArgumentParser(prog="meshwright")
    parser.add_argument("name", nargs="?")
    parser.add_argument("sf_dir", nargs="?")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--list", action="store_true")
    parser.add_argument("--limit", type=int, default=50)
    args = parser.parse_args(argv)
    known = catalog.queries()
    if args.list or not args.name:
        print("\n".join(["report", *known]))
        return 0
    if args.name != "report" and args.name not in known:
        print(f"no operation {args.name}", file=sys.stderr)
        return 2
    if not args.sf_dir:
        print(refuse("no folder of tables given").to_json())
        return 1
    spark = session("meshwright")
    spark.sparkContext.setLogLevel("ERROR")
    if args.name == "report":
        print(build_report(spark, args.sf_dir))
        return 0
    answer = known[args.name](spark, args.sf_dir)
    if args.json:
        print(Result(True, answer).to_json(max(1, args.limit)))
    else:
        answer.show(max(1, args.limit), truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
