"""Run a named query: ``python -m docstrata list`` or ``python -m docstrata run NAME --tables DIR [--out DIR]``."""

from __future__ import annotations

import argparse

from docstrata.plans import registry


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docstrata", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="run one query")
    run.add_argument("name", choices=sorted(registry.queries()), metavar="NAME")
    run.add_argument("--tables", required=True, help="folder of the tables")
    run.add_argument("--out", help="folder for the result as Parquet; without it the first rows are shown")
    run.add_argument("--rows", type=int, default=20, help="rows to show")
    given = parser.parse_args(arguments)
    if given.command == "list":
        print("\n".join(sorted(registry.queries())))
        return 0

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"docstrata {given.name}").getOrCreate()
    result = registry.queries()[given.name](spark, given.tables)
    if given.out:
        result.write.mode("error").parquet(given.out)
    else:
        result.show(given.rows, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
