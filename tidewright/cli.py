"""Command line: ``python -m tidewright.cli list`` and ``python -m tidewright.cli run QUERY --tables DIR --out DIR``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def catalogue() -> dict:
    from .plans import catalog, decisions, evaluation, fitting, intake, models, places, reporting, scoring, terrain  # noqa: F401  all add to it

    return catalog.QUERIES


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidewright", description="Run queries of the catalogue on a folder of tables.")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries, with what they do")
    run = sub.add_parser("run", help="run queries and write their rows")
    run.add_argument("query", nargs="+")
    run.add_argument("--tables", required=True, help="folder with one Parquet table a name")
    run.add_argument("--out", required=True, help="folder for the results, one table a query")
    run.add_argument("--format", choices=["parquet", "csv", "json"], default="parquet")
    run.add_argument("--explain", action="store_true", help="print the plans instead of running them")
    a, known = parser.parse_args(args), catalogue()
    if a.command == "list":
        for name in sorted(known):
            print(name, (known[name].__doc__ or "").strip().split("\n")[0], sep="\t")
        return 0
    if unknown := [q for q in a.query if q not in known]:
        parser.error(f"unknown: {', '.join(unknown)}")
    spark = SparkSession.builder.appName("tidewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for name in a.query:
        df = known[name](spark, a.tables)
        if a.explain:
            df.explain("formatted")
        else:
            df.write.mode("overwrite").format(a.format).save(f"{a.out.rstrip('/')}/{name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
