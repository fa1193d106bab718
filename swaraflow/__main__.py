"""``python -m swaraflow list`` names the base queries, ``python -m swaraflow run NAME FOLDER [OUT]`` runs one of them.

The session is taken from ``spark-submit``'s settings, or is local.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import metric_queries, registry, text_queries  # noqa: F401


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="swaraflow", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="the queries, those with SQL marked")
    run = commands.add_parser("run", help="run a query over a folder of Parquet tables")
    run.add_argument("name", choices=sorted(registry.QUERIES))
    run.add_argument("folder")
    run.add_argument("out", nargs="?", help="where Parquet is written; without it twenty rows are shown")
    asked = parser.parse_args(arguments)
    if asked.command == "list":
        for name in sorted(registry.QUERIES):
            print(name, "(SQL)" if name in registry.SQL else "")
        return
    spark = SparkSession.builder.appName(f"swaraflow {asked.name}").getOrCreate()
    found = registry.QUERIES[asked.name](spark, asked.folder)
    if asked.out:
        found.write.mode("errorifexists").parquet(asked.out)
    else:
        found.show(20, truncate=60)


if __name__ == "__main__":
    main()
