"""python -m quern.cli FOLDER (inspect | graph | stat [TABLE]): a look at the Parquet tables of a folder."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from quern.session import Engine
from quern.sources.schema import Browser, Graph, Introspector, human_count, human_size


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("command", choices=["inspect", "graph", "stat"])
    parser.add_argument("table", nargs="?")
    asked = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    names = sorted(n.removesuffix(".parquet") for n in os.listdir(asked.folder) if n.endswith(".parquet"))
    engine = Engine.over(spark, asked.folder, names)
    known = Introspector(engine.store)
    if asked.command == "graph":
        graph = Graph()
        Browser(known, graph).browse_schema()
        print(graph.text())
    elif asked.command == "inspect":
        for name in [asked.table] if asked.table else known.tables():
            table = known.table(name)
            print(name)
            for c in table.columns.values():
                print(f"  {c.name} {c.sql_type}{'' if c.nullable else ' not null'}")
    elif asked.table:
        for r in known.column_statistics(asked.table).collect():
            print(f"{r['column_name']:24} {human_size(r['total_bytes']):>12} {r['percent'] or 0:6.2f} % {human_count(r['nulls']):>8} nulls")
    else:
        for r in known.table_statistics().collect():
            print(f"{r['table_name']:24} {human_count(r['row_count']):>10} rows {human_size(r['size_bytes']):>12}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
