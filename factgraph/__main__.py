"""python -m factgraph PATH stats | search QUERY [--recipe NAME] | export FOLDER NAME [GROUP ...] | communities | clear [GROUP ...] | list | drop

PATH is that of a graph; for list, that of a folder of graphs."""

from __future__ import annotations

import argparse


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="factgraph", description=__doc__)
    parser.add_argument("path")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("stats")
    commands.add_parser("communities")
    commands.add_parser("list")
    commands.add_parser("drop")
    searching = commands.add_parser("search")
    searching.add_argument("query")
    searching.add_argument("--recipe", default="combined_rrf")
    exporting = commands.add_parser("export")
    exporting.add_argument("folder")
    exporting.add_argument("name")
    exporting.add_argument("groups", nargs="*")
    clearing = commands.add_parser("clear")
    clearing.add_argument("groups", nargs="*")
    given = parser.parse_args(arguments)

    from pyspark.sql import SparkSession

    from factgraph.plans.api import TemporalGraph, graphs

    graph = TemporalGraph(SparkSession.builder.appName("factgraph").getOrCreate(), given.path)
    if given.command == "stats":
        graph.statistics().orderBy("type").show(truncate=False)
    elif given.command == "search":
        for scope, rows in graph.search(given.query, recipe=given.recipe).items():
            for row in rows.collect():  # at most the recipe's limit
                print(scope, row["uuid"], round(row["score"], 6), sep="\t")
    elif given.command == "export":
        graph.export(given.folder, given.name, given.groups or None)
    elif given.command == "communities":
        graph.build_communities()
    elif given.command == "list":
        print(*graphs(graph.spark, given.path), sep="\n")
    elif given.command == "drop":
        print("dropped" if graph.drop() else "no such graph")
    else:
        graph.clear(given.groups or None)


if __name__ == "__main__":
    main()
