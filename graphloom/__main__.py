"""python -m graphloom components|distance|info|generate PATH ..."""

from __future__ import annotations

import argparse

from pyspark.storagelevel import StorageLevel

from graphloom.operators.distance import shortest_distances
from graphloom.operators.metrics import component_sizes
from graphloom.session import local_session
from graphloom.sources.edgelist import random_edges, read_graph, write_edges
from graphloom.timing import Timers


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="graphloom", description="Questions to an edge list.")
    parser.add_argument("task", choices=("components", "distance", "info", "generate"))
    parser.add_argument("path")
    parser.add_argument("--src", type=int, default=1)
    parser.add_argument("--dst", type=int, default=364)
    parser.add_argument("--top", type=int, default=10)
    parser.add_argument("-n", type=int, default=1000, help="edges and ids to generate")
    parser.add_argument("--seed", type=int, default=0)
    parser.add_argument("--mode", default="FAILFAST")
    parser.add_argument("--cache", action="store_true", help="keep the edges in memory and on disk")
    given = parser.parse_args(args)
    timers, spark = Timers(), local_session()
    if given.task == "generate":
        write_edges(random_edges(spark, given.n, given.seed), given.path)
        return
    with timers.phase("read"):
        graph = read_graph(spark, given.path, mode=given.mode)
        if given.cache:
            graph.edges = graph.edges.persist(StorageLevel.MEMORY_AND_DISK)
    with timers.phase(given.task):
        if given.task == "info":
            graph.info().show()
        elif given.task == "distance":
            found = shortest_distances(graph, [(given.src, given.dst)]).first()["distance"]
            print("no path" if found is None else f"distance {found}")
        else:
            sizes = component_sizes(graph).persist()
            print(f"{sizes.count()} components of two or more vertices")
            sizes.orderBy("size", "label", ascending=[False, True]).show(given.top)
    print(timers.report())


if __name__ == "__main__":
    main()
