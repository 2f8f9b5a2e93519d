"""What is asked of component labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators.components import component_labels


def connected_components(graph: Graph) -> DataFrame:
    """(id, label) of every vertex: the smallest id it is connected to, over edges of either direction."""
    found = component_labels(graph.edges)
    return graph.ids().join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def component_sizes(graph: Graph, min_size: int = 2) -> DataFrame:
    """(label, size) of components; those of at least two never need the ids without edges."""
    labels = component_labels(graph.edges) if min_size > 1 else connected_components(graph)
    return labels.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)


def component_count(graph: Graph, min_size: int = 2) -> DataFrame:
    return component_sizes(graph, min_size).agg(F.count("*").alias("components"))


def top_components(graph: Graph, k: int = 10, min_size: int = 2) -> DataFrame:
    return component_sizes(graph, min_size).orderBy(F.desc("size"), F.asc("label")).limit(k)
