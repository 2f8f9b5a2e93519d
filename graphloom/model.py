"""The graph: directed edges (src, dst, value) and a dense domain of vertex ids 0..max.

Edges form a multigraph: duplicates and self-loops count. Undirected readings of it list an edge once from each
end, so a self-loop stands twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Graph:
    def __init__(self, edges: DataFrame, dense: bool = True, values: DataFrame | None = None):
        """edges: src, dst, and value if weighted; further columns stay on edges but aren't used.

        dense: ids that no edge names, up to the largest, are vertices too. values: (id, value) to start from.
        """
        if "value" not in edges.columns:
            edges = edges.withColumn("value", F.lit(0.0))
        extra = [c for c in edges.columns if c not in ("src", "dst", "value")]
        self.edges = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"), *extra)
        self.dense = dense
        self._values = values
        self._top: int | None = None

    @property
    def spark(self):
        return self.edges.sparkSession

    def with_values(self, values: DataFrame) -> Graph:
        """The same edges with values (id, value) to start a vertex program from."""
        return Graph(self.edges, self.dense, values)

    def top_id(self) -> int:
        """The largest id, -1 without edges."""
        if self._top is None:
            row = self.edges.agg(F.max(F.greatest("src", "dst"))).first()
            self._top = -1 if row[0] is None else row[0]
        return self._top

    def ids(self) -> DataFrame:
        """(id) of the vertices."""
        if self.dense:
            return self.spark.range(self.top_id() + 1)
        return self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()

    def vertices(self) -> DataFrame:
        """(id, value): the given values, else zero."""
        ids = self.ids()
        if self._values is None:
            return ids.withColumn("value", F.lit(0.0))
        given = self._values.select("id", F.col("value").cast("double"))
        return ids.join(given, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))

    def info(self) -> DataFrame:
        """(edges, vertices, distinct_sources); all zero for an empty graph."""
        return self.edges.agg(
            F.count("*").alias("edges"),
            (F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1).cast("long")) + 1).alias("vertices"),
            F.countDistinct("src").alias("distinct_sources"),
        )

    def symmetric(self) -> DataFrame:
        """(v, nbr, value): every edge as seen from each of its ends."""
        ends = F.array(F.struct(F.col("dst").alias("v"), F.col("src").alias("nbr")), F.struct(F.col("src").alias("v"), F.col("dst").alias("nbr")))
        return self.edges.select(F.explode(ends).alias("e"), "value").select("e.v", "e.nbr", "value")

    def _degrees(self, counted: DataFrame, name: str, zeros: bool) -> DataFrame:
        if not zeros:
            return counted
        return self.ids().join(counted, "id", "left").select("id", F.coalesce(name, F.lit(0).cast("long")).alias(name))

    def in_degrees(self, zeros: bool = False) -> DataFrame:
        return self._degrees(self.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree")), "in_degree", zeros)

    def out_degrees(self, zeros: bool = False) -> DataFrame:
        return self._degrees(self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree")), "out_degree", zeros)

    def total_degrees(self, zeros: bool = False) -> DataFrame:
        return self._degrees(self.symmetric().groupBy(F.col("v").alias("id")).agg(F.count("*").alias("degree")), "degree", zeros)

    def isolated(self) -> DataFrame:
        """(id) of vertices without any edge."""
        return self.ids().join(self.symmetric().select(F.col("v").alias("id")), "id", "left_anti")

    def triplets(self) -> DataFrame:
        """(src, dst, edge_value, src_value, dst_value)."""
        v = self.vertices()
        one = v.select(F.col("id").alias("src"), F.col("value").alias("src_value"))
        other = v.select(F.col("id").alias("dst"), F.col("value").alias("dst_value"))
        return self.edges.select("src", "dst", F.col("value").alias("edge_value")).join(one, "src").join(other, "dst").select("src", "dst", "edge_value", "src_value", "dst_value")

    def in_edges(self, vertex: int) -> DataFrame:
        return self.edges.where(F.col("dst") == vertex)

    def out_edges(self, vertex: int) -> DataFrame:
        return self.edges.where(F.col("src") == vertex)

    def incident(self, low: int, high: int) -> DataFrame:
        """(v, nbr, value) for vertices of an id range; the range reaches the scan of each end."""
        into = self.edges.where(F.col("dst").between(low, high)).select(F.col("dst").alias("v"), F.col("src").alias("nbr"), "value")
        out = self.edges.where(F.col("src").between(low, high)).select(F.col("src").alias("v"), F.col("dst").alias("nbr"), "value")
        return into.unionByName(out)

    def gather(self, state: DataFrame, combine, active: DataFrame | None = None, message: Column | None = None) -> DataFrame:
        """(id, gathered): combine(message) over each vertex's neighbours; state is (id, value), active (id)."""
        sent = state if active is None else state.join(active, "id", "left_semi")
        sent = sent.select(F.col("id").alias("nbr"), F.col("value").alias("nbr_value"))
        met = self.symmetric().withColumnRenamed("value", "edge_value").join(sent, "nbr")
        return met.groupBy(F.col("v").alias("id")).agg(combine(F.col("nbr_value") if message is None else message).alias("gathered"))
