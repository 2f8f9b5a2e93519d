"""Edge lists that arrive as a stream of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.edgelist import parse_lines


def stream_edges(spark: SparkSession, folder: str, weighted: bool = False, mode: str = "DROPMALFORMED") -> DataFrame:
    """A streaming (src, dst, value): the schema can't be inferred from lines that aren't there yet."""
    return parse_lines(spark.readStream.text(folder), weighted, mode)


def stream_degrees(edges: DataFrame) -> DataFrame:
    """A streaming (id, in_degree, out_degree) in complete mode; state is one row per vertex."""
    ends = F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return edges.select(F.explode(ends).alias("e")).groupBy(F.col("e.id").alias("id")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
