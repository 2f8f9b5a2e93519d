"""Edge lists as text, and graphs kept as Parquet."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import Graph

MODES = ("FAILFAST", "DROPMALFORMED")
FORMAT_VERSION = 1


def _data_lines(lines: DataFrame) -> DataFrame:
    """(value, tokens) of lines that are neither comments nor blank; tokens stand between tabs, commas and blanks."""
    value = F.regexp_replace("value", "\r$", "")
    cut = F.filter(F.split(value, "[\t, ]+"), lambda t: t != "")
    found = lines.select(value.alias("value"), cut.alias("tokens"))
    return found.where(~F.substring("value", 1, 1).isin("#", "%") & (F.size("tokens") > 0))


def _vertex(token: Column) -> Column:
    return F.when(token.rlike("^[0-9]+$"), token.try_cast("long"))


def parse_lines(lines: DataFrame, weighted: bool, mode: str = "FAILFAST") -> DataFrame:
    """(src, dst, value) of text lines in a column value; also works on a stream."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    found = _data_lines(lines)
    value = F.get("tokens", F.lit(2)).try_cast("double") if weighted else F.lit(0.0)
    found = found.select("value", F.size("tokens").alias("n"), _vertex(F.get("tokens", F.lit(0))).alias("src"), _vertex(F.get("tokens", F.lit(1))).alias("dst"), value.alias("w"))
    good = (F.col("n") == 2 + weighted) & F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("w").isNotNull()
    if mode == "FAILFAST":  # in the filter, as an unused column would be pruned
        good = F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("malformed edge in "), F.input_file_name(), F.lit(": "), "value")).cast("boolean"))
    return found.where(good).select("src", "dst", F.col("w").alias("value"))


def infer_weighted(lines: DataFrame) -> bool:
    """Whether the first data line has three tokens."""
    first = _data_lines(lines).select(F.size("tokens")).first()
    return first is not None and first[0] == 3


def read_edges(spark: SparkSession, path: str, weighted: bool | None = None, mode: str = "FAILFAST") -> DataFrame:
    lines = spark.read.text(path)
    return parse_lines(lines, infer_weighted(lines) if weighted is None else weighted, mode)


def _read_table(spark: SparkSession, path: str, **_: object) -> DataFrame:
    return spark.read.parquet(path)


FORMATS = {"edgelist": read_edges, "parquet": _read_table}


def read_graph(spark: SparkSession, path: str, format: str = "edgelist", dense: bool = True, **options: object) -> Graph:
    if format not in FORMATS:
        raise ValueError(f"format must be one of {sorted(FORMATS)}")
    return Graph(FORMATS[format](spark, path, **options), dense)


def _stamp(spark: SparkSession, source: str | None) -> dict | None:
    if source is None:
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    status = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path)
    return {"path": source, "modified": status.getModificationTime(), "size": status.getLen()}


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def save_graph(graph: Graph, folder: str, source: str | None = None, options: dict | None = None) -> None:
    """edges.parquet, vertices.parquet, degrees.parquet, and last the manifest that makes them a graph.

    An older manifest goes first, so a save that is cut short leaves no graph. options: how source was read.
    """
    spark = graph.spark
    _delete(spark, f"{folder}/_graph.json")
    graph.edges.repartitionByRange("dst").sortWithinPartitions("dst", "src").write.mode("overwrite").parquet(f"{folder}/edges.parquet")
    kept = Graph(spark.read.parquet(f"{folder}/edges.parquet"), graph.dense, graph._values)
    kept.vertices().write.mode("overwrite").parquet(f"{folder}/vertices.parquet")
    kept.in_degrees().write.mode("overwrite").parquet(f"{folder}/degrees.parquet")
    row = kept.info().first()
    manifest = {"version": FORMAT_VERSION, "dense": graph.dense, "source": _stamp(spark, source), "options": options or {}} | row.asDict()
    text = spark.range(1).select(F.lit(json.dumps(manifest)).alias("value"))
    text.coalesce(1).write.mode("overwrite").text(f"{folder}/_graph.json")


def _manifest(spark: SparkSession, folder: str) -> dict | None:
    from pyspark.errors import AnalysisException

    try:  # the folder's name begins with an underscore, so its files are named by a pattern
        row = spark.read.text(f"{folder}/_graph.json/part-*").first()
    except AnalysisException:
        return None
    return json.loads(row["value"]) if row else None


def load_graph(spark: SparkSession, folder: str) -> Graph:
    manifest = _manifest(spark, folder)
    if manifest is None:
        raise FileNotFoundError(f"no graph in {folder}")
    return Graph(spark.read.parquet(f"{folder}/edges.parquet"), manifest["dense"], spark.read.parquet(f"{folder}/vertices.parquet"))


def save_values(values: DataFrame, folder: str) -> None:
    """(id, value) as the values of the graph in folder, whose edges stay; values must not read that folder's own."""
    values.select("id", "value").write.mode("overwrite").parquet(f"{folder}/vertices.parquet")


def is_current(spark: SparkSession, folder: str, source: str, options: dict | None = None) -> bool:
    """Whether folder has a graph of this format made from source as it is now, read with these options."""
    manifest = _manifest(spark, folder)
    return bool(manifest) and manifest["version"] == FORMAT_VERSION and manifest["source"] == _stamp(spark, source) and manifest["options"] == (options or {})


def open_graph(spark: SparkSession, source: str, folder: str, **options: object) -> Graph:
    """The graph kept in folder if it is current, else read from source and kept there."""
    if not is_current(spark, folder, source, options):
        save_graph(read_graph(spark, source, **options), folder, source, options)
    return load_graph(spark, folder)


#: A quadratic generator of numbers below the prime 2**31 - 1, and its numbers.
PRIME, FACTOR, ROUNDS = (1 << 31) - 1, 48271, 3


def drawn_sql(seed: int, k: int) -> str:
    """SQL that Spark and DuckDB both read: the k-th number below 2**31 drawn for a row's id, whatever the partitions."""
    x = f"((id + {(seed * 8 + k) * 7919 + 1}) % {PRIME})"
    for r in range(ROUNDS):
        x = f"(({x} * ({x} + {FACTOR}) + {(k + 1) * 104729 + r * 1299709}) % {PRIME})"
    return x


def random_edges(spark: SparkSession, n: int = 1000, seed: int = 0) -> DataFrame:
    """n edges with ends drawn from 0..n-1 by a hash of the row; where both are equal, dst is drawn once more."""
    drawn = spark.range(n).selectExpr(*(f"({drawn_sql(seed, 2 * k)} * {1 << 31} + {drawn_sql(seed, 2 * k + 1)}) % {n} AS {name}" for k, name in enumerate(("src", "first", "again"))))
    return drawn.select("src", F.when(F.col("src") == F.col("first"), F.col("again")).otherwise(F.col("first")).alias("dst"), F.lit(0.0).alias("value"))


def write_edges(edges: DataFrame, path: str, weighted: bool = False) -> None:
    """Tab-separated text."""
    names = ["src", "dst", "value"] if weighted else ["src", "dst"]
    edges.select(F.concat_ws("\t", *names).alias("value")).write.mode("overwrite").text(path)
