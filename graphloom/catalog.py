"""Queries over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import metrics, partition
from graphloom.operators.distance import bfs_levels, shortest_distances
from graphloom.plans.vertex_program import Context, Levels, MinLabel, run
from graphloom.scratch import Scratch
from graphloom.sources.edgelist import drawn_sql, load_graph, open_graph, random_edges, read_edges, save_graph, save_values, write_edges
from graphloom.sources.tables import edges_of, edges_sql, graph_of

Query = Callable[[SparkSession, str], DataFrame]

#: A byte budget that cuts the test graphs into several intervals.
SMALL_BUDGET = 4_000
BLOCK_EDGES = 256
RANGE = (100, 400)
IN_EDGES_OF, OUT_EDGES_OF = 3, 4
RANDOM = (1000, 7)
BFS_SOURCE = {"dense": 0, "small": 1}
#: Near, self, far and unreachable pairs, one with an end that is no vertex.
PAIRS = {"dense": ((0, 1), (0, 2), (5, 5), (1, 100), (3, -1)), "small": ((1, 1), (0, 1), (2, 9), (31, 62))}


def _active_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices that take a smaller label in the second superstep of passing on smallest ids."""
    g = graph_of(spark, sf_dir, "raw", dense=False)
    zero = g.ids().withColumn("value", F.col("id"))
    step = lambda state, active: g.gather(state, F.min, active).join(state, "id").select("id", "value", F.least("value", "gathered").alias("new"))
    one = step(zero, None)
    pushed = one.where("new < value").select("id")
    two = step(one.select("id", F.col("new").alias("value")), pushed)
    return two.where("new < value").select("id", F.col("new").alias("label"))


def _labels(name: str, dense: bool = False) -> Query:
    return lambda spark, d: metrics.connected_components(graph_of(spark, d, name, dense))


def _parts(spark: SparkSession, d: str):
    g = graph_of(spark, d, "deep")
    return g, partition.intervals(g, SMALL_BUDGET)


def _text(spark: SparkSession, d: str, name: str, weighted: bool) -> str:
    """A graph's edges as text; returns the folder."""
    path = f"{Scratch(spark, 'text').path}/edges.txt"
    write_edges(edges_of(spark, d, name), path, weighted)
    return path


def _mixed_text(spark: SparkSession, d: str) -> str:
    """Edges with other delimiters by source, a comment and a blank line beside each, and a malformed line beside every third."""
    path = f"{Scratch(spark, 'text').path}/edges.txt"
    spell = """array(concat(src, CASE src % 4 WHEN 0 THEN ', ' WHEN 1 THEN '   ' ELSE '\t' END, dst, CASE WHEN src % 7 = 0 THEN ' \r' ELSE '' END), concat('# ', src), '% x y', '',
      CASE WHEN dst % 3 = 0 THEN element_at(array('9', concat(src, ' 2 3 4'), 'a b', concat('-', src, ' 2'), '1 2 x'), CAST(1 + src % 5 AS INT)) ELSE '#' END)"""
    edges_of(spark, d, "deep").selectExpr(f"explode({spell}) AS value").write.text(path)
    return path


def _reopened(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a text that is read and kept once, and opened from what was kept the second time."""
    source, folder = _text(spark, d, "raw", False), f"{Scratch(spark, 'kept').path}/graph"
    for _ in range(2):
        graph = open_graph(spark, source, folder, weighted=False)
    return graph.edges


def _saved_values(spark: SparkSession, d: str) -> DataFrame:
    """A program's values, saved to the graph's folder and loaded from it."""
    folder = f"{Scratch(spark, 'kept').path}/graph"
    save_graph(graph_of(spark, d, "small", dense=False), folder)
    save_values(run(load_graph(spark, folder), MinLabel()), folder)
    return load_graph(spark, folder).vertices()


class _Silenced(MinLabel):
    """One superstep of the smallest id, in which a range and one id don't send, but one of the range does."""

    def before_iteration(self, ctx: Context) -> None:
        ctx.deactivate_range(*RANGE)
        ctx.remove_task(1, 2)
        ctx.add_task(RANGE[1])

    def after_iteration(self, ctx: Context) -> None:
        ctx.stop()


QUERIES: dict[str, Query] = {
    "edges_text_unweighted": lambda s, d: read_edges(s, _text(s, d, "deep", False)),
    "edges_text_weighted": lambda s, d: read_edges(s, _text(s, d, "seq", True)),
    "edges_text_dropmalformed": lambda s, d: read_edges(s, _mixed_text(s, d), False, "DROPMALFORMED"),
    "graph_reopened": _reopened,
    "values_saved": _saved_values,
    "in_edges": lambda s, d: graph_of(s, d, "dense").in_edges(IN_EDGES_OF),
    "out_edges": lambda s, d: graph_of(s, d, "dense").out_edges(OUT_EDGES_OF),
    "active_count": lambda s, d: _active_frontier(s, d).agg(F.count("*").alias("active")),
    "program_silenced": lambda s, d: run(graph_of(s, d, "raw", dense=False), _Silenced()),
    "edges_unweighted": lambda s, d: edges_of(s, d, "deep"),
    "edges_weighted": lambda s, d: edges_of(s, d, "seq"),
    "graph_info": lambda s, d: graph_of(s, d, "seq").info(),
    "vertices_dense": lambda s, d: graph_of(s, d, "raw").vertices(),
    "isolated_vertices": lambda s, d: graph_of(s, d, "raw").isolated(),
    "in_degrees": lambda s, d: graph_of(s, d, "dense").in_degrees(),
    "out_degrees": lambda s, d: graph_of(s, d, "dense").out_degrees(),
    "total_degrees": lambda s, d: graph_of(s, d, "seq").total_degrees(zeros=True),
    "symmetric_edges": lambda s, d: graph_of(s, d, "seq").symmetric(),
    "triplets": lambda s, d: graph_of(s, d, "seq").with_values(graph_of(s, d, "seq").in_degrees().withColumnRenamed("in_degree", "value")).triplets(),
    "incident_range": lambda s, d: graph_of(s, d, "raw").incident(*RANGE),
    "min_neighbor": lambda s, d: (lambda g: g.gather(g.ids().withColumn("value", F.col("id")), F.min).select("id", F.least("id", "gathered").alias("label")))(graph_of(s, d, "raw", dense=False)),
    "active_frontier": _active_frontier,
    "cc_labels": _labels("deep"),
    "cc_labels_star": _labels("star"),
    "cc_labels_raw": _labels("raw", dense=True),
    "cc_sizes": lambda s, d: metrics.component_sizes(graph_of(s, d, "deep")),
    "cc_count": lambda s, d: metrics.component_count(graph_of(s, d, "deep")),
    "cc_top10": lambda s, d: metrics.top_components(graph_of(s, d, "deep")),
    "bfs_levels_dense": lambda s, d: bfs_levels(graph_of(s, d, "dense"), BFS_SOURCE["dense"]),
    "bfs_levels_small": lambda s, d: bfs_levels(graph_of(s, d, "small"), BFS_SOURCE["small"]),
    "shortest_distance_dense": lambda s, d: shortest_distances(graph_of(s, d, "dense"), PAIRS["dense"]),
    "shortest_distance_small": lambda s, d: shortest_distances(graph_of(s, d, "small"), PAIRS["small"]),
    "program_min_label": lambda s, d: run(graph_of(s, d, "small", dense=False), MinLabel()),
    "program_levels": lambda s, d: run(graph_of(s, d, "dense", dense=False), Levels(BFS_SOURCE["dense"])),
    "intervals": lambda s, d: _parts(s, d)[1],
    "csr_offsets": lambda s, d: partition.csr_offsets(*_parts(s, d)),
    "block_scores": lambda s, d: partition.block_scores(*_parts(s, d), BLOCK_EDGES),
    "random_graph": lambda s, d: random_edges(s, *RANDOM),
}


def _cc(name: str) -> str:
    return f"""WITH RECURSIVE e AS MATERIALIZED ({edges_sql(name)}),
 u AS MATERIALIZED (SELECT src a, dst b FROM e UNION SELECT dst, src FROM e),
 cc(id, label) USING KEY (id) AS (
   SELECT a, a FROM (SELECT DISTINCT a FROM u)
   UNION
   SELECT u.b, min(cc.label) FROM cc JOIN u ON u.a = cc.id JOIN recurring.cc r ON r.id = u.b WHERE cc.label < r.label GROUP BY u.b)
"""


def _bfs(name: str, source: str) -> str:
    return f"""WITH RECURSIVE e AS MATERIALIZED ({edges_sql(name)}),
 u AS MATERIALIZED (SELECT src a, dst b FROM e UNION SELECT dst, src FROM e),
 d(id, dist) USING KEY (id) AS (
   SELECT CAST({source} AS BIGINT), CAST(0 AS BIGINT)
   UNION
   SELECT u.b, CAST(min(d.dist) + 1 AS BIGINT) FROM d JOIN u ON u.a = d.id LEFT JOIN recurring.d r ON r.id = u.b WHERE r.id IS NULL GROUP BY u.b)
"""


def _distance(name: str) -> str:
    parts = [
        f"SELECT CAST({a} AS BIGINT) AS src, CAST({b} AS BIGINT) AS dst, (SELECT max(dist) FROM ({_bfs(name, str(a))} SELECT * FROM d) WHERE id = {b} AND {b} >= 0) AS distance"
        for a, b in PAIRS[name]
    ]
    return " UNION ALL ".join(parts)


_E = lambda name: f"WITH e AS ({edges_sql(name)})"
_SIZES = "SELECT label, count(*) AS size FROM cc GROUP BY label HAVING count(*) > 1"
#: Intervals: one step of recursion per destination in order of id.
_INTERVALS = f"""WITH RECURSIVE e AS MATERIALIZED ({edges_sql("deep")}),
 g AS (SELECT dst AS id, count(*) AS n, row_number() OVER (ORDER BY dst) AS k FROM e GROUP BY dst),
 t AS (SELECT count(*) * 4 AS bytes, (count(*) * 4 + {SMALL_BUDGET - 1}) // {SMALL_BUDGET} AS parts, (count(*) * 4) % {SMALL_BUDGET} AS tail, greatest(max(src), max(dst)) AS top FROM e),
 b AS (SELECT CASE WHEN tail <= {SMALL_BUDGET // 2} THEN {SMALL_BUDGET} ELSE bytes // parts END AS size, parts, top FROM t),
 walk(k, part, taken) AS (
   SELECT 1::BIGINT, 0::BIGINT, (SELECT n FROM g WHERE k = 1)::BIGINT
   UNION ALL
   SELECT w.k + 1, w.part + CASE WHEN w.part < b.parts - 1 AND (w.taken + g.n) > b.size // 4 THEN 1 ELSE 0 END,
     CASE WHEN w.part < b.parts - 1 AND (w.taken + g.n) > b.size // 4 THEN g.n ELSE w.taken + g.n END
   FROM walk w JOIN g ON g.k = w.k + 1 CROSS JOIN b),
 r AS (SELECT part, min(g.id) AS lo, max(g.id) AS hi, count(*) AS destinations, sum(n) AS edges FROM walk JOIN g USING (k) GROUP BY part),
 i AS (SELECT CAST(part AS INTEGER) AS interval, CAST(coalesce(lag(hi) OVER (ORDER BY part) + 1, 0) AS BIGINT) AS first_vid,
   CAST(CASE WHEN lead(hi) OVER (ORDER BY part) IS NULL THEN (SELECT top FROM b) ELSE hi END AS BIGINT) AS last_vid, CAST(destinations AS BIGINT) AS destinations, CAST(edges AS BIGINT) AS edges FROM r)
"""

_FRONTIER = f"""{_E('raw')}, u AS (SELECT dst AS v, src AS nbr FROM e UNION SELECT src, dst FROM e),
 one AS (SELECT v, least(v, min(nbr)) AS label FROM u GROUP BY v),
 two AS (SELECT u.v, min(o.label) AS m FROM u JOIN one o ON o.v = u.nbr WHERE o.label < o.v GROUP BY u.v)
 SELECT {{}} FROM one JOIN two ON two.v = one.v WHERE m < label"""

ORACLE_SQL: dict[str, str] = {
    "edges_text_unweighted": edges_sql("deep"),
    "edges_text_weighted": edges_sql("seq"),
    "edges_text_dropmalformed": edges_sql("deep"),
    "graph_reopened": edges_sql("raw"),
    "values_saved": _cc("small") + "SELECT id, CAST(label AS DOUBLE) AS value FROM cc",
    "in_edges": f"{_E('dense')} SELECT * FROM e WHERE dst = {IN_EDGES_OF}",
    "out_edges": f"{_E('dense')} SELECT * FROM e WHERE src = {OUT_EDGES_OF}",
    "active_count": _FRONTIER.format("count(*) AS active"),
    "program_silenced": f"""{_E('raw')}, u AS (SELECT dst AS v, src AS nbr FROM e UNION SELECT src, dst FROM e)
 SELECT v AS id, CAST(least(v, min(nbr) FILTER (nbr = {RANGE[1]} OR nbr NOT BETWEEN {RANGE[0]} AND {RANGE[1]} AND nbr NOT IN (1, 2))) AS DOUBLE) AS value FROM u GROUP BY v""",
    "random_graph": f"""WITH d AS (SELECT {", ".join(f"({drawn_sql(RANDOM[1], 2 * k)} * {1 << 31} + {drawn_sql(RANDOM[1], 2 * k + 1)}) % {RANDOM[0]} AS {name}" for k, name in enumerate(("src", "f", "again")))} FROM range({RANDOM[0]}) r(id))
 SELECT src, CASE WHEN src = f THEN again ELSE f END AS dst, CAST(0 AS DOUBLE) AS value FROM d""",
    "edges_unweighted": edges_sql("deep"),
    "edges_weighted": edges_sql("seq"),
    "graph_info": f"{_E('seq')} SELECT count(*) AS edges, greatest(max(src), max(dst)) + 1 AS vertices, count(DISTINCT src) AS distinct_sources FROM e",
    "vertices_dense": f"{_E('raw')} SELECT unnest(range(0, (SELECT greatest(max(src), max(dst)) + 1 FROM e))) AS id, CAST(0 AS DOUBLE) AS value",
    "isolated_vertices": f"{_E('raw')} SELECT id FROM (SELECT unnest(range(0, (SELECT greatest(max(src), max(dst)) + 1 FROM e))) AS id) WHERE id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)",
    "in_degrees": f"{_E('dense')} SELECT dst AS id, count(*) AS in_degree FROM e GROUP BY dst",
    "out_degrees": f"{_E('dense')} SELECT src AS id, count(*) AS out_degree FROM e GROUP BY src",
    "total_degrees": f"{_E('seq')}, u AS (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) SELECT r.id, count(u.id) AS degree FROM (SELECT unnest(range(0, (SELECT max(id) + 1 FROM u))) AS id) r LEFT JOIN u ON u.id = r.id GROUP BY r.id",
    "symmetric_edges": f"{_E('seq')} SELECT dst AS v, src AS nbr, value FROM e UNION ALL SELECT src, dst, value FROM e",
    "triplets": f"{_E('seq')}, g AS (SELECT dst AS id, CAST(count(*) AS DOUBLE) AS n FROM e GROUP BY dst) SELECT src, dst, value AS edge_value, coalesce(a.n, 0) AS src_value, coalesce(b.n, 0) AS dst_value FROM e LEFT JOIN g a ON a.id = src LEFT JOIN g b ON b.id = dst",
    "incident_range": f"{_E('raw')}, u AS (SELECT dst AS v, src AS nbr, value FROM e UNION ALL SELECT src, dst, value FROM e) SELECT * FROM u WHERE v BETWEEN {RANGE[0]} AND {RANGE[1]}",
    "min_neighbor": f"{_E('raw')}, u AS (SELECT dst AS v, src AS nbr FROM e UNION ALL SELECT src, dst FROM e) SELECT v AS id, least(v, min(nbr)) AS label FROM u GROUP BY v",
    "active_frontier": _FRONTIER.format("one.v AS id, m AS label"),
    "cc_labels": _cc("deep") + "SELECT id, label FROM cc",
    "cc_labels_star": _cc("star") + "SELECT id, label FROM cc",
    "cc_labels_raw": _cc("raw") + "SELECT r.id, coalesce(label, r.id) AS label FROM (SELECT unnest(range(0, (SELECT max(a) + 1 FROM u))) AS id) r LEFT JOIN cc ON cc.id = r.id",
    "cc_sizes": _cc("deep") + _SIZES,
    "cc_count": _cc("deep") + f"SELECT count(*) AS components FROM ({_SIZES})",
    "cc_top10": _cc("deep") + f"{_SIZES} ORDER BY size DESC, label LIMIT 10",
    "bfs_levels_dense": _bfs("dense", str(BFS_SOURCE["dense"])) + "SELECT id, dist FROM d",
    "bfs_levels_small": _bfs("small", str(BFS_SOURCE["small"])) + "SELECT id, dist FROM d",
    "shortest_distance_dense": _distance("dense"),
    "shortest_distance_small": _distance("small"),
    "program_min_label": _cc("small") + "SELECT id, CAST(label AS DOUBLE) AS value FROM cc",
    "program_levels": _bfs("dense", str(BFS_SOURCE["dense"])) + "SELECT a.id, CAST(dist AS DOUBLE) AS value FROM (SELECT DISTINCT a AS id FROM u) a LEFT JOIN d ON d.id = a.id",
    "intervals": _INTERVALS + "SELECT * FROM i",
    "csr_offsets": _INTERVALS + ", c AS (SELECT interval, src, count(*) AS n FROM e JOIN i ON dst BETWEEN first_vid AND last_vid GROUP BY 1, 2) SELECT interval, src, CAST(coalesce(sum(n) OVER (PARTITION BY interval ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_index FROM c",
    "block_scores": _INTERVALS + f", x AS (SELECT interval, src, dst, CAST((row_number() OVER (PARTITION BY interval ORDER BY src, dst) - 1) // {BLOCK_EDGES} AS INTEGER) AS block FROM e JOIN i ON dst BETWEEN first_vid AND last_vid), s AS (SELECT interval, block, count(DISTINCT src) AS n FROM x GROUP BY 1, 2), w AS (SELECT interval, block, sum(g.n) AS w FROM (SELECT DISTINCT interval, block, dst FROM x) y JOIN g ON g.id = y.dst GROUP BY 1, 2) SELECT interval, block, CAST(w AS DOUBLE) / n AS score FROM w JOIN s USING (interval, block)",
}
