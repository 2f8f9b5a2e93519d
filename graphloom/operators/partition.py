"""Intervals of ids with about equal numbers of edges, and what is counted inside them.

Of all edges put in order of their destinations, an interval takes as many whole destinations as fit its budget. Where it ends
depends on where it began, so cuts form a chain. A destination is named by the edges before it. Destinations are
dealt to blocks of edges, at least as long as an interval; a block finds for each of its destinations the end of
the interval that would begin there, and where the chain from it leaves the block. Chains of blocks are followed by
doubling jumps, and each block then lists the intervals from where it is entered. So the number of jobs grows with the logarithm of the
number of blocks, and no task holds more than two blocks' destinations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.running import running_sums
from graphloom.functions.search import last_at_most
from graphloom.model import Graph
from graphloom.scratch import Scratch

BYTES_PER_EDGE = 4
BUDGET = 64 << 20
#: Edges per block, unless an interval has more.
BLOCK = 1 << 22

INTERVALS = "interval int, first_vid long, last_vid long, destinations long, edges long"


def plan(n_edges: int, budget: int = BUDGET) -> tuple[int, int]:
    """(intervals, bytes per interval): a last interval over half full keeps the budget's size, else all are evened out."""
    total = n_edges * BYTES_PER_EDGE
    count = max(1, -(-total // budget))
    tail = total % budget
    return count, budget if tail <= budget // 2 else max(BYTES_PER_EDGE, total // count)


def running_degrees(graph: Graph) -> DataFrame:
    """(id, in_degree, upto, nth): edges into ids up to this one, and destinations up to it."""
    return running_sums(graph.in_degrees(), "id", {"upto": F.col("in_degree"), "nth": F.lit(1)})


def _ends(before: np.ndarray, upto: np.ndarray, room: int) -> np.ndarray:
    """Place of the last destination of the interval that begins at each: its own, or the last that fits."""
    return np.maximum(np.arange(len(before)), np.searchsorted(upto, before + room, "right") - 1)


def _sorted(block: pa.Table) -> tuple[np.ndarray, ...]:
    columns = [block.column(c).to_numpy() for c in ("before", "upto", "id", "nth")]
    order = np.argsort(columns[0])
    return tuple(c[order] for c in columns)


def _exits(room: int, length: int):
    """Of a block's destinations that a chain can enter it at: (before, exit), where the chain goes on behind the block."""

    def run(key: tuple, block: pa.Table) -> pa.Table:
        begin = key[0].as_py() * length
        before, upto, _, _ = _sorted(block)
        own = int(np.searchsorted(before, begin + length))
        ends = _ends(before, upto, room)[:own]
        jump = np.where(ends + 1 < own, ends + 1, np.arange(own))
        while True:
            further = jump[jump]
            if (further == jump).all():
                break
            jump = further
        # within an interval of the block's begin, or right behind a destination that is larger than that
        n = max(min(1, own), int(np.searchsorted(before[:own], begin + room, "right")))
        return pa.table({"before": before[:n], "exit": upto[ends[jump[:n]]]})

    return run


def _intervals_of(room: int, length: int):
    """The intervals of the chain that enters a block: (before, upto, last_id, nth)."""

    def run(key: tuple, block: pa.Table, entered: pa.Table) -> pa.Table:
        found: list[int] = []
        before, upto, ids, nth = _sorted(block)
        if entered.num_rows and len(before):
            own = int(np.searchsorted(before, (key[0].as_py() + 1) * length))
            ends = _ends(before, upto, room)
            at = int(np.searchsorted(before, entered.column("entry")[0].as_py()))
            while at < own:
                found.append(at)
                at = int(ends[at]) + 1
        starts = np.array(found, np.int64)
        last = ends[starts] if found else starts
        return pa.table({"before": before[starts], "upto": upto[last], "last_id": ids[last], "nth": nth[last]})

    return run


def _entered(exits: DataFrame, n_blocks: int, scratch: Scratch) -> DataFrame:
    """(entry): where the chain from 0 enters blocks."""
    jumps = [exits]
    while 1 << len(jumps) <= n_blocks:
        one, other = jumps[-1].withColumnRenamed("exit", "middle"), jumps[-1].withColumnRenamed("before", "middle")
        jumps.append(scratch.save(one.join(other, "middle").select("before", "exit"), f"jumps-{len(jumps)}"))
    marks = exits.sparkSession.range(1).withColumnRenamed("id", "before")
    for k, jump in reversed(list(enumerate(jumps))):
        marks = scratch.save(marks.unionByName(marks.join(jump, "before").select(F.col("exit").alias("before"))), f"marks-{k}")
    return marks.select(F.col("before").alias("entry")).distinct()


def intervals(graph: Graph, budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """Contiguous id ranges that cover all ids: an interval ends before the destination that would pass its budget.

    The first destination of an interval is always taken, and the last planned interval takes all that are left.
    """
    spark = graph.spark
    n_edges = graph.edges.count()
    if not n_edges:
        return spark.createDataFrame([], INTERVALS)
    scratch = Scratch(spark, "intervals")
    count, size = plan(n_edges, budget)
    room = size // BYTES_PER_EDGE
    length = max(room, block)
    n_blocks = -(-n_edges // length)
    sums = scratch.save(running_degrees(graph).withColumn("before", F.col("upto") - F.col("in_degree")), "running")
    own = F.floor(F.col("before") / length)
    # what an interval from the block before can still take is dealt to that one too
    places = F.when((own > 0) & (F.col("upto") <= own * length + room), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = sums.select("before", "upto", "id", "nth", F.explode(places).alias("block"))
    if n_blocks > 1:
        exits = scratch.save(dealt.groupBy("block").applyInArrow(_exits(room, length), "before long, exit long"), "exits")
        entered = _entered(exits, n_blocks, scratch)
    else:
        entered = spark.range(1).withColumnRenamed("id", "entry")
    entered = entered.withColumn("block", F.floor(F.col("entry") / length))
    schema = "before long, upto long, last_id long, nth long"
    found = dealt.groupBy("block").cogroup(entered.groupBy("block")).applyInArrow(_intervals_of(room, length), schema)
    # from here on there is a row per interval
    order = Window.orderBy("before")
    taken = found.select("upto", "last_id", "nth", F.least(F.row_number().over(order), F.lit(count)).alias("k")).groupBy("k").agg(*(F.max(c).alias(c) for c in ("upto", "last_id", "nth")))
    row = Window.orderBy("k")
    earlier = lambda c: F.lag(c, 1, 0).over(row)
    last = F.when(F.lead("k").over(row).isNull(), F.lit(graph.top_id())).otherwise(F.col("last_id"))
    listed = taken.select((F.col("k") - 1).alias("interval"), F.coalesce(F.lag("last_id").over(row) + 1, F.lit(0)).alias("first_vid"), last.alias("last_vid"), (F.col("nth") - earlier("nth")).alias("destinations"), (F.col("upto") - earlier("upto")).alias("edges"))
    return scratch.save(listed.select(*(F.col(c).cast(t) for c, t in (x.split() for x in INTERVALS.split(", ")))), "intervals")


def assign(graph: Graph, parts: DataFrame) -> DataFrame:
    """(interval, src, dst, value): each edge with its destination's interval, found in the sorted first ids, a number per interval."""
    firsts = parts.agg(F.array_sort(F.collect_list("first_vid")).alias("firsts")).scalar()
    return graph.edges.withColumn("firsts", firsts).select(last_at_most(F.col("firsts"), F.col("dst")).alias("interval"), "src", "dst", "value")


def csr_offsets(graph: Graph, parts: DataFrame) -> DataFrame:
    """(interval, src, first_index): where a source's edges begin in its interval's edges sorted by source."""
    counts = assign(graph, parts).groupBy("interval", "src").agg(F.count("*").alias("n"))
    summed = running_sums(counts, "src", {"upto": F.col("n")}, ("interval",))
    return summed.select("interval", "src", (F.col("upto") - F.col("n")).alias("first_index"))


def block_scores(graph: Graph, parts: DataFrame, edges_per_block: int) -> DataFrame:
    """(interval, block, score): in-degrees of a block's distinct destinations over its number of distinct sources."""
    nth = running_sums(assign(graph, parts).select("interval", "src", "dst"), "src", {"nth": F.lit(1)}, ("interval",), ("dst",))
    blocks = nth.withColumn("block", F.floor((F.col("nth") - 1) / edges_per_block).cast("long"))
    sources = blocks.groupBy("interval", "block").agg(F.countDistinct("src").alias("n"))
    weights = blocks.select("interval", "block", "dst").distinct().join(graph.in_degrees(), F.col("dst") == F.col("id")).groupBy("interval", "block").agg(F.sum("in_degree").alias("w"))
    return weights.join(sources, ["interval", "block"]).select("interval", "block", (F.col("w").cast("double") / F.col("n")).alias("score"))
