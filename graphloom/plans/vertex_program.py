"""Iterative vertex programs as supersteps of Column expressions.

A superstep sends a message along every edge from an active vertex, combines messages at the receiver, applies
the result to the receiver's value, and activates vertices for the next superstep. All updates of a
superstep see the values before it. Only active vertices send, which is enough for combinations that
don't depend on repetition (min, max, or); for sums set activate_all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.scratch import Scratch


@dataclass
class Context:
    """What a program's hooks see and may change."""

    iterations: int
    iteration: int = 0
    stopped: bool = False
    changed: int = 0
    active: int = 0
    changes: list[Callable[[Column, Column], Column]] = field(default_factory=list)

    def stop(self) -> None:
        """Make this iteration the last."""
        self.stopped = True

    # Changes of the set of vertices that send in the next superstep, made in the order of the calls.

    def add_task(self, *ids: int) -> None:
        self.changes.append(lambda active, vertex: active | vertex.isin(*ids))

    def remove_task(self, *ids: int) -> None:
        self.changes.append(lambda active, vertex: active & ~vertex.isin(*ids))

    def deactivate_range(self, low: int, high: int) -> None:
        """low and high are in the range."""
        self.changes.append(lambda active, vertex: active & ~vertex.between(low, high))

    def clear(self) -> None:
        self.changes.append(lambda active, vertex: F.lit(False))

    def has_tasks(self) -> bool:
        return bool(self.active or self.changes)

    def _sending(self, active: Column) -> Column:
        for change in self.changes:
            active = change(active, F.col("id"))
        self.changes.clear()
        return active


class VertexProgram:
    """Override what differs; columns: value (own), nbr, nbr_value, edge_value, gathered (null without messages)."""

    direction = "both"  # edges that messages go along: in, out or both, as seen from the receiver
    activate_all = False

    def init(self, vertices: DataFrame) -> DataFrame:
        """(id, value, active) from (id, value)."""
        return vertices.withColumn("active", F.lit(True))

    def message(self) -> Column:
        return F.col("nbr_value")

    def combine(self, messages: Column) -> Column:
        return F.min(messages)

    def apply(self) -> Column:
        return F.least("value", "gathered")

    def activate(self, old: Column, new: Column) -> Column:
        return ~old.eqNullSafe(new)

    def before_iteration(self, ctx: Context) -> None: ...

    def after_iteration(self, ctx: Context) -> None: ...

    def before_interval(self, ctx: Context) -> None: ...

    def after_interval(self, ctx: Context) -> None: ...


def _edges(graph: Graph, direction: str) -> DataFrame:
    if direction == "both":
        return graph.symmetric()
    ends = {"in": ("dst", "src"), "out": ("src", "dst")}[direction]
    return graph.edges.select(F.col(ends[0]).alias("v"), F.col(ends[1]).alias("nbr"), "value")


def run(graph: Graph, program: VertexProgram, iterations: int = 1000, allow_partial: bool = False) -> DataFrame:
    """(id, value) when no vertex is active, the program stops, or (with allow_partial) iterations are used up."""
    scratch, ctx = Scratch(graph.spark, "vertex-program"), Context(iterations)
    edges = scratch.save(_edges(graph, program.direction).withColumnRenamed("value", "edge_value"), "edges")
    state = scratch.save(program.init(graph.vertices()).select("id", "value", "active"), "state-0")
    ctx.active = state.where("active").count()
    while ctx.has_tasks() and not ctx.stopped:
        if ctx.iteration >= iterations:
            if allow_partial:
                break
            raise RuntimeError(f"still active after {iterations} iterations")
        program.before_iteration(ctx)
        program.before_interval(ctx)
        sending = state.where(ctx._sending(F.lit(True) if program.activate_all else F.col("active")))
        sent = sending.select(F.col("id").alias("nbr"), F.col("value").alias("nbr_value"))
        gathered = edges.join(sent, "nbr").select("v", program.message().alias("m")).groupBy("v").agg(program.combine(F.col("m")).alias("gathered"))
        met = state.join(gathered, state.id == gathered.v, "left").select("id", "value", "gathered")
        new = met.withColumn("new", program.apply().cast("double"))
        after = new.select("id", F.col("new").alias("value"), program.activate(F.col("value"), F.col("new")).alias("active"), (~F.col("value").eqNullSafe(F.col("new"))).alias("changed"))
        written, seen = scratch.save_observed(after, f"state-{ctx.iteration + 1}", active=F.count_if("active"), changed=F.count_if("changed"))
        scratch.drop(f"state-{ctx.iteration}")
        ctx.active, ctx.changed = seen["active"], seen["changed"]
        state = written.drop("changed")
        program.after_interval(ctx)
        program.after_iteration(ctx)
        ctx.iteration += 1
    return state.select("id", "value")


class MinLabel(VertexProgram):
    """Connected components by passing on the smallest id."""

    def init(self, vertices: DataFrame) -> DataFrame:
        return vertices.select("id", F.col("id").cast("double").alias("value"), F.lit(True).alias("active"))


class Levels(VertexProgram):
    """Hops from a source; null where it isn't reached."""

    def __init__(self, source: int):
        self.source = source

    def init(self, vertices: DataFrame) -> DataFrame:
        first = F.col("id") == self.source
        return vertices.select("id", F.when(first, 0.0).alias("value"), first.alias("active"))

    def message(self) -> Column:
        return F.col("nbr_value") + 1
