"""Exact top-k by inner product: ball-tree branch and bound per shard, with the kth score shared.

Vectors are dealt to shards of about SHARD rows by a hash. Each shard's ball tree is built once and kept as one row. A query
visits nodes in falling order of the largest inner product that a point in the ball can have, and stops where that can't
reach its kth score. It searches its own shard first and then the others in rounds, each GROWTH times as many shards as all
before; between rounds its kth score over all shards so far is the floor that it takes on. In a round the queries of a shard stream
past its tree, so a task holds one shard and one batch of queries, rows aren't copied, and only k rows per query and shard
leave it.

Components are floor(256 * x), scores exact integers: in 64 bits where no sum of products can pass them, else in
Python's integers. Balls are bounded in double precision, scaled by powers of two, with slack for rounding, so that no point is lost, and
ties go to the smaller vec_id.

Defined results: vectors that are null or hold null or non-finite components take no part; a score among a query's k best
that no long holds raises OverflowError; shorter vectors count as padded with zeros; a null vec_id is a candidate, behind all others of equal
score, and no query; rows with equal vec_id are separate vectors, and each query row has its own ranks; with fewer than
k candidates all are returned; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import table
from graphloom.llm.vectors import groups, matrix, numbered
from graphloom.scratch import Scratch

K = 5
QUERY_EVERY = 50
SHARD = 8192
LEAF = 128
GROWTH = 8
FACTOR = 256
#: Queries that are turned into numbers at a time.
BATCH = 512
#: Below this, 64 bits hold a sum of products, bounded in double precision.
SAFE = 2.0**62
#: The place of a null vec_id among those of equal score, which go by falling -vec_id: behind all numbers.
NO_ID = -(1 << 63) - 1
FOUND = "query_row long, query_id long, vec_id long, score long"
DEALT = "shard long, kind int, row long, vec_id long, v array<double>, floor long, tree binary"


class Values:
    """Rows of floor(FACTOR * x) of one width: as doubles, which hold them exactly up to overflow, and as whole numbers."""

    def __init__(self, x: np.ndarray, factor: int = FACTOR):
        self.x = x
        self.factor = factor
        with np.errstate(over="ignore"):
            self.whole = np.floor(x * float(factor))
        self.top = np.abs(self.whole).max(1, initial=0.0)
        fits = self.top < SAFE
        self.longs = np.where(fits[:, None], self.whole, 0.0).astype(np.int64)

    def exact(self, row: int) -> list[int]:
        """The row as Python's integers; a double of this size is a whole number."""
        return [int(w) if np.isfinite(w) else int(x) * self.factor for w, x in zip(self.whole[row].tolist(), self.x[row].tolist())]

    def scaled(self) -> tuple[np.ndarray, int]:
        """(p, e) with p * 2**e the values, and no |p| above 1."""
        big = np.abs(self.x).max(initial=0.0)
        e = int(np.frexp(big)[1]) + self.factor.bit_length() if big else 0
        with np.errstate(over="ignore"):
            return np.where(np.isfinite(self.whole), np.ldexp(self.whole, -e), np.ldexp(self.x, -e) * self.factor), e


class BallTree:
    """Nodes as arrays; a leaf holds the rows order[begin:end]."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.ranges: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        centres: list[np.ndarray] = []
        radii: list[float] = []

        def node(begin: int, end: int) -> int:
            own = points[self.order[begin:end]]
            centre = own.mean(0) if end > begin else np.zeros(points.shape[1])
            centres.append(centre)
            radii.append(float(np.sqrt(((own - centre) ** 2).sum(1).max(initial=0.0))))
            self.ranges.append((begin, end))
            self.children.append(None)
            return len(radii) - 1

        waiting = [node(0, len(points))]
        while waiting:
            k = waiting.pop()
            begin, end = self.ranges[k]
            if end - begin <= leaf or radii[k] == 0:
                continue
            own = points[self.order[begin:end]]
            # rows along the line between two far points, cut in the middle
            one = own[((own - own.mean(0)) ** 2).sum(1).argmax()]
            other = own[((own - one) ** 2).sum(1).argmax()]
            self.order[begin:end] = self.order[begin:end][np.argsort(own @ (other - one), kind="stable")]
            cut = (begin + end) // 2
            self.children[k] = (node(begin, cut), node(cut, end))
            waiting.extend(self.children[k])
        self.centre = np.array(centres).reshape(len(centres), points.shape[1])
        self.radius = np.array(radii)
        self.slack = 1e-9 * (np.sqrt((self.centre**2).sum(1)) + self.radius) + 1e-290


class Shard:
    """A shard's vectors and their tree; row numbers stand in the tree's order."""

    def __init__(self, rows: np.ndarray, ids: list[int | None], x: np.ndarray):
        points, self.exponent = Values(x).scaled()
        self.tree = BallTree(points)
        order = self.tree.order
        narrow = x.astype(np.float32)
        self.rows, self.x = rows[order], (narrow if (narrow == x).all() else x)[order]
        self.keys = np.array([NO_ID if i is None else -i for i in ids], object)[order]

    def dump(self) -> bytes:
        return pickle.dumps(self, 5)

    @staticmethod
    def load(raw: bytes) -> Shard:
        shard = pickle.loads(raw)
        shard.values = Values(shard.x.astype(np.float64))
        return shard

    def search(self, queries: np.ndarray, own_rows: list[int], floors: list[int | None], k: int) -> Iterator[list[tuple[int, int | None]]]:
        """For each query (score, vec_id) of the at most k best rows but its own, by falling score and rising id; none is below its floor."""
        wide = self.values.x.shape[1]
        if queries.shape[1] != wide:  # what a shorter vector lacks is zero
            queries = np.pad(queries, ((0, 0), (0, max(0, wide - queries.shape[1]))))[:, :wide]
        asked, tree = Values(queries), self.tree
        points, e = asked.scaled()
        lengths = np.sqrt((points**2).sum(1))
        reach = points @ tree.centre.T + lengths[:, None] * (tree.radius + tree.slack) + 1e-290
        unit = 1 << max(0, e + self.exponent)
        for q in range(len(queries)):
            yield self._best(asked, q, reach[q].tolist(), unit, own_rows[q], floors[q], k)

    def _best(self, asked: Values, q: int, reach: list[float], unit: int, own_row: int, floor: int | None, k: int) -> list[tuple[int, int | None]]:
        ranges, children, rows, keys, longs = self.tree.ranges, self.tree.children, self.rows, self.keys, self.values.longs
        query = asked.longs[q]
        limit = SAFE / max(1.0, float(asked.top[q]) * asked.x.shape[1])
        best: list[tuple[int, int]] = []  # a heap of (score, -vec_id)
        waiting = [(-reach[0], 0)] if len(rows) else []
        least = floor
        bar = -np.inf if least is None else least / unit
        while waiting:
            bound, node = heapq.heappop(waiting)
            if -bound < bar:
                break
            if children[node]:
                for child in children[node]:
                    if reach[child] >= bar:
                        heapq.heappush(waiting, (-reach[child], child))
                continue
            begin, end = ranges[node]
            if (self.values.top[begin:end] < limit).all():
                scores = longs[begin:end] @ query
                near = np.arange(begin, end) if least is None else begin + np.flatnonzero(scores >= max(least, -(1 << 63)))
                met = zip(scores[near - begin].tolist(), near.tolist())
            else:
                exact = asked.exact(q)
                met = ((sum(a * b for a, b in zip(exact, self.values.exact(at))), at) for at in range(begin, end))
            for score, at in met:
                if rows[at] == own_row or floor is not None and score < floor:
                    continue
                item = (score, keys[at])
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k and (least is None or best[0][0] > least):
                least = best[0][0]
                bar = least / unit
        return [(s, None if i == NO_ID else -i) for s, i in sorted(best, reverse=True)]


def _dense(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for places, values in matrix(column):
        out[places, : values.shape[1]] = values[:, :width]
    return out


def _widest(column: pa.Array) -> int:
    return int(np.diff(column.offsets.to_numpy()).max(initial=0))


def _build(members: DataFrame) -> DataFrame:
    """(shard, tree) of members (shard, row, vec_id, v), a row per shard of about SHARD vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), group in groups(batches, 1):
            v = group.column("v").combine_chunks()
            built = Shard(group.column("row").to_numpy(), group.column("vec_id").to_pylist(), _dense(v, _widest(v)))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([built.dump()], pa.binary())], names=["shard", "tree"])

    dealt = members.repartition("shard").sortWithinPartitions("shard").select("shard", "row", "vec_id", "v")
    return dealt.mapInArrow(run, "shard long, tree binary")


def _visit(queries: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """What queries (shard, row, vec_id, v, floor) find in the shards they are dealt to; a score is null below all longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = number = None
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH):
                piece = batch.slice(begin, BATCH)
                numbers, kinds = piece.column("shard").to_pylist(), piece.column("kind").to_pylist()
                cuts = [k for k in range(piece.num_rows) if not k or kinds[k] == 0 or numbers[k] != numbers[k - 1]] + [piece.num_rows]
                for a, b in zip(cuts, cuts[1:]):
                    if kinds[a] == 0:
                        shard, number = Shard.load(piece.column("tree")[a].as_py()), numbers[a]
                        a += 1
                    if a < b:
                        if number != numbers[a]:
                            raise ValueError("queries came before their shard")
                        yield found(shard, piece.slice(a, b - a))

    def found(shard: Shard, asked: pa.RecordBatch) -> pa.RecordBatch:
        rows, ids, floors = (asked.column(c).to_pylist() for c in ("row", "vec_id", "floor"))
        v = asked.column("v")
        out: list[tuple[int, int, int | None, int]] = []
        for row, vec_id, best in zip(rows, ids, shard.search(_dense(v, _widest(v)), rows, floors, k)):
            out.extend((row, vec_id, i, s if s >= -(1 << 63) else None) for s, i in best)
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_row", "query_id", "vec_id", "score"])

    nothing = {"kind": "0", "row": "CAST(NULL AS LONG)", "vec_id": "CAST(NULL AS LONG)", "v": "CAST(NULL AS ARRAY<DOUBLE>)", "floor": "CAST(NULL AS LONG)", "tree": "tree"}
    first = trees.selectExpr("shard", *(f"{x} AS {c}" for c, x in nothing.items()))
    then = queries.selectExpr("shard", "1 AS kind", "row", "vec_id", "v", "floor", "CAST(NULL AS BINARY) AS tree")
    return first.unionByName(then).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, is_query: Column, scratch: Scratch, k: int = K) -> DataFrame:
    """(query_row, query_id, rank, vec_id, score): rows are (row, vec_id, v) with v an array of finite doubles."""
    n = rows.count()
    shards = max(1, -(-n // SHARD))
    members = rows.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards)))
    trees = scratch.save(_build(members), "trees")
    queries = members.where(is_query)
    best, begin, number = None, 0, 0
    while begin < shards:  # the shards at these distances from the query's own
        end = min(shards, max(1, begin * GROWTH))
        visited = queries.withColumn("shard", F.explode(F.transform(F.sequence(F.lit(begin), F.lit(end - 1)), lambda d: F.pmod(F.col("shard") + d, F.lit(shards)))))
        if best is None:
            visited = visited.withColumn("floor", F.lit(None).cast("long"))
        else:
            kth = best.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count("score") == k, F.min("score")).alias("floor"))
            visited = visited.join(kth, "row", "left")
        new = _visit(visited, trees, k)
        best = scratch.save(_best(new if best is None else best.drop("rank").unionByName(new), k), f"best-{number}")
        scratch.drop(f"best-{number - 1}")
        begin, number = end, number + 1
    scratch.drop("trees")
    score = F.coalesce("score", F.raise_error(F.lit("OverflowError: no long holds a score")).cast("long"))
    return best.select("query_row", "query_id", "rank", "vec_id", score.alias("score"))


def op7_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "ball-tree")
    rows = numbered(table(spark, sf_dir, "embeddings"), scratch).where("v is not null")
    found = top_k(rows, F.coalesce(F.col("vec_id") % QUERY_EVERY == 0, F.lit(False)), scratch)
    return found.select("query_id", "rank", "vec_id", "score")


QUERIES = {"op7_ball_tree": op7_ball_tree}
ORACLE = {
    "op7_ball_tree": f"""WITH part AS MATERIALIZED (
   SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({FACTOR} * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 wide AS MATERIALIZED (SELECT n, vec_id, list_resize(v, (SELECT greatest(max(len(v)), 1) FROM part), CAST(0 AS HUGEINT)) AS v FROM part),
 scored AS (
   SELECT q.n, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS score
   FROM wide q JOIN wide c ON q.n <> c.n WHERE q.vec_id % {QUERY_EVERY} = 0)
 SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
 FROM scored QUALIFY rank <= {K}"""
}
