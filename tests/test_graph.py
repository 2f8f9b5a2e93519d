"""Micro graphs with known answers, and random graphs against plain Python."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators import metrics, partition
from graphloom.operators.distance import bfs_levels, shortest_distances
from graphloom.plans.vertex_program import Levels, MinLabel, VertexProgram, run
from graphloom.sources import edgelist

MIXED = "# comment\n% comment\n1\t2\n2\t3\n3\t1\n5\t6\n8\t8\n1\t2\n"


def write(tmp_path, text, name="edges.txt"):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def graph(spark, pairs, **kw):
    return Graph(spark.createDataFrame(pairs, "src long, dst long"), **kw)


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def union_find(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def hops(pairs, source):
    around = {}
    for a, b in pairs:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    found, waiting = {source: 0}, deque([source])
    while waiting:
        x = waiting.popleft()
        for y in around.get(x, ()):
            if y not in found:
                found[y] = found[x] + 1
                waiting.append(y)
    return found


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    return edgelist.read_graph(spark, write(tmp_path_factory.mktemp("m1"), MIXED))


def test_mixed_counts(mixed):
    assert tuple(mixed.info().first()) == (6, 9, 5)
    assert as_dict(mixed.in_degrees()) == {1: 1, 2: 2, 3: 1, 6: 1, 8: 1}
    assert as_dict(mixed.out_degrees()) == {1: 2, 2: 1, 3: 1, 5: 1, 8: 1}
    assert as_dict(mixed.total_degrees()) == {1: 3, 2: 3, 3: 2, 5: 1, 6: 1, 8: 2}
    assert sorted(r.id for r in mixed.isolated().collect()) == [0, 4, 7]
    assert mixed.triplets().count() == 6 and mixed.in_edges(2).count() == 2 and mixed.out_edges(5).count() == 1


def test_mixed_components_and_distances(mixed):
    assert as_dict(metrics.connected_components(mixed)) == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8}
    assert [tuple(r) for r in metrics.top_components(mixed).collect()] == [(1, 3), (5, 2)]
    assert metrics.component_count(mixed).first()[0] == 2
    found = {(r.src, r.dst): r.distance for r in shortest_distances(mixed, [(1, 3), (1, 2), (1, 6), (1, 1), (1, 99)]).collect()}
    assert found == {(1, 3): 1, (1, 2): 1, (1, 6): None, (1, 1): 0, (1, 99): None}


@pytest.mark.parametrize(
    ("pairs", "budget", "expected"),
    [
        ([(1, 2), (2, 3), (3, 1), (5, 6), (8, 8), (1, 2)], 8, [(0, 0, 1, 1, 1), (1, 2, 2, 1, 2), (2, 3, 8, 3, 3)]),
        ([(1, 2), (2, 3), (3, 1), (5, 6), (8, 8), (1, 2)], 16, [(0, 0, 3, 3, 4), (1, 4, 8, 2, 2)]),
        ([(0, 1), (2, 1), (3, 1), (4, 1), (5, 1), (0, 3), (1, 4)], 12, [(0, 0, 1, 1, 5), (1, 2, 5, 2, 2)]),
    ],
)
def test_intervals(spark, pairs, budget, expected):
    g = graph(spark, pairs)
    parts = partition.intervals(g, budget)
    assert sorted(map(tuple, parts.collect())) == expected
    assert partition.assign(g, parts).count() == len(pairs)


def test_weighted_and_modes(spark, tmp_path):
    path = write(tmp_path, "1 2 0.5\n2,3,1.25\r\n\n3\t1\t-2 ")
    assert sorted(map(tuple, edgelist.read_edges(spark, path).collect())) == [(1, 2, 0.5), (2, 3, 1.25), (3, 1, -2.0)]
    for k, bad in enumerate(("9", "1 2 3 4", "a b", "-1 2", "1 2 x")):
        path = write(tmp_path, f"{'1 2' if k != 4 else '1 2 3'}\n{bad}\n", f"bad{k}.txt")
        assert edgelist.read_edges(spark, path, mode="DROPMALFORMED").count() == 1
        with pytest.raises(Exception, match="malformed edge"):
            edgelist.read_edges(spark, path).count()


@pytest.mark.parametrize("text", ["", "# only\n% comments\n"])
def test_no_edges(spark, tmp_path, text):
    g = edgelist.read_graph(spark, write(tmp_path, text))
    assert tuple(g.info().first()) == (0, 0, 0)
    assert metrics.connected_components(g).count() == 0 and partition.intervals(g).count() == 0
    assert shortest_distances(g, [(0, 1)]).first().distance is None


def test_meeting_and_path(spark):
    g = graph(spark, [(1, 3), (1, 7), (2, 4), (2, 8), (7, 8), (3, 5), (5, 4)])
    assert shortest_distances(g, [(1, 2)]).first().distance == 3
    path = graph(spark, [(i, i + 1) for i in range(30)])
    assert tuple(metrics.top_components(path).first()) == (0, 31)
    assert shortest_distances(path, [(0, 30)]).first().distance == 30


def test_random_graph_against_plain_python(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(70)]
    g = graph(spark, pairs)
    labels = union_find(pairs, range(max(max(p) for p in pairs) + 1))
    assert as_dict(metrics.connected_components(g)) == labels
    assert {k: int(v) for k, v in as_dict(run(g, MinLabel())).items()} == labels
    backwards = graph(spark, [(b, a) for a, b in pairs] * 2)
    assert as_dict(metrics.connected_components(backwards)) == labels
    source = pairs[0][0]
    assert as_dict(bfs_levels(g, source)) == hops(pairs, source)
    reached = {k: v for k, v in as_dict(run(g, Levels(source))).items() if v is not None}
    assert reached == hops(pairs, source)
    total = g.total_degrees(zeros=True).agg(F.sum("degree")).first()[0]
    assert total == 2 * len(pairs)


def test_program_hooks(spark):
    class Once(MinLabel):
        def after_iteration(self, ctx):
            ctx.stop()

    g = graph(spark, [(0, 1), (1, 2)])
    assert as_dict(run(g, Once())) == {0: 0.0, 1: 0.0, 2: 1.0}
    with pytest.raises(RuntimeError):
        run(g, MinLabel(), iterations=1)

    class Degree(VertexProgram):
        activate_all = True

        def message(self):
            return F.lit(1.0)

        def combine(self, messages):
            return F.sum(messages)

        def apply(self):
            return F.coalesce("gathered", F.lit(0.0))

        def after_iteration(self, ctx):
            ctx.stop()

    assert as_dict(run(g, Degree())) == {0: 1.0, 1: 2.0, 2: 1.0}


def test_save_and_reopen(spark, tmp_path):
    source = write(tmp_path, MIXED)
    folder = str(tmp_path / "kept")
    assert not edgelist.is_current(spark, folder, source)
    g = edgelist.open_graph(spark, source, folder)
    assert edgelist.is_current(spark, folder, source) and tuple(g.info().first()) == (6, 9, 5)
    write(tmp_path, MIXED + "9\t9\n")
    assert not edgelist.is_current(spark, folder, source)
    assert edgelist.open_graph(spark, source, folder).edges.count() == 7


def test_generator(spark):
    rows = edgelist.random_edges(spark, 500, 3).collect()
    assert len(rows) == 500 and rows == edgelist.random_edges(spark, 500, 3).collect()
    assert all(0 <= r.src < 500 and 0 <= r.dst < 500 for r in rows) and sum(r.src == r.dst for r in rows) < 3


def test_stream(spark, tmp_path):
    from graphloom.streaming.edges import stream_degrees, stream_edges

    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "1 2\nbad\n2 2\n")
    query = stream_degrees(stream_edges(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("degrees").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("degrees").collect())) == [(1, 0, 1), (2, 2, 1)]


def test_stars():
    import numpy as np
    from graphloom.operators.components import stars

    rng = random.Random(3)
    for n in (0, 1, 5, 60, 400):
        pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(n)] + [(k, k + 1) for k in range(500, 500 + n)]
        found = stars(*(np.array([p[k] for p in pairs], np.int64) for k in (0, 1)))
        labels = union_find(pairs, {i for p in pairs for i in p})
        assert dict(zip(*(x.tolist() for x in found))) == {i: x for i, x in labels.items() if i != x}


def plain_intervals(pairs, budget):
    """The greedy cut, one destination after the other."""
    degrees = {}
    for _, b in pairs:
        degrees[b] = degrees.get(b, 0) + 1
    count, size = partition.plan(len(pairs), budget)
    out = []
    for i in sorted(degrees):
        if out and (len(out) == count or out[-1][2] + degrees[i] <= size // 4):
            out[-1] = [i, out[-1][1] + 1, out[-1][2] + degrees[i]]
        else:
            out.append([i, 1, degrees[i]])
    out[-1][0] = max(map(max, pairs))
    return [(k, out[k - 1][0] + 1 if k else 0, *x) for k, x in enumerate(out)]


def test_intervals_of_many_blocks(spark):
    """Chains over blocks no longer than an interval, with destinations larger than several blocks."""
    rng = random.Random(8)
    pairs = [(rng.randrange(300), int(300 * rng.random() ** 2)) for _ in range(2000)] + [(1, 170)] * 700 + [(2, 299)] * 300
    g = graph(spark, pairs)
    for budget, block in ((400, 1), (90, 1), (400, 350), (4000, 1), (4 * 900, 100)):
        parts = partition.intervals(g, budget, block)
        assert sorted(map(tuple, parts.collect())) == plain_intervals(pairs, budget)
    parts = sorted(map(tuple, parts.collect()))
    found = {(r.dst, r.interval) for r in partition.assign(g, partition.intervals(g, budget, block)).collect()}
    assert found == {(b, k) for _, b in pairs for k, lo, hi, *_ in parts if lo <= b <= hi}


def test_last_at_most(spark):
    from graphloom.functions.search import last_at_most

    for n in (0, 1, 2, 3, 8, 13):
        bounds = list(range(0, 10 * n, 10))
        rows = spark.range(-2, 10 * n + 3).select("id", last_at_most(F.lit(bounds).cast("array<long>") if n else F.array().cast("array<long>"), F.col("id")).alias("at")).collect()
        assert all(r["at"] == sum(b <= r.id for b in bounds) - 1 for r in rows)


def test_running_sums_and_next(spark):
    from graphloom.functions.running import running_sums, with_next

    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(60), k) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, key long, k long")
    found = {(r.g, r.k): r.s for r in running_sums(df, "key", {"s": F.col("k")}, ("g",), ("k",), chunk=7).collect()}
    assert found == {(g, k): sum(z for x, y, z in rows if x == g and (y, z) <= (key, k)) for g, key, k in rows}
    ahead = {r.k: r.n for r in with_next(df, ("key", "k"), F.floor(F.col("key") / 9), "k", "n").collect()}
    order = [k for _, _, k in sorted(rows, key=lambda r: r[1:])]
    assert ahead == dict(zip(order, [*order[1:], None]))


@pytest.mark.parametrize(("split_from", "local"), [(0, 0), (0, 40), (1_000_000, 0), (1_000_000, 40)])
def test_components_of_hubs(spark, monkeypatch, split_from, local):
    from graphloom.operators import components

    monkeypatch.setattr(components, "SPLIT_FROM", split_from)
    monkeypatch.setattr(components, "LOCAL", local)
    rng = random.Random(local)
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(200, k) for k in range(201, 230)] + [(230, 229), (231, 231)]
    found = as_dict(components.component_labels(spark.createDataFrame([*pairs, (None, 3)], "src long, dst long")))
    pairs = [p for p in pairs if p[0] != p[1]]
    assert found == union_find(pairs, {i for p in pairs for i in p})


def test_distance_cut_short(spark):
    path = graph(spark, [(i, i + 1) for i in range(12)])
    with pytest.raises(RuntimeError, match="further apart"):
        shortest_distances(path, [(0, 12)], max_levels=2)
    assert shortest_distances(path, [(0, 12), (0, 3)], max_levels=2, allow_partial=True).orderBy("dst").collect()[0].distance == 3
    assert shortest_distances(path, [(0, 12)], max_levels=2, allow_partial=True).first().distance is None
    with pytest.raises(RuntimeError):
        bfs_levels(path, 0, max_levels=3)


def test_tasks_of_a_program(spark):
    class Changed(MinLabel):
        def init(self, vertices):
            return super().init(vertices).withColumn("active", F.lit(False))

        def before_iteration(self, ctx):
            seen.append(ctx.active)
            if ctx.iteration == 0:
                ctx.clear()
                ctx.add_task(0, 1, 2)
                ctx.deactivate_range(1, 1)
                ctx.remove_task(2)

        def after_iteration(self, ctx):
            if ctx.iteration == 1:
                ctx.clear()
                ctx.stop()

    class Woken(Changed):
        def init(self, vertices):
            return super().init(vertices).withColumn("active", F.col("id") == 5)

    g, seen = graph(spark, [(0, 1), (1, 2), (2, 3), (4, 5)]), []
    assert as_dict(run(g, Changed())) == dict(enumerate(map(float, range(6)))) and seen == []
    assert as_dict(run(g, Woken())) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5} and seen == [1, 1]


def test_kept_graph_follows_its_options(spark, tmp_path):
    source, folder = write(tmp_path, MIXED), str(tmp_path / "kept")
    assert edgelist.open_graph(spark, source, folder).dense
    assert not edgelist.open_graph(spark, source, folder, dense=False).dense
    edgelist.save_values(spark.createDataFrame([(1, 7.0)], "id long, value double"), folder)
    assert as_dict(edgelist.load_graph(spark, folder).vertices())[1] == 7.0
    with pytest.raises(FileNotFoundError):
        edgelist.load_graph(spark, str(tmp_path / "none"))


def test_generator_on_any_partitions(spark):
    one, two = (sorted(map(tuple, edgelist.random_edges(spark, 300, 3).repartition(n).collect())) for n in (1, 5))
    assert one == two != sorted(map(tuple, edgelist.random_edges(spark, 300, 4).collect()))
    ends = [x for r in edgelist.random_edges(spark, 20000, 1).collect() for x in r[:2]]
    eighths = [sum(x * 8 // 20000 == k for x in ends) for k in range(8)]
    assert max(abs(n - 5000) for n in eighths) < 300 and len(set(ends)) > 0.84 * 20000


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from graphloom.scratch import shared_root

    context = SimpleNamespace(master="spark://far:7077", getConf=lambda: {})
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared_root(SimpleNamespace(conf={}, sparkContext=context))


def test_command_line(spark, tmp_path, capsys):
    from graphloom.__main__ import main

    path = write(tmp_path, MIXED)
    main(["components", path, "--top", "1", "--cache"])
    out = capsys.readouterr().out
    assert "2 components" in out and "|    1|   3|" in out and "read: " in out and "components: " in out
    main(["distance", path, "--src", "1", "--dst", "3"])
    main(["distance", path, "--src", "1", "--dst", "6"])
    main(["info", path])
    out = capsys.readouterr().out
    assert "distance 1\n" in out and "no path\n" in out and "|    6|       9|               5|" in out
    main(["generate", str(tmp_path / "made"), "-n", "50", "--seed", "2"])
    assert edgelist.read_edges(spark, str(tmp_path / "made")).count() == 50


def test_timers():
    from graphloom.timing import Timers

    timers = Timers()
    for _ in range(2):
        with timers.phase("one"):
            pass
    with pytest.raises(ValueError), timers.phase("two"):
        raise ValueError
    assert list(timers.seconds) == ["one", "two"] and timers.report().startswith("one: 0.0")
