"""Operators against plain versions where their ranges, grids and blocks are many and small."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.geometry import contains, intersects_closed, overlaps_open
from gridloom.functions.hashing import fnv_mod, hashes, uniform, zeta, zipf
from gridloom.operators import profiling, ranking, rtree, splits, workload
from gridloom.operators.keyindex import lower_bound, scan_many
from gridloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 20)
    monkeypatch.setattr(ranking, "EDGES", 8)


@pytest.mark.parametrize("kind", ["distinct", "hot", "one value", "nulls", "empty"])
def test_global_rank(spark, small_ranges, kind):
    rng = random.Random(3)
    values = {
        "distinct": [(v, 0) for v in rng.sample(range(10_000), 900)],
        "hot": [(7 if rng.random() < 0.4 else rng.randrange(30), i) for i in range(900)],
        "one value": [(5, i) for i in rng.sample(range(10_000), 300)],
        "nulls": [(None if i % 9 == 0 else rng.randrange(200), i) for i in range(400)],
        "empty": [],
    }[kind]
    found = ranking.global_rank(spark.createDataFrame(values, "a long, b long").repartition(4), "a", ["b"]).collect()
    expected = sorted(values, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [(r["a"], r["b"]) for r in sorted(found, key=lambda r: r["rank"])] == expected
    assert sorted(r["rank"] for r in found) == list(range(1, len(values) + 1))


def test_hot_values_are_divided(spark, small_ranges):
    """No range of a rank holds much more than it should, though one value has half of the rows."""
    df = spark.range(2000).select(F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id")).alias("a"), "id")
    ranges = ranking.buckets_of(df, "a")
    assert ranges.hot == [5]
    inner = ranking.buckets_of(df.filter("a = 5"), "id")
    assert df.filter("a = 5").groupBy(inner.of(F.col("id"))).count().agg(F.max("count")).first()[0] < 100


def test_lower_bound_and_scans(spark, small_ranges):
    rng = random.Random(4)
    keys = sorted(rng.sample(range(3000), 500))
    requests = [(i, rng.randrange(-5, 3010), rng.randrange(0, 200)) for i in range(300)]
    k = spark.createDataFrame([(x,) for x in keys], "key long")
    r = spark.createDataFrame(requests, "req_id long, key long, scan_len long")
    at = {x["req_id"]: x["position"] for x in lower_bound(r, k).collect()}
    assert at == {i: sum(x < key for x in keys) for i, key, _ in requests}
    found = {x["req_id"]: (x["n"], x["lo"], x["hi"]) for x in scan_many(r, k).collect()}
    for i, key, n in requests:
        own = [x for x in keys if x >= key][:n]
        assert found[i] == ((len(own), own[0], own[-1]) if own else (0, None, None))


def _rects(rng, n, size):
    out = []
    for i in range(n):
        l, b = rng.randrange(100), rng.randrange(80)
        w, h = (rng.randrange(size), rng.randrange(size)) if rng.random() < 0.9 else (rng.randrange(120), rng.randrange(3))
        out.append((i, float(l), float(l + w), float(b), float(b + h)))
    return out


@pytest.mark.parametrize("predicate", [overlaps_open, intersects_closed, contains])
def test_overlap_pairs(spark, monkeypatch, predicate):
    """Rectangles of all sizes, touching, degenerate and outside; each pair once."""
    monkeypatch.setattr(rtree, "OBJECTS_PER_CELL", 1)
    rng = random.Random(5)
    objects, boxes = _rects(rng, 300, 6), [*_rects(rng, 80, 9), (900, -50.0, 500.0, -50.0, 500.0), (901, 300.0, 310.0, 0.0, 5.0), (902, 3.0, 3.0, 4.0, 4.0)]
    o = spark.createDataFrame(objects, "id long, l double, r double, b double, t double")
    q = spark.createDataFrame(boxes, "qid long, l double, r double, b double, t double")
    found = sorted((x["qid"], x["id"]) for x in rtree.overlap_pairs(q, o, predicate).select("qid", "id").collect())
    test = {
        overlaps_open: lambda o, q: max(o[0], q[0]) < min(o[1], q[1]) and max(o[2], q[2]) < min(o[3], q[3]),
        intersects_closed: lambda o, q: o[0] <= q[1] and q[0] <= o[1] and o[2] <= q[3] and q[2] <= o[3],
        contains: lambda o, q: o[0] <= q[0] and o[1] >= q[1] and o[2] <= q[2] and o[3] >= q[3],
    }[predicate]
    assert found == sorted((b[0], x[0]) for b in boxes for x in objects if test(x[1:], b[1:]))


def test_no_rectangle_is_copied_to_many_cells(spark):
    rng = random.Random(6)
    o = spark.createDataFrame(_rects(rng, 2000, 3), "id long, l double, r double, b double, t double")
    grid = rtree.grid_of(o)
    covered = rtree._cover(rtree._levelled(o, grid), grid, list(range(grid.top + 1)), "own")
    assert covered.filter("own").groupBy("id").count().agg(F.max("count")).first()[0] <= 4


@pytest.mark.parametrize("n", [0, 3, 700])
def test_nearest(spark, monkeypatch, n):
    """Clustered and repeated points, queries far outside, more neighbours asked for than there are."""
    monkeypatch.setattr(rtree, "OBJECTS_PER_CELL", 2)
    rng = random.Random(7)
    points = [(i, float(rng.choice([rng.randrange(4), rng.randrange(1000)])), float(rng.randrange(300))) for i in range(n)]
    queries = [(i, float(rng.randrange(-500, 1500)), float(rng.randrange(-900, 900)), rng.choice([1, 2, 5, 40])) for i in range(60)]
    p = spark.createDataFrame(points, "id long, x double, y double")
    q = spark.createDataFrame(queries, "qid long, x double, y double, k int")
    found = sorted((r["qid"], r["rank"], r["id"]) for r in rtree.nearest(q, p).collect())
    expected = []
    for qid, x, y, k in queries:
        own = sorted(((px - x) ** 2 + (py - y) ** 2, i) for i, px, py in points)[:k]
        expected += [(qid, r + 1, i) for r, (_, i) in enumerate(own)]
    assert found == sorted(expected)


def test_percentiles(spark, small_ranges):
    rng = random.Random(8)
    rows = [(op, rng.choice([5, rng.randrange(1000)])) for op in "abc" for _ in range(rng.choice([1, 2, 333]))] + [("d", None), ("a", None)]
    points = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    found = {r["op"]: r for r in profiling.percentiles(spark.createDataFrame(rows, "op string, ns long"), points).collect()}
    for op in "abc":
        own = [n for o, n in rows if o == op and n is not None]
        assert all(found[op][k] == pytest.approx(float(np.quantile(own, v)), abs=1e-4) for k, v in points.items())
    assert "d" not in found


@pytest.mark.parametrize("theta", [0.4, 0.99, 1.2, 1.5])
def test_zipf_of_any_skew(spark, theta):
    """Shares of the first ranks, and ranks as a plain draw gives them."""
    n = 1000
    rows = spark.range(20_000).select(uniform(F.col("id"), 0).alias("u")).select("u", zipf(F.col("u"), n, theta).alias("rank")).collect()
    zn, eta = zeta(n, theta), (1 - (2 / n) ** (1 - theta)) / (1 - zeta(2, theta) / zeta(n, theta))

    def draw(u):
        if u * zn < 1:
            return 0
        if u * zn < 1 + 0.5**theta:
            return 1
        return min(math.floor(n * (eta * u - eta + 1) ** (1 / (1 - theta))), n - 1)

    assert [r["rank"] for r in rows] == [draw(r["u"]) for r in rows]
    assert abs(statistics.mean(r["rank"] == 0 for r in rows) - 1 / zn) < 0.02
    assert all(0 <= r["rank"] < n for r in rows)


def test_growing_keys(spark):
    """Inserts number on; whatever else is drawn exists by then."""
    for dist in ("zipfian", "latest", "uniform"):
        mix = workload.Mix({"READ": 0.5, "INSERT": 0.3, "SCAN": 0.2}, dist, scan_low=2, scan_high=9)
        rows = sorted(workload.growing_requests(spark.range(2000).toDF("req_id"), mix, 500).collect())
        there = 500
        for r in rows:
            if r["op"] == "INSERT":
                assert r["key_index"] == there
                there += 1
            else:
                assert 0 <= r["key_index"] < there
            assert (2 <= r["scan_len"] <= 9) == (r["op"] == "SCAN")
        assert len(rows) == 2000 and 1000 < there < 1250
        if dist != "uniform":
            assert any(r["key_index"] >= 500 for r in rows if r["op"] == "READ")


def test_requests_follow_the_keys(spark):
    for sf in ("sf0.001", "sf0.1"):
        path = f"/root/testdata/{sf}"
        n = spark.read.parquet(f"{path}/orders.parquet").count()
        found = catalogue.QUERIES["k03_lookup"](spark, path).agg(F.max("req_id"), F.count(F.lit(1))).first()
        assert found[1] == spark.read.parquet(f"{path}/events.parquet").count()
        misses = catalogue.QUERIES["g07_unroutable"](spark, path)
        assert misses.count() > 0 and misses.agg(F.min("key")).first()[0] >= n - 1


def test_nearest_of_repeated_places(spark):
    """Many points and queries at few places, far apart in one direction: one cell's points only are compared."""
    points = spark.range(4000).selectExpr("id", "cast(id % 5 as double) x", "cast((id div 5) % 40 as double) * 1000 y")
    queries = spark.range(600).selectExpr("id qid", "cast(id % 5 as double) x", "cast(id % 40 as double) * 1000 + 1 y", "1 + id % 3 k")
    found = rtree.nearest(queries, points)
    rows = {(r["qid"], r["rank"]): r["id"] for r in found.collect()}
    assert len(rows) == sum(1 + i % 3 for i in range(600))
    for (qid, rank), id_ in rows.items():
        first = qid % 5 + 5 * next(i for i in range(40) if i * 1000 == qid % 40 * 1000)
        assert id_ == first + 200 * (rank - 1), (qid, rank)
    assert max(_join_rows(found)) < 60_000  # a query at each of 40 places with each of its own


@pytest.mark.parametrize("predicate", [overlaps_open, intersects_closed, contains])
def test_counts_of_repeated_rectangles(spark, predicate):
    """Equal rectangles are met once: the joins make far fewer rows than there are pairs. A box without sides counts 0."""
    o = spark.range(3000).selectExpr("id", "cast(id % 10 as double) l", "cast(id % 10 + 4 as double) r", "cast(id % 3 as double) b", "cast(id % 3 + 5 as double) t")
    q = spark.range(2000).selectExpr("id qid", "cast(id % 8 as double) l", "cast(id % 8 + 2 as double) r", "1D b", "cast(if(id = 7, null, 3) as double) t")
    test = {
        overlaps_open: lambda o, q: max(o[0], q[0]) < min(o[1], q[1]) and max(o[2], q[2]) < min(o[3], q[3]),
        intersects_closed: lambda o, q: o[0] <= q[1] and q[0] <= o[1] and o[2] <= q[3] and q[2] <= o[3],
        contains: lambda o, q: o[0] <= q[0] and o[1] >= q[1] and o[2] <= q[2] and o[3] >= q[3],
    }[predicate]
    own = [((i % 10, i % 10 + 4, i % 3, i % 3 + 5)) for i in range(3000)]
    want = [sum(test(a, (k, k + 2, 1, 3)) for a in own) for k in range(8)]
    found = rtree.contains_count(q, o) if predicate is contains else rtree.overlap_count(q, o, predicate)
    assert {r["qid"]: r["n"] for r in found.collect()} == {i: 0 if i == 7 else want[i % 8] for i in range(2000)}
    assert sum(want) * 250 > 500_000 and max(_join_rows(found)) < 10_000


def test_cells_take_the_shape_of_the_rectangles(spark):
    """Wide flat rectangles in a narrow high extent: pairs that share a cell are few times those that meet."""
    o = spark.range(3000).selectExpr("id", "cast(id % 30 as double) l", "cast(id % 30 + 8 as double) r", "cast(id as double) b", "id + 0.5D t")
    q = spark.range(300).selectExpr("id qid", "cast(id % 30 as double) l", "cast(id % 30 + 8 as double) r", "cast(id * 10 as double) b", "id * 10 + 2D t")
    grid = rtree.grid_of(o, rtree._aspect(q, o))
    assert abs(grid.width / grid.height - 16 / 2.5) < 0.01
    shape = grid.high_y - grid.low_y, grid.height
    assert shape[0] == shape[1] or grid.width > grid.high_x - grid.low_x


@pytest.mark.parametrize("name", ["r24_split_candidates", "r25_split_area", "r27_split_overlap", "r46_split_costs", "r46_splits_differ"])
def test_tasks_of_splits_follow_the_entries(spark, monkeypatch, name):
    """Entries are shuffled once, into as many tasks as their number asks for, and nothing is sorted in larger ones."""
    monkeypatch.setattr(splits, "ROWS_PER_TASK", 20, raising=False)
    rows = spark.read.parquet(f"{SF}/events.parquet").count()
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line and "Reused" not in line]
    assert rows > 20 * 8 and exchanges
    assert all("node_id" in x and f", {-(-rows // 20)})" in x for x in exchanges), exchanges


def test_requests_of_mixes_are_spread_and_hashed_in_batches(spark, monkeypatch):
    """Tasks follow the number of ids, and a plan has no hash that is looped over row by row."""
    ids = spark.range(-500, 2500, 1, 1).toDF("req_id")
    both = ids.select(
        hashes({"a": F.col("req_id") * 1024, "b": F.col("req_id") * 1024 + 5}, "uniform").alias("u"), hashes({"m": F.col("req_id")}, "mod", 977).alias("h"),
        uniform(F.col("req_id"), 0).alias("a"), uniform(F.col("req_id"), 5).alias("b"), fnv_mod(F.col("req_id"), 977).alias("m"),
    )
    assert both.filter("u.a = a and u.b = b and h.m = m").count() == 3000
    monkeypatch.setattr(workload, "IDS_PER_TASK", 100, raising=False)
    mixes = {"a": workload.Mix({"READ": 0.5, "SCAN": 0.5}), "b": workload.Mix({"READ": 1.0}, "latest"), "c": workload.Mix({"INSERT": 1.0}, "uniform")}
    found = workload.mixed_requests(ids, mixes, 1000)
    assert found.rdd.getNumPartitions() == 30 and found.count() == 9000
    assert "lambda" not in found._jdf.queryExecution().executedPlan().toString()


def _join_rows(df):
    """Output rows of the joins of a plan, after it ran."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if "Join" in name:
            out.append(node.metrics().get("numOutputRows").get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out
