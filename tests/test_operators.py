"""Brute force, properties and edge cases of operators that SQL doesn't cover."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import hashing
from gridloom.operators import grid, keyindex, rtree, splits, workload
from gridloom.sources import files
from gridloom.streaming import snapshots


def test_key_on_an_edge_is_in_two_cells_and_one_outside_in_none(spark):
    cells = grid.cells_1d(spark, 0.0, 40.0, 4)
    keys = spark.createDataFrame([(0, 1), (10, 1), (15, 1), (40, 1), (41, 1), (-1, 1)], "key long, value long")
    found = {r["key"]: r["n"] for r in grid.key_cells(keys, cells, 0.0, 40.0, 4).groupBy("key").agg(F.count("cid").alias("n")).collect()}
    assert found == {0: 1, 10: 2, 15: 1, 40: 1}


def test_scans_past_the_end_and_misses(spark):
    keys = spark.createDataFrame([(k, k) for k in (1, 5, 9)], "key long, value long")
    requests = spark.createDataFrame([(0, 0, 2), (1, 5, 9), (2, 10, 3), (3, 6, 1)], "req_id long, key long, scan_len long")
    found = sorted(map(tuple, keyindex.scan_many(requests, keys).collect()))
    assert found == [(0, 2, 1, 5), (1, 2, 5, 9), (2, 0, None, None), (3, 1, 9, 9)]


def test_touching_and_degenerate_rectangles(spark):
    objects = spark.createDataFrame([(1, 0.0, 2.0, 0.0, 2.0), (2, 2.0, 4.0, 0.0, 2.0), (3, 1.0, 1.0, 1.0, 1.0)], "id long, l double, r double, b double, t double")
    boxes = spark.createDataFrame([(7, 0.0, 2.0, 0.0, 2.0)], "qid long, l double, r double, b double, t double")
    from gridloom.functions.geometry import intersects_closed

    assert rtree.overlap_count(boxes, objects).first()["n"] == 1
    assert rtree.overlap_count(boxes, objects, intersects_closed).first()["n"] == 3


def test_nearest_equals_full_sort_with_ties(spark):
    rng = random.Random(3)
    points = [(i, float(rng.randrange(12)), float(rng.randrange(12))) for i in range(300)]
    queries = [(q, rng.uniform(-3, 15), float(rng.randrange(12)), 1 + q % 6) for q in range(25)]
    found = rtree.nearest(
        spark.createDataFrame(queries, "qid long, x double, y double, k long"), spark.createDataFrame(points, "id long, x double, y double")
    ).collect()
    for q, x, y, k in queries:
        want = sorted(((px - x) * (px - x) + (py - y) * (py - y), i) for i, px, py in points)[:k]
        assert sorted((r["rank"], r["id"]) for r in found if r["qid"] == q) == [(n + 1, i) for n, (_, i) in enumerate(want)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, l double, r double, b double, t double")
    boxes = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0)], "qid long, l double, r double, b double, t double")
    assert rtree.overlap_count(boxes, none).first()["n"] == 0
    assert keyindex.page_layout(spark.createDataFrame([], "key long, value long")).count() == 0


def _nodes(spark, n=3, seed=1):
    rng = random.Random(seed)
    rows = []
    for node in range(n):
        for o in range(51):
            x, y = rng.randrange(60), rng.randrange(60)
            rows.append((node, o, float(x), float(x + rng.randrange(9)), float(y), float(y + rng.randrange(9))))
    return spark.createDataFrame(rows, "node_id long, ordinal long, l double, r double, b double, t double")


def test_quadratic_and_greene_splits_keep_all_entries_and_the_least_fill(spark):
    entries = _nodes(spark)
    for f in (splits.quadratic_split, splits.greene_split):
        pdf = f(entries).toPandas()
        assert len(pdf) == 153 and not pdf.duplicated(["node_id", "ordinal"]).any()
        assert pdf.groupby(["node_id", "side"]).size().min() >= splits.MIN_ENTRIES


def test_prefix_and_suffix_cover_the_node(spark):
    entries = _nodes(spark)
    c = splits.split_candidates(entries, ["left"]).toPandas()
    hull = entries.groupBy("node_id").agg(F.min("l").alias("l"), F.max("r").alias("r")).toPandas().set_index("node_id")
    assert (c[["p_l", "s_l"]].min(axis=1) == c["node_id"].map(hull["l"])).all()
    assert (c[["p_r", "s_r"]].max(axis=1) == c["node_id"].map(hull["r"])).all()
    assert sorted(c["idx"].unique()) == list(range(19, 31))


def test_covering_choice_prefers_the_smallest_holding_child(spark):
    entries = spark.createDataFrame(
        [(0, 0, 0.0, 9.0, 0.0, 9.0), (0, 1, 0.0, 5.0, 0.0, 5.0), (1, 0, 0.0, 1.0, 0.0, 1.0), (1, 1, 8.0, 9.0, 8.0, 9.0)],
        "node_id long, ordinal long, l double, r double, b double, t double",
    )
    probes = spark.createDataFrame([(0, 1.0, 2.0, 1.0, 2.0), (1, 7.0, 7.5, 8.0, 9.0)], "node_id long, l double, r double, b double, t double")
    assert sorted(map(tuple, splits.choose_covering(entries, probes).collect())) == [(0, 1), (1, 1)]


def _fnv(v):
    h = 0xCBF29CE484222325
    for _ in range(8):
        h = ((h ^ (v & 255)) * 1099511628211) % 2**64
        v >>= 8
    return h


def test_hash_and_its_remainder(spark):
    values = [0, 1, 255, 256, 10**12, 2**62]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    rows = df.select("v", hashing.fnv64(F.col("v")).alias("h"), hashing.fnv_mod(F.col("v"), 15_000).alias("m")).collect()
    assert all(int(r["h"]) == _fnv(r["v"]) and r["m"] == _fnv(r["v"]) % 15_000 for r in rows)


def test_zipf_shares_follow_rank(spark):
    df = spark.range(40_000).select(hashing.zipf(hashing.uniform(F.col("id"), 0), 1000).alias("rank"))
    n = {r["rank"]: r["count"] for r in df.groupBy("rank").count().collect()}
    zn = hashing.zeta(1000, 0.99)
    assert max(n) < 1000 and abs(n[0] / 40_000 - 1 / zn) < 0.01 and abs(n[1] / 40_000 - 0.5**0.99 / zn) < 0.01


def test_normal_draws_have_their_moments(spark):
    row = spark.range(20_000).select(hashing.normal(F.col("id"), 0).alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(row[0]) < 0.03 and abs(row[1] - 1) < 0.03


def test_contiguous_ack_with_a_gap(spark):
    assert workload.contiguous_ack(spark.createDataFrame([(i,) for i in (0, 1, 2, 4, 5)], "id long")).first()["last"] == 2


def test_properties_placement_and_binary_keys(spark, tmp_path):
    (tmp_path / "mix").write_text("# c\na = 1\nb=x=y \na=2\n\nbad line\n")
    assert {r["key"]: r["value"] for r in files.read_properties(spark, str(tmp_path / "mix")).collect()} == {"a": "2", "b": "x=y"}
    (tmp_path / "place").write_text("0 1 0 1\n3 15 4 16\n")
    assert [tuple(r)[1:] for r in files.read_placement(spark, str(tmp_path / "place")).orderBy("cid").collect()] == [(0, 0, 3), (1, 1, 15), (2, 0, 4), (3, 1, 16)]
    keys = [5, 2**64 - 1, 0]
    (tmp_path / "keys.bin").write_bytes(b"".join(k.to_bytes(8, "little") for k in [len(keys), *keys]))
    assert [int(r["key"]) for r in files.read_binary_keys(spark, str(tmp_path / "keys.bin")).orderBy("pos").collect()] == keys


@pytest.mark.parametrize("batches", [1, 3])
def test_streaming_totals_and_acks_equal_batch(spark, tmp_path, batches):
    ids = list(range(60))
    random.Random(5).shuffle(ids)
    ids.remove(41)
    size = math.ceil(len(ids) / batches)
    for b in range(batches):
        pd.DataFrame({"id": ids[b * size : (b + 1) * size]}).assign(cell=lambda d: d["id"] % 4).to_parquet(tmp_path / f"part-{b}.parquet")
    stream = spark.readStream.schema("id long, cell long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    out = {}
    for name, df in (("totals", snapshots.running_totals(stream, "cell")), ("acks", snapshots.acknowledged(stream, "id"))):
        q = df.writeStream.format("memory").queryName(f"{name}_{batches}").outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination(120)
        out[name] = spark.table(f"{name}_{batches}").toPandas()
    assert out["totals"].groupby("key")["total"].max().to_dict() == {0: 15, 1: 14, 2: 15, 3: 15}
    assert out["acks"]["last"].max() == 40


def test_tumbling_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", (F.col("event_id") % 4).alias("cell"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = snapshots.tumbling(stream, "ts", ["cell"], "1 day").writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, snapshots.tumbling(events, "ts", ["cell"], "1 day").collect()))
