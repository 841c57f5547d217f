"""The engine's tables, derived from the shared star schema, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS, SIDE = 256, 16


class Tables:
    """Derived tables of one input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def keys(self) -> DataFrame:
        return self.base("orders").select(F.col("o_orderkey").cast("long").alias("key"), F.col("o_custkey").cast("long").alias("value"))

    @cached_property
    def key_log(self) -> DataFrame:
        id_ = F.col("event_id").cast("long")
        return self.base("events").select(F.pmod(id_ * 7919, F.lit(2000)).alias("key"), F.col("user_id").cast("long").alias("value"), id_.alias("seq"))

    @cached_property
    def rects(self) -> DataFrame:
        id_, l, b = F.col("event_id").cast("long"), F.col("user_id").cast("double"), F.floor("value").cast("double")
        return self.base("events").select(id_.alias("id"), l.alias("l"), (l + id_ % 7).alias("r"), b.alias("b"), (b + id_ % 5).alias("t"))

    @cached_property
    def boxes(self) -> DataFrame:
        k, s = F.col("p_partkey").cast("long"), F.col("p_size").cast("double")
        b = (k % 400).cast("double")
        return self.base("part").select(k.alias("qid"), s.alias("l"), (s + 1 + k % 9).alias("r"), b.alias("b"), (b + 1 + k % 6).alias("t"))

    @cached_property
    def points(self) -> DataFrame:
        return self.base("customer").select(
            F.col("c_custkey").cast("long").alias("id"), F.col("c_nationkey").cast("double").alias("x"), F.round("c_acctbal", 2).alias("y")
        )

    @cached_property
    def knn_queries(self) -> DataFrame:
        k = F.col("s_suppkey").cast("long")
        return self.base("supplier").select(k.alias("qid"), F.col("s_nationkey").cast("double").alias("x"), F.round("s_acctbal", 2).alias("y"), (1 + k % 5).alias("k"))

    @cached_property
    def n_keys(self) -> int:
        return self.keys.count()

    @cached_property
    def request_keys(self) -> int:
        """Keys that requests draw from: a fifteenth more than the loaded ones, so that some miss."""
        return max(1, (int(self.key_range[1]) + 1) * 16 // 15)

    @cached_property
    def key_range(self) -> tuple[float, float]:
        low, high = self.keys.agg(F.min("key"), F.max("key")).first()
        return float(low or 0), float(high or 1)

    @cached_property
    def rect_range(self) -> tuple[float, float, float, float]:
        row = self.rects.agg(F.min("l"), F.max("r"), F.min("b"), F.max("t")).first()
        return tuple(float(v or 0) for v in row)

    @cached_property
    def cells_1d(self) -> DataFrame:
        from gridloom.operators.grid import cells_1d

        return cells_1d(self.spark, *self.key_range, CELLS)

    @cached_property
    def cells_2d(self) -> DataFrame:
        from gridloom.operators.grid import cells_2d

        return cells_2d(self.spark, *self.rect_range, SIDE, SIDE)

    @cached_property
    def placement(self) -> DataFrame:
        numa = F.col("id") % 8
        return self.spark.range(CELLS).select(
            F.col("id").alias("cid"), numa.alias("numa"), (numa * 12 + 3 + F.floor(F.col("id") / 8) % 7).alias("cpu")
        )

    @cached_property
    def requests(self) -> DataFrame:
        id_ = F.col("event_id").cast("long")
        op = F.create_map(*(F.lit(x) for x in ("view", "READ", "click", "SCAN", "purchase", "INSERT", "signup", "UPDATE", "error", "READMODIFYWRITE")))
        return self.base("events").select(
            id_.alias("req_id"), "ts", F.try_element_at(op, F.col("event_type")).alias("op"), F.pmod(id_ * 7919, F.lit(self.request_keys)).alias("key"),
            (1 + id_ % 100).alias("scan_len"), F.col("user_id").cast("long").alias("value"),
        )

    @cached_property
    def node_entries(self) -> DataFrame:
        """Groups of 51 rectangles by id, each one overfull node; a last short group is left out."""
        from gridloom.operators.splits import by_node

        full = F.count(F.lit(1)).over(self._node_window())
        e = self.rects.withColumn("node_id", F.floor(F.col("id") / 51).cast("long")).withColumn("ordinal", F.col("id") % 51)
        return by_node(e.drop("id"), self.base("events").count()).withColumn("_n", full).filter("_n = 51").select("node_id", "ordinal", "l", "r", "b", "t")

    @staticmethod
    def _node_window():
        from pyspark.sql import Window

        return Window.partitionBy("node_id")

    @cached_property
    def probes(self) -> DataFrame:
        """A rectangle for each node: its first entry, moved and grown."""
        first = self.node_entries.filter("ordinal = 0")
        return first.select("node_id", (F.col("l") + 2).alias("l"), (F.col("r") + 5).alias("r"), (F.col("b") + 1).alias("b"), (F.col("t") + 4).alias("t"))

    @cached_property
    def children(self) -> DataFrame:
        from gridloom.operators.splits import growth

        return growth(self.node_entries, self.probes)

    @cached_property
    def pmu(self) -> DataFrame:
        id_ = F.col("event_id").cast("long")
        c = lambda i: (1000 * (i + 1) + (id_ * (2 * i + 3)) % 977).cast("double")
        values = [c(i) for i in range(16)]
        values[4] = F.when(id_ % 97 == 0, F.lit(float("nan"))).when(id_ % 89 == 0, F.lit(None)).otherwise(values[4])
        return self.base("events").select(
            id_.alias("sample_id"), (F.col("user_id").cast("long") % 56).alias("worker"), (id_ % 256).alias("cell"),
            (F.floor(id_ / 1000)).cast("long").alias("slice"), *(v.alias(f"c{i}") for i, v in enumerate(values)),
        )

    @cached_property
    def latency(self) -> DataFrame:
        ns = F.round(F.col("value") * 1000).cast("long")
        return self.requests.select("req_id", "op").join(
            self.base("events").select(F.col("event_id").cast("long").alias("req_id"), (F.col("event_id") % 20 != 0).alias("ok"), ns.alias("ns")), "req_id"
        )

    @cached_property
    def stream(self) -> DataFrame:
        return self.base("events").select("ts", (F.col("event_id").cast("long") % 256).alias("cell"))


_OPS = "CASE event_type WHEN 'view' THEN 'READ' WHEN 'click' THEN 'SCAN' WHEN 'purchase' THEN 'INSERT' WHEN 'signup' THEN 'UPDATE' WHEN 'error' THEN 'READMODIFYWRITE' END"

_PMU = ", ".join(
    (
        f"CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE WHEN event_id % 89 = 0 THEN NULL ELSE {1000 * (i + 1)}.0 + (event_id * {2 * i + 3}) % 977 END AS c{i}"
        if i == 4
        else f"({1000 * (i + 1)} + (event_id::BIGINT * {2 * i + 3}) % 977)::DOUBLE AS c{i}"
    )
    for i in range(16)
)

CTE = {
    "keys": "SELECT o_orderkey::BIGINT AS key, o_custkey::BIGINT AS value FROM orders",
    "key_log": "SELECT (event_id::BIGINT * 7919) % 2000 AS key, user_id::BIGINT AS value, event_id::BIGINT AS seq FROM events",
    "rects": "SELECT event_id::BIGINT AS id, user_id::DOUBLE AS l, (user_id + event_id % 7)::DOUBLE AS r, floor(value)::DOUBLE AS b, floor(value)::DOUBLE + event_id % 5 AS t FROM events",
    "boxes": "SELECT p_partkey::BIGINT AS qid, p_size::DOUBLE AS l, (p_size + 1 + p_partkey % 9)::DOUBLE AS r, (p_partkey % 400)::DOUBLE AS b, (p_partkey % 400 + 1 + p_partkey % 6)::DOUBLE AS t FROM part",
    "points": "SELECT c_custkey::BIGINT AS id, c_nationkey::DOUBLE AS x, round(c_acctbal, 2) AS y FROM customer",
    "knn_queries": "SELECT s_suppkey::BIGINT AS qid, s_nationkey::DOUBLE AS x, round(s_acctbal, 2) AS y, (1 + s_suppkey % 5)::BIGINT AS k FROM supplier",
    "cells_1d": f"SELECT cid, low + cid * width AS lx, low + cid * width + width AS hx FROM (SELECT range AS cid FROM range({CELLS})), (SELECT min(key)::DOUBLE AS low, (max(key)::DOUBLE - min(key)::DOUBLE) / {CELLS} AS width FROM keys)",
    "cells_2d": f"SELECT cid, lowx + (cid // {SIDE}) * dx AS lx, lowx + (cid // {SIDE}) * dx + dx AS hx, lowy + (cid % {SIDE}) * dy AS ly, lowy + (cid % {SIDE}) * dy + dy AS hy FROM (SELECT range AS cid FROM range({CELLS})), (SELECT min(l) AS lowx, (max(r) - min(l)) / {SIDE} AS dx, min(b) AS lowy, (max(t) - min(b)) / {SIDE} AS dy FROM rects)",
    "placement": f"SELECT range AS cid, range % 8 AS numa, 12 * (range % 8) + 3 + (range // 8) % 7 AS cpu FROM range({CELLS})",
    "requests": f"SELECT event_id::BIGINT AS req_id, ts, {_OPS} AS op, (event_id::BIGINT * 7919) % (SELECT ((max(key) + 1) * 16) // 15 FROM keys) AS key, (1 + event_id % 100)::BIGINT AS scan_len, user_id::BIGINT AS value FROM events",
    "node_entries": "SELECT id // 51 AS node_id, id % 51 AS ordinal, l, r, b, t FROM rects QUALIFY count(*) OVER (PARTITION BY id // 51) = 51",
    "probes": "SELECT node_id, l + 2 AS l, r + 5 AS r, b + 1 AS b, t + 4 AS t FROM node_entries WHERE ordinal = 0",
    "pmu": f"SELECT event_id::BIGINT AS sample_id, user_id::BIGINT % 56 AS worker, event_id::BIGINT % 256 AS cell, event_id::BIGINT // 1000 AS slice, {_PMU} FROM events",
    "latency": f"SELECT event_id::BIGINT AS req_id, {_OPS} AS op, event_id % 20 <> 0 AS ok, round(value * 1000)::BIGINT AS ns FROM events",
    "stream": "SELECT ts, event_id::BIGINT % 256 AS cell FROM events",
    "key_cells": "SELECT k.*, c.cid FROM keys k JOIN cells_1d c ON c.lx <= k.key AND c.hx >= k.key",
    "request_cells": "SELECT q.*, c.cid FROM requests q JOIN cells_1d c ON c.lx <= q.key AND c.hx >= q.key",
    "rect_cells": "SELECT q.id, c.cid FROM rects q JOIN cells_2d c ON q.l <= c.hx AND c.lx <= q.r AND q.b <= c.hy AND c.ly <= q.t",
}
_NEEDS = {
    "requests": ["keys"], "cells_1d": ["keys"], "cells_2d": ["rects"], "node_entries": ["rects"], "probes": ["node_entries"], "key_cells": ["keys", "cells_1d"],
    "request_cells": ["requests", "cells_1d"], "rect_cells": ["rects", "cells_2d"],
}


def with_tables(body: str, *names: str, **more: str) -> str:
    """SQL with the common table expressions it needs, in order; ``more`` are further ones, which may use the others."""
    found: dict[str, str] = {}

    def add(name: str) -> None:
        for n in _NEEDS.get(name, ()):
            add(n)
        found.setdefault(name, CTE[name])

    for name in names:
        add(name)
    found |= more
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in found.items()) + " " + body


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of Tables under its name, with the SQL it must agree with."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register
