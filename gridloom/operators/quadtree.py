"""Quadtree placement by path digits, and what can be asked of it. Its predicates include the edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import Rect, intersects_closed, quadrant, rect
from gridloom.operators.rtree import overlap_count, overlap_pairs


def path(box: tuple[float, float, float, float], depth: int) -> Column:
    """The quadrant digits that lead to a rectangle's node: it goes down while it lies entirely in one quadrant."""
    low_x, high_x, low_y, high_y = (F.lit(float(v)) for v in box)
    state = F.struct(F.lit("").alias("path"), low_x.alias("x0"), high_x.alias("x1"), low_y.alias("y0"), high_y.alias("y1"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        mx, my = (s["x0"] + s["x1"]) / 2, (s["y0"] + s["y1"]) / 2
        digit = quadrant(Rect(F.col("l"), F.col("r"), F.col("b"), F.col("t")), mx, my)
        down = ~s["done"] & digit.isNotNull()
        right, high = digit.isin(0, 3), digit.isin(2, 3)
        return F.struct(
            F.when(down, F.concat(s["path"], digit.cast("string"))).otherwise(s["path"]).alias("path"),
            F.when(down & right, mx).otherwise(s["x0"]).alias("x0"),
            F.when(down & ~right, mx).otherwise(s["x1"]).alias("x1"),
            F.when(down & high, my).otherwise(s["y0"]).alias("y0"),
            F.when(down & ~high, my).otherwise(s["y1"]).alias("y1"),
            (s["done"] | digit.isNull()).alias("done"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), state, step, lambda s: s["path"])


def build(objects: DataFrame, box: tuple[float, float, float, float], depth: int) -> DataFrame:
    return objects.withColumn("path", path(box, depth))


def objects_in_bound(boxes: DataFrame, objects: DataFrame) -> DataFrame:
    """(qid, n): objects that touch each box."""
    return overlap_count(boxes, objects, intersects_closed)


def totals(tree: DataFrame) -> DataFrame:
    """One row: nodes below the root (each divided node has four) and objects."""
    prefixes = tree.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda i: F.substring("path", F.lit(1), i))).alias("p"))
    divided = prefixes.filter(F.length("p") > 0).select(F.expr("substring(p, 1, length(p) - 1)").alias("parent")).distinct()
    return divided.agg((F.count(F.lit(1)) * 4).alias("n_children")).crossJoin(tree.agg(F.count(F.lit(1)).alias("n_objects")))


def remove(objects: DataFrame, ids: DataFrame) -> DataFrame:
    return objects.join(ids.select("id"), "id", "left_anti")


def update(objects: DataFrame, moved: DataFrame) -> DataFrame:
    """Objects with new rectangles for the ids in ``moved``, which has the same columns."""
    return remove(objects, moved).unionByName(moved.select(objects.columns))


def place_objects(objects: DataFrame, cells: DataFrame, placement: DataFrame) -> DataFrame:
    """(id, numa): the node of the highest placed cell that an object touches."""
    boxes = cells.select(F.col("cid").alias("qid"), F.col("lx").alias("l"), F.col("hx").alias("r"), F.col("ly").alias("b"), F.col("hy").alias("t"))
    pairs = overlap_pairs(boxes, objects, intersects_closed)
    owned = pairs.join(placement.select(F.col("cid").alias("qid"), "numa"), "qid")
    return owned.groupBy("id").agg(F.max_by("numa", "qid").alias("numa"))


__all__ = ["build", "objects_in_bound", "path", "place_objects", "rect", "remove", "totals", "update"]
