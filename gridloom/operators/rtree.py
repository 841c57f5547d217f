"""Trees of bounding rectangles as tables, and the questions asked of them.

A tree is bulk loaded by sort-tile-recursion and held as ``nodes`` (level, node_id, parent_id, l, r, b, t, n_entries) and
``entries`` (id, leaf). It is not the tree that single insertions would give; answers to queries don't depend on that.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geometry import Rect, area, contains, intersects_closed, overlaps_open, rect
from gridloom.operators.ranking import global_rank
from gridloom.sources.shared import written

MAX_ENTRIES, MIN_ENTRIES = 50, 20
#: Objects of a cell of the finest grid, and levels at most: 4^MOST_LEVELS cells.
OBJECTS_PER_CELL, MOST_LEVELS = 16, 20


def _mbr(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.min("l").alias("l"),
        F.max("r").alias("r"),
        F.min("b").alias("b"),
        F.max("t").alias("t"),
        F.count(F.lit(1)).alias("n_entries"),
    )


def _tile(df: DataFrame, n: int, capacity: int) -> DataFrame:
    """df (id, l, r, b, t) with node_id: vertical slices by (l, b, id), cut into runs of capacity by (b, l, id)."""
    slice_rows = math.ceil(math.sqrt(math.ceil(n / capacity))) * capacity
    ranked = global_rank(df, "l", ["b", "id"], "_rank").withColumn("_slice", F.floor((F.col("_rank") - 1) / slice_rows))
    within = F.row_number().over(Window.partitionBy("_slice").orderBy("b", "l", "id"))
    per_slice = slice_rows // capacity
    return ranked.withColumn("node_id", (F.col("_slice") * per_slice + F.floor((within - 1) / capacity)).cast("long")).drop(
        "_rank", "_slice"
    )


def bulk_load(rects: DataFrame, capacity: int = MAX_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """(nodes, entries) of rectangles (id, l, r, b, t). Level 0 are the leaves; each level is ``capacity`` times smaller
    and written once, as the ones above are made from it."""
    entries = written(_tile(rects, rects.count(), capacity), "entries")
    level, nodes, below = 0, None, written(_mbr(entries, ["node_id"]), "level")
    while True:
        n = below.count()
        tiled = written(_tile(below.withColumnRenamed("node_id", "id"), n, capacity), "level") if n > 1 else None
        parent = F.lit(None).cast("long") if tiled is None else F.col("node_id")
        own = (below.withColumnRenamed("node_id", "id") if tiled is None else tiled).select(
            F.lit(level).alias("level"), F.col("id").alias("node_id"), parent.alias("parent_id"), "l", "r", "b", "t", "n_entries"
        )
        nodes = own if nodes is None else nodes.unionByName(own)
        if tiled is None:
            return nodes, entries.select("id", F.col("node_id").alias("leaf"), "l", "r", "b", "t")
        below, level = written(_mbr(tiled.drop("n_entries"), ["node_id"]), "level"), level + 1


@dataclass(frozen=True)
class Grid:
    """Cells of sizes that double from level to level; the top level is one cell. The finest has about OBJECTS_PER_CELL
    objects in a cell if they are spread evenly. Objects reach to high_x and high_y, the top cell may reach further."""

    low_x: float
    low_y: float
    width: float
    height: float
    top: int
    high_x: float
    high_y: float

    def size(self, level) -> tuple[Column, Column]:
        parts = F.pow(F.lit(2.0), level - self.top)
        return F.lit(self.width) * parts, F.lit(self.height) * parts

    def at(self, x: Column, y: Column, level: Column) -> tuple[Column, Column]:
        """The cell of a point, which is moved to the nearest cell if it lies outside."""
        dx, dy = self.size(level)
        last = F.pow(F.lit(2.0), F.lit(self.top) - level) - 1
        within = lambda v: F.least(F.greatest(F.floor(v), F.lit(0)), last).cast("long")
        return within((x - self.low_x) / dx), within((y - self.low_y) / dy)

    def own_level(self, low_x: Column, high_x: Column, low_y: Column, high_y: Column) -> Column:
        """The finest level of which a rectangle is no larger than a cell, so that it touches at most four."""
        finest = 2.0**-self.top
        ratio = F.greatest((high_x - low_x) / (self.width * finest), (high_y - low_y) / (self.height * finest), F.lit(1.0))
        return F.least(F.ceil(F.log2(ratio)), F.lit(self.top)).cast("int")


def grid_of(objects: DataFrame, aspect: float | None = None) -> Grid:
    """A grid for objects (l, r, b, t); ``aspect`` is the width of a cell over its height, else that of the extent."""
    row = objects.agg(F.min("l"), F.max("r"), F.min("b"), F.max("t"), F.count(F.lit(1))).first()
    low_x, high_x, low_y, high_y = (0.0 if v is None else float(v) for v in row[:4])
    wide, high = max(high_x - low_x, 1e-9), max(high_y - low_y, 1e-9)
    width, height = (wide, high) if aspect is None else (max(wide, high * aspect), max(high, wide / aspect))
    cells = lambda top: math.ceil(2**top * wide / width) * math.ceil(2**top * high / height)
    top = next((x for x in range(MOST_LEVELS) if cells(x) * OBJECTS_PER_CELL >= row[4]), MOST_LEVELS)
    return Grid(low_x, low_y, width, height, top, high_x, high_y)


def _tasks(df: DataFrame) -> int:
    """Tasks for small tables from which many rows are made; Spark would give them one."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def _levelled(df: DataFrame, grid: Grid) -> DataFrame:
    return df.withColumn("_own", grid.own_level(F.col("l"), F.col("r"), F.col("b"), F.col("t")))


def _cover(df: DataFrame, grid: Grid, others: list[int], name: str) -> DataFrame:
    """df with the cells (_level, _x, _y) that each rectangle touches at its own level and at each coarser one that the
    other side has; ``name`` tells whether the level is its own."""
    levels = F.filter(F.array(*(F.lit(x) for x in others)).cast("array<int>"), lambda x: x > F.col("_own"))
    out = df.withColumn("_level", F.explode(F.concat(F.array("_own"), levels)))
    level = F.col("_level")
    (x0, y0), (x1, y1) = grid.at(F.col("l"), F.col("b"), level), grid.at(F.col("r"), F.col("t"), level)
    out = out.withColumn("_x", F.explode(F.sequence(x0, x1))).withColumn("_y", F.explode(F.sequence(y0, y1)))
    return out.withColumn(name, F.col("_level") == F.col("_own")).drop("_own")


def extent(df: DataFrame) -> tuple[float, float, float, float]:
    row = df.agg(F.min("l"), F.max("r"), F.min("b"), F.max("t")).first()
    return tuple(0.0 if v is None else float(v) for v in row)


def overlap_pairs(boxes: DataFrame, objects: DataFrame, predicate=overlaps_open) -> DataFrame:
    """Pairs of boxes (qid, l, r, b, t) and objects (l, r, b, t, ...) that satisfy ``predicate``.

    Both sides meet in grid cells of the larger one's size, an equality join. A rectangle of any size touches at most
    four cells at each level, so large ones don't multiply; a pair is taken in the cell of its common low corner only.
    Cells have the shape of an average box with an average object around it, so that few pairs of a cell don't meet.
    """
    grid = grid_of(objects, _aspect(boxes, objects))
    q = _levelled(boxes.select("qid", *(F.col(c).alias(f"q_{c}") for c in "lrbt"), "l", "r", "b", "t"), grid)
    o = _levelled(objects, grid)
    levels = lambda df: sorted(r[0] for r in df.select("_own").distinct().collect() if r[0] is not None)
    left = _cover(q, grid, levels(o), "_q_own").drop("l", "r", "b", "t")
    right = _cover(o, grid, levels(q), "_o_own")
    x, y = grid.at(F.greatest("l", "q_l"), F.greatest("b", "q_b"), F.col("_level"))
    home = (F.col("_q_own") | F.col("_o_own")) & (F.col("_x") == x) & (F.col("_y") == y)
    pairs = left.join(right, ["_level", "_x", "_y"]).filter(home & predicate(rect(), rect("q_")))
    return pairs.drop("_level", "_x", "_y", "_q_own", "_o_own")


def _aspect(boxes: DataFrame, objects: DataFrame) -> float | None:
    means = [df.agg(F.avg(F.col("r") - F.col("l")), F.avg(F.col("t") - F.col("b"))).first() for df in (boxes, objects)]
    wide, high = (sum(m[i] or 0.0 for m in means) for i in (0, 1))
    return wide / high if wide > 0 and high > 0 and math.isfinite(wide / high) else None


def _counts(boxes: DataFrame, objects: DataFrame, predicate) -> DataFrame:
    """(qid, n): objects of each box. Equal boxes are asked once and equal objects met once, with their number, so pairs
    follow the different rectangles; objects beyond all boxes don't take part. ``predicate`` implies that both touch."""
    low_x, high_x, low_y, high_y = extent(boxes)
    around = Rect(*(F.lit(v) for v in (low_x, high_x, low_y, high_y)))
    met = objects.filter(intersects_closed(rect(), around)).groupBy("l", "r", "b", "t").agg(F.count(F.lit(1)).alias("_times"))
    met = written(met.repartition(_tasks(met)), "objects")
    asked = written(boxes.select(F.lit(0).alias("qid"), "l", "r", "b", "t").distinct().repartition(_tasks(boxes)), "boxes")
    sides = [f"q_{c}" for c in "lrbt"]
    counted = overlap_pairs(asked, met, predicate).groupBy(*sides).agg(F.sum("_times").alias("n"))
    found = boxes.select("qid", *(F.col(c).alias(f"q_{c}") for c in "lrbt")).join(counted, sides, "left")
    return found.groupBy("qid").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def contains_count(boxes: DataFrame, objects: DataFrame) -> DataFrame:
    """(qid, n): objects that contain each box. A box that does not overlap the root strictly counts 0."""
    low_x, high_x, low_y, high_y = extent(objects)
    root = Rect(*(F.lit(v) for v in (low_x, high_x, low_y, high_y)))
    return _counts(boxes, objects, lambda a, q: contains(a, q) & overlaps_open(root, q))


def overlap_count(boxes: DataFrame, objects: DataFrame, predicate=overlaps_open) -> DataFrame:
    return _counts(boxes, objects, predicate)


def range_counts(boxes: DataFrame, objects: DataFrame, storages: dict) -> DataFrame:
    """(storage, qid, n): every box asked of every storage, which differ in the predicate they answer by."""
    out = None
    for name, predicate in storages.items():
        part = overlap_count(boxes, objects, predicate).withColumn("storage", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("storage", "qid", "n")


def node_accesses(boxes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, n): nodes a range query visits. A node lies in its parent, so the visited ones are those that overlap."""
    return _counts(boxes, nodes.select("level", "node_id", "l", "r", "b", "t"), overlaps_open)


def nearest(queries: DataFrame, points: DataFrame) -> DataFrame:
    """(qid, rank, id, dist): the k nearest of points (id, x, y) to each query (qid, x, y, k), ties by id.

    Points are counted in the cells of all levels of a grid of square cells. Each query takes the finest level at which
    the nine cells around it hold k points; these lie within a distance of about three cells, and only points of the
    cells within that distance are compared. A query with fewer points around at every level takes all cells of the top
    level. Of points at one place no more than the largest k can be among the nearest, those with the smallest ids, and
    queries at one place are answered once; so repeated places don't multiply the comparisons.
    """
    most = queries.agg(F.max("k")).first()[0] or 0
    place = Window.partitionBy("x", "y").orderBy("id")
    points = points.select("id", "x", "y").withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= most)
    points = written(points.drop("_place").repartition(_tasks(points)), "points")
    asked = queries.select("qid", F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("k").alias("k"))
    boxes = points.select("id", "x", "y", *(F.col(c).alias(o) for c, o in (("x", "l"), ("x", "r"), ("y", "b"), ("y", "t"))))
    grid = grid_of(boxes, 1.0)
    every = F.explode(F.sequence(F.lit(0), F.lit(grid.top)))
    level, x, y = F.col("_level"), F.col("x"), F.col("y")

    def celled(df: DataFrame, x: Column, y: Column) -> DataFrame:
        at_x, at_y = grid.at(x, y, level)
        return df.withColumn("_x", at_x).withColumn("_y", at_y)

    # counts of a level are sums of those below, so the points are grouped once
    cells = celled(points.withColumn("_level", F.lit(0)), x, y).groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), level)).cast("long")
    cells = cells.withColumn("_level", every).groupBy("_level", up("_x").alias("_x"), up("_y").alias("_y")).agg(F.sum("_n").alias("_n"))
    q = asked.groupBy("qx", "qy").agg(F.max("k").alias("k")).repartition(_tasks(asked))
    around = celled(q.withColumn("_level", every), F.col("qx"), F.col("qy"))
    for c in ("_x", "_y"):
        around = around.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    held = around.join(cells, ["_level", "_x", "_y"]).groupBy("qx", "qy", "k", "_level").agg(F.sum("_n").alias("_n"))
    chosen = held.filter(F.col("_n") >= F.col("k")).groupBy("qx", "qy").agg(F.min("_level").alias("_level"))
    q = q.join(chosen, ["qx", "qy"], "left")
    few = level.isNull()
    q = q.withColumn("_few", few).withColumn("_level", F.coalesce(level, F.lit(grid.top)))
    # the nine cells' farthest corner, seen from the query, which may lie outside the grid
    at_x, at_y = grid.at(F.col("qx"), F.col("qy"), level)
    dx, dy = grid.size(level)
    far = lambda v, low, d, at: F.greatest(F.abs(v - (low + (at - 1) * d)), F.abs(low + (at + 2) * d - v))
    far_x, far_y = far(F.col("qx"), grid.low_x, dx, at_x), far(F.col("qy"), grid.low_y, dy, at_y)
    reach = F.sqrt(far_x * far_x + far_y * far_y) * (1 + 1e-9)
    q = q.withColumn("_reach", F.when(F.col("_few"), F.lit(grid.width + grid.height) + far_x + far_y).otherwise(reach))
    # no cell beyond the points is looked at
    within = lambda v, low, high: F.least(F.greatest(v, F.lit(low)), F.lit(high))
    in_x, in_y = (lambda v: within(v, grid.low_x, grid.high_x)), (lambda v: within(v, grid.low_y, grid.high_y))
    (x0, y0) = grid.at(in_x(F.col("qx") - F.col("_reach")), in_y(F.col("qy") - F.col("_reach")), level)
    (x1, y1) = grid.at(in_x(F.col("qx") + F.col("_reach")), in_y(F.col("qy") + F.col("_reach")), level)
    q = q.withColumn("_x", F.explode(F.sequence(x0, x1))).withColumn("_y", F.explode(F.sequence(y0, y1)))
    q = written(q.select("qx", "qy", "k", "_level", "_x", "_y"), "searched")
    used = [F.lit(r[0]) for r in q.select("_level").distinct().collect()] or [F.lit(0)]  # at most those of the grid
    placed = celled(points.withColumn("_level", F.explode(F.array(*used))), x, y)
    d = (x - F.col("qx")) * (x - F.col("qx")) + (y - F.col("qy")) * (y - F.col("qy"))
    order = Window.partitionBy("qx", "qy").orderBy("_d", "id")
    found = (
        q.join(placed, ["_level", "_x", "_y"])
        .select("qx", "qy", "id", d.alias("_d"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= most)
        .select("qx", "qy", "rank", "id", F.sqrt("_d").alias("dist"))
    )
    return asked.join(found, ["qx", "qy"]).filter(F.col("rank") <= F.col("k")).select("qid", "rank", "id", "dist")


def place_nodes(nodes: DataFrame, cells: DataFrame, placement: DataFrame, predicate=overlaps_open) -> DataFrame:
    """(level, node_id, numa): nodes that a placed cell (cid, lx, hx, ly, hy) overlaps; the cell with the highest id wins."""
    boxes = cells.select(F.col("cid").alias("qid"), F.col("lx").alias("l"), F.col("hx").alias("r"), F.col("ly").alias("b"), F.col("hy").alias("t"))
    pairs = overlap_pairs(boxes, nodes.select("level", "node_id", "l", "r", "b", "t"), predicate)
    owned = pairs.join(placement.select(F.col("cid").alias("qid"), "numa"), "qid")
    return owned.groupBy("level", "node_id").agg(F.max_by("numa", "qid").alias("numa"))


def tree_stats(nodes: DataFrame) -> DataFrame:
    """One row: nodes, height, average area and children, size in MB (36 bytes an object, 26 + 4 n a node)."""
    leaf_entries = F.sum(F.when(F.col("level") == 0, F.col("n_entries")).otherwise(0))
    size = leaf_entries * 36 + F.sum(26 + 4 * F.col("n_entries"))
    return nodes.agg(
        F.count(F.lit(1)).alias("n_nodes"),
        (F.max("level") + 1).cast("int").alias("height"),
        F.round(F.avg(area(rect())), 6).alias("avg_area"),
        F.round(F.avg("n_entries"), 6).alias("avg_children"),
        F.round(size / 1048576.0, 6).alias("size_mb"),
    )
