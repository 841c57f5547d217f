"""Grids over the key space or the plane: cells, membership, placement, routing and co-access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A grid is a parameter table: a join with it is broadcast up to this many cells and shuffled beyond.
MAX_BROADCAST_CELLS = 65_536


def linspace(a: float, b: float, n: int, i: Column) -> Column:
    """The i-th of n points from a to b; the last one is b itself."""
    step = (b - a) / (n - 1)
    return F.when(i == n - 1, F.lit(float(b))).otherwise(F.lit(float(a)) + F.lit(step) * i)


def cells_1d(spark, low: float, high: float, n: int) -> DataFrame:
    """cid, lx, hx: n cells of equal width; hx is lx plus the width, not the next lx."""
    width = (high - low) / n
    lx = F.lit(float(low)) + F.col("cid") * F.lit(width)
    return spark.range(n).select(F.col("id").alias("cid")).select("cid", lx.alias("lx"), (lx + F.lit(width)).alias("hx"))


def cells_2d(spark, low_x: float, high_x: float, low_y: float, high_y: float, nx: int, ny: int) -> DataFrame:
    """cid = i * ny + j, lx, hx, ly, hy."""
    dx, dy = (high_x - low_x) / nx, (high_y - low_y) / ny
    cells = spark.range(nx * ny).select(
        F.col("id").alias("cid"), F.floor(F.col("id") / ny).alias("i"), (F.col("id") % ny).alias("j")
    )
    lx, ly = F.lit(float(low_x)) + F.col("i") * F.lit(dx), F.lit(float(low_y)) + F.col("j") * F.lit(dy)
    return cells.select("cid", lx.alias("lx"), (lx + F.lit(dx)).alias("hx"), ly.alias("ly"), (ly + F.lit(dy)).alias("hy"))


def _with_cells(df: DataFrame, cells: DataFrame, n: int) -> DataFrame:
    return df.join(F.broadcast(cells) if n <= MAX_BROADCAST_CELLS else cells, "cid")


def _candidates(value_low: Column, value_high: Column, low: float, width: float, n: int) -> Column:
    """Cell numbers that may hold an interval, one more on each side for rounding; empty if there are none."""
    first = F.greatest(F.floor((value_low - low) / width) - 1, F.lit(0))
    last = F.least(F.floor((value_high - low) / width) + 1, F.lit(n - 1))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def key_cells(df: DataFrame, cells: DataFrame, low: float, high: float, n: int, key: str = "key") -> DataFrame:
    """df with each cell (cid) that holds its key, both edges included, so that a key on an edge has two.

    Candidates follow from arithmetic and are then tested against the cells' own edges: an equality join in place of a
    comparison of every key with every cell. A key outside all cells has no row.
    """
    width = (high - low) / n
    near = df.withColumn("cid", F.explode(_candidates(F.col(key), F.col(key), low, width, n)))
    return _with_cells(near, cells, n).filter((F.col("lx") <= F.col(key)) & (F.col("hx") >= F.col(key))).drop("lx", "hx")


def rect_cells(df: DataFrame, cells: DataFrame, box: tuple[float, float, float, float], nx: int, ny: int) -> DataFrame:
    """df (l, r, b, t) with each cell it touches, edges included. box: low x, high x, low y, high y."""
    low_x, high_x, low_y, high_y = box
    dx, dy = (high_x - low_x) / nx, (high_y - low_y) / ny
    near = (
        df.withColumn("_i", F.explode(_candidates(F.col("l"), F.col("r"), low_x, dx, nx)))
        .withColumn("_j", F.explode(_candidates(F.col("b"), F.col("t"), low_y, dy, ny)))
        .withColumn("cid", F.col("_i") * ny + F.col("_j"))
        .drop("_i", "_j")
    )
    touching = (F.col("l") <= F.col("hx")) & (F.col("lx") <= F.col("r")) & (F.col("b") <= F.col("hy")) & (F.col("ly") <= F.col("t"))
    return _with_cells(near, cells, nx * ny).filter(touching).drop("lx", "hx", "ly", "hy")


def default_placement(cells: DataFrame, n_cells: int, n_cpus: int) -> DataFrame:
    """Runs of cells / cpus + 1 consecutive cells for each cpu."""
    return cells.withColumn("cpu", F.floor(F.col("cid") / (n_cells // n_cpus + 1)).cast("long"))


def cells_histogram(members: DataFrame) -> DataFrame:
    return members.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))


def routable(requests: DataFrame, members: DataFrame, on: str = "req_id") -> DataFrame:
    return requests.join(members.select(on).distinct(), on, "left_semi")


def unroutable(requests: DataFrame, members: DataFrame, on: str = "req_id") -> DataFrame:
    return requests.join(members.select(on).distinct(), on, "left_anti")


def choose_cell(members: DataFrame, on: str = "req_id") -> DataFrame:
    """One of the cells of each request, by a rule in place of a draw: its id modulo the number of cells, in order of cid."""
    cells = members.groupBy(on).agg(F.sort_array(F.collect_set("cid")).alias("cells"))
    return cells.select(on, F.element_at("cells", (F.pmod(F.col(on), F.size("cells")) + 1).cast("int")).alias("cid"))


def route(chosen: DataFrame, placement: DataFrame) -> DataFrame:
    """Requests with the cpu and node that own their cell; placement has a row for each cell."""
    return chosen.join(placement, "cid")


def co_access(members: DataFrame, on: str = "req_id") -> DataFrame:
    """(cell_a, cell_b, n): how often two cells are matched by one request, in the counting of the live matrix.

    Cells are in order. Each pair (p, c) with p before or at c, p not the last cell, counts once for (p, c) and once
    for (c, p), so the diagonal counts twice; requests with a single cell count nothing. Cells of one request are few.
    """
    cells = members.groupBy(on).agg(F.sort_array(F.collect_set("cid")).alias("cells")).filter(F.size("cells") > 1)
    at = cells.select(on, "cells", F.posexplode("cells").alias("p", "cell_p")).filter(F.col("p") < F.size("cells") - 1)
    pairs = at.select("cell_p", F.explode(F.slice("cells", F.col("p") + 1, F.size("cells"))).alias("cell_c"))
    counted = pairs.groupBy("cell_p", "cell_c").agg(F.count(F.lit(1)).alias("n"))
    both = counted.toDF("cell_a", "cell_b", "n").union(counted.select("cell_c", "cell_p", "n"))
    return both.groupBy("cell_a", "cell_b").agg(F.sum("n").alias("n"))


def priority_order(routed: DataFrame, stamp: str, seq: str) -> DataFrame:
    """Position of each request in its cpu's queue: highest stamp first, then in order of arrival."""
    return routed.withColumn("place", F.row_number().over(Window.partitionBy("cpu").orderBy(F.desc(stamp), seq)))


def linear_model(features: list[Column], coefficients: Column) -> Column:
    """Dot product of features with an array of coefficients."""
    total = F.lit(0.0)
    for i, f in enumerate(features):
        total = total + f * coefficients[i]
    return total


def matrix(cells: DataFrame, value: str, ny: int, transposed_by: int | None = None) -> DataFrame:
    """A grid as rows of columns: cell (i, j) is number ny * i + j, or transposed_by * j + i."""
    step = transposed_by or ny
    i, j = (F.col("cid") % step, F.floor(F.col("cid") / step)) if transposed_by else (F.floor(F.col("cid") / step), F.col("cid") % step)
    return cells.select(i.alias("i"), j.alias("j"), value).groupBy("i").pivot("j", list(range(ny))).agg(F.sum(value))


def long_views(cells: DataFrame, values: list[str]) -> DataFrame:
    """(view, cid, value): the named columns of cells, one below the other."""
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("view"), F.col(v).cast("long").alias("value")) for v in values))).alias("x")
    return cells.select("cid", each).select("x.view", "cid", "x.value")
