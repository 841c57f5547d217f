"""Choosing a child for a rectangle and splitting overfull nodes, for all nodes of a table at once.

``entries`` has node_id, ordinal, l, r, b, t. A split position idx puts the first idx + 1 entries of an order on one side
and the rest on the other; prefix and suffix rectangles are running windows over the order.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geometry import (
    Rect,
    area,
    contains,
    overlap_area,
    overlap_growth,
    overlap_perimeter,
    perimeter,
    rect,
    union,
)

MAX_ENTRIES, MIN_ENTRIES = 50, 20
#: Entries of the nodes of one task.
ROWS_PER_TASK = 1 << 17
#: Sort keys of the total orders.
ORDERS = {"left": "lrbt", "right": "rlbt", "bottom": "btlr", "top": "tblr"}


def by_node(df: DataFrame, rows: int) -> DataFrame:
    """df with the rows of a node in one task, in as many tasks as ``rows``, its number of rows, asks for. What follows
    by node takes these tasks as they are, so that no task's memory grows with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)), "node_id")


def split_candidates(
    entries: DataFrame, orders: list[str], max_entries: int = MAX_ENTRIES, min_entries: int = MIN_ENTRIES
) -> DataFrame:
    """node_id, ord (position in ``orders``), idx, both sides' rectangles (p_*, s_*) and area1, area2, perim1, perim2, overlap.

    Entries that come by node (``by_node``) are not shuffled again; each becomes a row an order there."""
    keys = F.array(
        *(F.struct(F.lit(i).alias("ord"), *(F.col(c).alias(f"_k{j}") for j, c in enumerate(ORDERS[o]))) for i, o in enumerate(orders))
    )
    parts = entries.select("node_id", "ordinal", "l", "r", "b", "t", F.explode(keys).alias("k")).select("node_id", "ordinal", "l", "r", "b", "t", "k.*")
    order = Window.partitionBy("node_id", "ord").orderBy("_k0", "_k1", "_k2", "_k3", "ordinal")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    sides = {}
    for c, f in zip("lrbt", (F.min, F.max, F.min, F.max), strict=True):
        sides[f"p_{c}"], sides[f"s_{c}"] = f(c).over(upto), f(c).over(after)
    found = parts.select("node_id", "ord", (F.row_number().over(order) - 1).alias("idx"), *(v.alias(k) for k, v in sides.items()))
    found = found.filter(F.col("idx").between(min_entries - 1, max_entries - min_entries))
    p, s = rect("p_"), rect("s_")
    return found.select(
        "*",
        area(p).alias("area1"),
        area(s).alias("area2"),
        perimeter(p).alias("perim1"),
        perimeter(s).alias("perim2"),
        overlap_area(p, s).alias("overlap"),
    )


def best_split(candidates: DataFrame, first: Column, second: Column, *more: str) -> DataFrame:
    """The split of each node with the least (first, second), ties to the earlier order and position; ``more`` are further
    columns of it."""
    mark = F.struct(first.alias("s1"), second.alias("s2"), F.col("ord"), F.col("idx"), *more)
    best = candidates.groupBy("node_id").agg(F.min(mark).alias("m"))
    return best.select("node_id", "m.ord", "m.idx", "m.s1", "m.s2", *(f"m.{c}" for c in more))


_sum = lambda a, b: F.col(a) + F.col(b)


def split_min_area(entries: DataFrame, *more: str) -> DataFrame:
    return best_split(split_candidates(entries, ["left", "right", "bottom", "top"]), _sum("area1", "area2"), F.col("overlap"), *more)


def split_min_margin(entries: DataFrame) -> DataFrame:
    return best_split(split_candidates(entries, ["left", "bottom"]), _sum("perim1", "perim2"), F.col("overlap"))


def split_min_overlap(entries: DataFrame) -> DataFrame:
    return best_split(split_candidates(entries, ["left", "right", "bottom", "top"]), F.col("overlap"), _sum("area1", "area2"))


# --- choosing a child --------------------------------------------------------------------------------------------


def with_probe(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """Each entry beside the rectangle (p_l, p_r, p_b, p_t) to be put into its node; probes has one row a node."""
    return entries.join(probes.select("node_id", *(F.col(c).alias(f"p_{c}") for c in "lrbt")), "node_id")


def growth(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """For each child: area, perim, its overlap with siblings, what each grows by with the probe, and whether it holds it."""
    own = with_probe(entries, probes)
    a, p = rect(), rect("p_")
    u = union(a, p)
    other = entries.select("node_id", F.col("ordinal").alias("o_ordinal"), *(F.col(c).alias(f"o_{c}") for c in "lrbt"))
    # siblings meet in their node, at most one node's entries
    pairs = own.join(other, "node_id").filter(F.col("ordinal") != F.col("o_ordinal"))
    sums = pairs.groupBy("node_id", "ordinal").agg(
        F.sum(overlap_area(a, rect("o_"))).alias("overlap"), F.sum(overlap_growth(a, rect("o_"), p)).alias("d_overlap")
    )
    return own.join(sums, ["node_id", "ordinal"]).select(
        "node_id",
        "ordinal",
        area(a).alias("area"),
        perimeter(a).alias("perim"),
        "overlap",
        (area(u) - area(a)).alias("d_area"),
        (perimeter(u) - perimeter(a)).alias("d_perim"),
        "d_overlap",
        contains(a, p).alias("holds"),
    )


def choose(children: DataFrame, *by: str) -> DataFrame:
    """(node_id, ordinal): the child with the least (by..., ordinal) of each node."""
    return children.groupBy("node_id").agg(F.min(F.struct(*by, "ordinal")).alias("m")).select("node_id", "m.ordinal")


def choose_random(entries: DataFrame, draw: Column) -> DataFrame:
    """A child by ``draw`` modulo the number of children."""
    sizes = entries.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("node_id", F.pmod(draw, F.col("n")).cast("long").alias("ordinal"))


def containing_child(children: DataFrame) -> DataFrame:
    """(node_id, ordinal): the smallest child that holds the probe, -1 if none does."""
    found = F.min(F.when(F.col("holds"), F.struct("area", "ordinal")))
    return children.groupBy("node_id").agg(F.coalesce(found["ordinal"], F.lit(-1)).cast("long").alias("ordinal"))


def enlarged_children(children: DataFrame) -> DataFrame:
    return children.groupBy("node_id").agg(F.count_if(~F.col("holds")).alias("n"))


def choose_covering(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """The RR* choice: the smallest child that holds the probe; else children in order of growing perimeter, cut off
    where the overlap perimeter with the first grows most, and of these the first one that adds no overlap area or the
    one that adds least. Nodes without a holding child are few rows each and go through a small function."""
    children = growth(entries, probes)
    held = containing_child(children)
    open_ = with_probe(entries, probes).join(held.filter("ordinal < 0").select("node_id"), "node_id", "left_semi")

    def cover(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.to_dict("records")
        box = lambda r, k="": (r[f"{k}l"], r[f"{k}r"], r[f"{k}b"], r[f"{k}t"])
        probe = box(rows[0], "p_")
        join = lambda x, y: (min(x[0], y[0]), max(x[1], y[1]), min(x[2], y[2]), max(x[3], y[3]))
        perim = lambda x: 2 * (x[3] - x[2] + x[1] - x[0])

        def common(x, y, measure):
            z = (max(x[0], y[0]), min(x[1], y[1]), max(x[2], y[2]), min(x[3], y[3]))
            return measure(z) if z[0] < z[1] and z[2] < z[3] else 0.0

        size = lambda x: (x[3] - x[2]) * (x[1] - x[0])
        rows.sort(key=lambda r: (perim(join(box(r), probe)) - perim(box(r)), r["ordinal"]))
        boxes = [box(r) for r in rows]
        adds = lambda t, j, m: common(join(boxes[t], probe), boxes[j], m) - common(boxes[t], boxes[j], m)
        with_first = [adds(0, j, perim) if j else 0.0 for j in range(len(boxes))]
        pick = 0
        if any(with_first):
            last = max(range(1, len(boxes)), key=lambda j: (with_first[j], -j))
            areas = []
            for t in range(last + 1):
                areas.append(sum(adds(t, j, size) for j in range(last + 1) if j != t))
                if areas[-1] == 0:
                    break
            pick = len(areas) - 1 if areas[-1] == 0 else min(range(len(areas)), key=lambda t: (areas[t], t))
        return pd.DataFrame({"node_id": [rows[0]["node_id"]], "ordinal": [rows[pick]["ordinal"]]})

    rest = open_.groupBy("node_id").applyInPandas(cover, "node_id long, ordinal long")
    return held.filter("ordinal >= 0").unionByName(rest)


# --- splits by seeds ---------------------------------------------------------------------------------------------


def seeds(entries: DataFrame) -> DataFrame:
    """(node_id, seed1, seed2): the pair whose common rectangle wastes most area, the first such pair."""
    a, o = rect(), rect("o_")
    other = entries.select("node_id", F.col("ordinal").alias("o_ordinal"), *(F.col(c).alias(f"o_{c}") for c in "lrbt"))
    pairs = entries.join(other, "node_id").filter(F.col("ordinal") < F.col("o_ordinal"))
    waste = area(union(a, o)) - area(a) - area(o)
    best = pairs.groupBy("node_id").agg(F.min(F.struct((-waste).alias("w"), "ordinal", "o_ordinal")).alias("m"))
    return best.select("node_id", F.col("m.ordinal").alias("seed1"), F.col("m.o_ordinal").alias("seed2"))


def quadratic_split(entries: DataFrame, min_entries: int = MIN_ENTRIES) -> DataFrame:
    """(node_id, ordinal, side): each entry goes to the group whose rectangle stays smaller with it, the entry with the
    largest difference first; a group that needs all that is left gets it. Sequential, on one node's rows at a time."""

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        boxes = dict(zip(pdf["ordinal"], pdf[["l", "r", "b", "t"]].itertuples(index=False, name=None), strict=True))
        first, second = int(pdf["seed1"].iloc[0]), int(pdf["seed2"].iloc[0])
        join = lambda x, y: (min(x[0], y[0]), max(x[1], y[1]), min(x[2], y[2]), max(x[3], y[3]))
        size = lambda x: (x[3] - x[2]) * (x[1] - x[0])
        groups, hull = ([first], [second]), [boxes[first], boxes[second]]
        left = [o for o in boxes if o not in (first, second)]
        while left:
            short = [s for s in (0, 1) if len(left) + len(groups[s]) == min_entries]
            if short:
                groups[short[0]].extend(left)
                break
            grown = {o: (size(join(hull[0], boxes[o])), size(join(hull[1], boxes[o]))) for o in left}
            chosen = max(left, key=lambda o: abs(grown[o][0] - grown[o][1]))
            left.remove(chosen)
            a, b = grown[chosen]
            side = 0 if a < b or a == b and len(groups[0]) < len(groups[1]) else 1
            groups[side].append(chosen)
            hull[side] = join(hull[side], boxes[chosen])
        node = pdf["node_id"].iloc[0]
        return pd.DataFrame([(node, o, s + 1) for s in (0, 1) for o in groups[s]], columns=["node_id", "ordinal", "side"])

    return (
        entries.join(seeds(entries), "node_id").groupBy("node_id").applyInPandas(assign, "node_id long, ordinal long, side int")
    )


def greene_split(entries: DataFrame) -> DataFrame:
    """(node_id, ordinal, side): halves along the axis in which the seeds are farther apart relative to the node; the
    middle one of an odd number goes to the side whose area grows less, side 2 at a tie."""
    hull = entries.groupBy("node_id").agg(
        F.min("l").alias("nl"), F.max("r").alias("nr"), F.min("b").alias("nb"), F.max("t").alias("nt"), F.count(F.lit(1)).alias("n")
    )
    s = seeds(entries)
    end = lambda k: entries.select("node_id", F.col("ordinal").alias(f"seed{k}"), *(F.col(c).alias(f"s{k}_{c}") for c in "lrbt"))
    s = s.join(end(1), ["node_id", "seed1"]).join(end(2), ["node_id", "seed2"])
    gap = lambda lo, hi: F.abs(F.least(f"s1_{hi}", f"s2_{hi}") - F.greatest(f"s1_{lo}", f"s2_{lo}"))
    x = F.try_divide(gap("l", "r"), F.col("nr") - F.col("nl"))
    y = F.try_divide(gap("b", "t"), F.col("nt") - F.col("nb"))
    axis = s.join(hull, "node_id").select("node_id", "n", F.when(x < y, "b").otherwise("l").alias("axis"))
    both = entries.join(axis, "node_id")
    pick = lambda b, l: F.when(F.col("axis") == "b", F.col(b)).otherwise(F.col(l))
    order = Window.partitionBy("node_id").orderBy(pick("b", "l"), pick("t", "r"), pick("l", "b"), pick("r", "t"), "ordinal")
    placed = both.withColumn("pos", F.row_number().over(order)).withColumn("half", F.floor(F.col("n") / 2))
    side = F.when(F.col("pos") <= F.col("half"), 1).when(F.col("pos") > F.col("n") - F.col("half"), 2).otherwise(0)
    placed = placed.withColumn("side", side)
    node = Window.partitionBy("node_id")
    of = lambda k, f, c: f(F.when(F.col("side") == k, F.col(c))).over(node)
    hulls = [Rect(of(k, F.min, "l"), of(k, F.max, "r"), of(k, F.min, "b"), of(k, F.max, "t")) for k in (1, 2)]
    grows = [area(union(h, rect())) - area(h) for h in hulls]
    middle = F.when(grows[0] < grows[1], 1).otherwise(2)
    return placed.select("node_id", "ordinal", F.when(F.col("side") == 0, middle).otherwise(F.col("side")).cast("int").alias("side"))


def rr_split(entries: DataFrame, origins: DataFrame, s: float = 0.5, max_entries: int = MAX_ENTRIES, min_entries: int = MIN_ENTRIES) -> DataFrame:
    """The RR* split: (node_id, dim, idx, score). origins: node_id, ox, oy, the node's centre when it was made.

    The axis with the smaller sum of perimeters; on it the position with the least weighted overlap or perimeter, the
    weight falling off from where the node has grown to.
    """
    cand = split_candidates(entries, ["left", "bottom"], max_entries, min_entries)
    sums = cand.groupBy("node_id").agg(
        *(F.sum(F.when(F.col("ord") == d, F.col("perim1") + F.col("perim2"))).alias(f"sum{d}") for d in (0, 1))
    )
    hull = entries.groupBy("node_id").agg(F.min("l").alias("nl"), F.max("r").alias("nr"), F.min("b").alias("nb"), F.max("t").alias("nt"))
    w, h = F.col("nr") - F.col("nl"), F.col("nt") - F.col("nb")
    dim = F.when(F.col("sum0") < F.col("sum1"), 0).otherwise(1)
    shift = F.when(dim == 0, F.try_divide((F.col("nr") + F.col("nl")) / 2 - F.col("ox"), w)).otherwise(
        F.try_divide((F.col("nt") + F.col("nb")) / 2 - F.col("oy"), h)
    )
    mean = (1 - 2.0 * min_entries / (max_entries + 1)) * 2 * F.coalesce(shift, F.lit(0.0))
    node = sums.join(hull, "node_id").join(origins, "node_id").select(
        "node_id", dim.alias("dim"), mean.alias("mean"), (2 * (w + h) - F.least(w, h)).alias("perim_max")
    )
    y1 = math.exp(-1 / s / s)
    x = 2.0 * F.col("idx") / (max_entries + 1) - 1
    spread = s * (1 + F.abs("mean"))
    weight = (F.exp(-((x - F.col("mean")) / spread) * ((x - F.col("mean")) / spread)) - y1) / (1 - y1)
    score = F.when(F.col("overlap") > 0, F.col("overlap") / weight).otherwise(
        (F.col("perim1") + F.col("perim2") - F.col("perim_max")) * weight
    )
    scored = cand.join(node, "node_id").filter(F.col("ord") == F.col("dim")).select("node_id", "dim", "idx", F.round(score, 6).alias("score"))
    best = scored.groupBy("node_id", "dim").agg(F.min(F.struct("score", "idx")).alias("m"))
    return best.select("node_id", "dim", "m.idx", "m.score")


def reinsert(entries: DataFrame, share: float = 0.3) -> DataFrame:
    """(node_id, ordinal): the ceil(share * n) entries whose centres are farthest from the node's centre."""
    node = Window.partitionBy("node_id")
    cx = (F.min("l").over(node) + F.max("r").over(node)) / 2
    cy = (F.min("b").over(node) + F.max("t").over(node)) / 2
    dx, dy = (F.col("l") + F.col("r")) / 2 - cx, (F.col("b") + F.col("t")) / 2 - cy
    far = entries.select("node_id", "ordinal", (dx * dx + dy * dy).alias("d"), F.count(F.lit(1)).over(node).alias("n"))
    place = F.row_number().over(node.orderBy(F.desc("d"), "ordinal"))
    return far.withColumn("place", place).filter(F.col("place") <= F.ceil(share * F.col("n"))).select("node_id", "ordinal")


# --- features ----------------------------------------------------------------------------------------------------


def split_table(entries: DataFrame) -> DataFrame:
    """node_id, dim, location and, for each split by left and bottom: perims and areas (larger, smaller) and overlap."""
    c = split_candidates(entries, ["left", "bottom"])
    return c.select(
        "node_id",
        F.col("ord").alias("dim"),
        F.col("idx").alias("location"),
        F.greatest("perim1", "perim2").alias("perim_max"),
        F.least("perim1", "perim2").alias("perim_min"),
        F.greatest("area1", "area2").alias("area_max"),
        F.least("area1", "area2").alias("area_min"),
        "overlap",
    )


def by_total_perimeter(table: DataFrame) -> DataFrame:
    """The split table with each split's place in ascending order of the sum of perimeters."""
    order = Window.partitionBy("node_id").orderBy(F.col("perim_max") + F.col("perim_min"), "dim", "location")
    return table.withColumn("place", F.row_number().over(order))


def scaled(df: DataFrame, groups: dict[str, list[str]], pad: float, by: str = "node_id") -> DataFrame:
    """Columns brought to (x - min) / (max - min + pad), with one range for each group of columns of a node."""
    node = Window.partitionBy(by)
    out = {}
    for columns in groups.values():
        low = F.least(*(F.min(c).over(node) for c in columns)) if len(columns) > 1 else F.min(columns[0]).over(node)
        high = F.greatest(*(F.max(c).over(node) for c in columns)) if len(columns) > 1 else F.max(columns[0]).over(node)
        for c in columns:
            out[c] = F.round((F.col(c) - low) / (high - low + pad), 6)
    return df.withColumns(out)


def short_split_features(entries: DataFrame) -> DataFrame:
    """Areas, perimeters and overlap of each split by left, scaled over the node's splits."""
    c = split_candidates(entries, ["left"]).select("node_id", "idx", "area1", "area2", "perim1", "perim2", "overlap")
    return scaled(c, {"area": ["area1", "area2"], "perim": ["perim1", "perim2"], "overlap": ["overlap"]}, 0.01)


def zero_overlap_features(entries: DataFrame, top: int = 2) -> DataFrame:
    """The ``top`` splits without overlap and with the least larger perimeter, scaled; fewer where fewer exist."""
    order = Window.partitionBy("node_id").orderBy("perim_max", "dim", "location")
    best = split_table(entries).filter("overlap = 0").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    return scaled(best, {"area": ["area_max", "area_min"], "perim": ["perim_max", "perim_min"]}, 0.1)


def insert_features(children: DataFrame, pad: float = 0.001) -> DataFrame:
    """Growth of each child by the probe, each divided by the node's largest (0 at least) plus ``pad``."""
    node = Window.partitionBy("node_id")
    out = {
        f"f_{c[2:]}": F.round(F.col(c) / (F.greatest(F.max(c).over(node), F.lit(0.0)) + pad), 6)
        for c in ("d_area", "d_perim", "d_overlap")
    }
    return children.withColumns(out).select("node_id", "ordinal", *out)


def raw_insert_features(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """Position, extents, aspect (null for no width), area and growth of each child."""
    size = entries.select(
        "node_id", "ordinal", F.col("l").alias("x"), F.col("b").alias("y"), (F.col("r") - F.col("l")).alias("w"), (F.col("t") - F.col("b")).alias("h")
    ).withColumn("aspect", F.round(F.try_divide(F.col("h"), F.col("w")), 6))
    return size.join(growth(entries, probes).select("node_id", "ordinal", "area", "d_area", "d_perim", "d_overlap"), ["node_id", "ordinal"])


def sorted_insert_features(children: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` children by growth of area, with growth of area, perimeter and overlap over the largest of these."""
    order = Window.partitionBy("node_id").orderBy("d_area", "ordinal")
    best = children.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    return insert_features(best).join(best.select("node_id", "ordinal", "place"), ["node_id", "ordinal"])


def split_costs(entries: DataFrame, chosen: DataFrame) -> DataFrame:
    """For a chosen split (node_id, area1, area2, perim1, perim2, overlap): sides' shares of the node's area and perimeter
    and of overlap."""
    hull = entries.groupBy("node_id").agg(F.min("l").alias("l"), F.max("r").alias("r"), F.min("b").alias("b"), F.max("t").alias("t"))
    total = hull.select("node_id", area(rect()).alias("na"), perimeter(rect()).alias("np"))
    share = lambda x, y: F.round(F.try_divide(F.col(x), F.col(y)), 6)
    return chosen.join(total, "node_id").select(
        "node_id", share("area1", "na").alias("area1"), share("area2", "na").alias("area2"), share("perim1", "np").alias("perim1"),
        share("perim2", "np").alias("perim2"), share("overlap", "na").alias("overlap"),
    )


def margins(entries: DataFrame, probes: DataFrame, other: DataFrame) -> DataFrame:
    """Growth of the overlap with one other rectangle a node, in perimeter and in area."""
    o = other.select("node_id", *(F.col(c).alias(f"o_{c}") for c in "lrbt"))
    both = with_probe(entries, probes).join(o, "node_id")
    a, p, x = rect(), rect("p_"), rect("o_")
    return both.select(
        "node_id", "ordinal", overlap_growth(a, x, p, overlap_perimeter).alias("d_perim"), overlap_growth(a, x, p).alias("d_area")
    )
