"""Rectangles, trees and quadtrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geometry as g
from gridloom.operators import quadtree, rtree
from gridloom.plans.tables import Tables, query, with_tables

_OPEN = "greatest(a.l, q.l) < least(a.r, q.r) AND greatest(a.b, q.b) < least(a.t, q.t)"
_CLOSED = "a.l <= q.r AND q.l <= a.r AND a.b <= q.t AND q.b <= a.t"
_HOLDS = "a.l <= q.l AND q.r <= a.r AND a.b <= q.b AND a.t >= q.t"
#: Each rectangle beside the one with the next id.
_PAIRS = "SELECT a.id, a.l, a.r, a.b, a.t, q.l AS ql, q.r AS qr, q.b AS qb, q.t AS qt FROM rects a JOIN rects q ON q.id = a.id + 1"
_P = {"pairs": _PAIRS}


def _pairs(t: Tables) -> DataFrame:
    other = t.rects.select((F.col("id") - 1).alias("id"), *(F.col(c).alias(f"q{c}") for c in "lrbt"))
    return t.rects.join(other, "id")


@query(with_tables("SELECT id, (t - b) * (r - l) AS area, 2.0 * (t - b + r - l) AS perimeter FROM rects", "rects"))
def r01_area_perimeter(t: Tables) -> DataFrame:
    a = g.rect()
    return t.rects.select("id", g.area(a).alias("area"), g.perimeter(a).alias("perimeter"))


@query(with_tables("SELECT id, r >= l AND t >= b AS valid FROM (SELECT id, l, r - 2 AS r, b, t - 1 AS t FROM rects)", "rects"))
def r02_is_valid(t: Tables) -> DataFrame:
    a = g.rect()
    return t.rects.select("id", g.is_valid(g.Rect(a.l, a.r - 2, a.b, a.t - 1)).alias("valid"))


@query(with_tables("SELECT id, l <= ql AND qr <= r AND b <= qb AND t >= qt AS holds FROM pairs", "rects", **_P))
def r03_contains(t: Tables) -> DataFrame:
    return _pairs(t).select("id", g.contains(g.rect(), g.rect("q")).alias("holds"))


@query(with_tables("SELECT id, greatest(l, ql) < least(r, qr) AND greatest(b, qb) < least(t, qt) AS overlaps FROM pairs", "rects", **_P))
def r04_overlaps(t: Tables) -> DataFrame:
    return _pairs(t).select("id", g.overlaps_open(g.rect(), g.rect("q")).alias("overlaps"))


@query(with_tables("""SELECT id, CASE WHEN ok THEN x0 END AS x0, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y0 END AS y0, CASE WHEN ok THEN y1 END AS y1
 FROM (SELECT id, x0, x1, y0, y1, x0 < x1 AND y0 < y1 AS ok FROM (SELECT id, greatest(l, ql) AS x0, least(r, qr) AS x1, greatest(b, qb) AS y0, least(t, qt) AS y1 FROM pairs))""", "rects", **_P))
def r05_overlap_rectangle(t: Tables) -> DataFrame:
    x = g.intersection(g.rect(), g.rect("q"))
    return _pairs(t).select("id", x.l.alias("x0"), x.r.alias("x1"), x.b.alias("y0"), x.t.alias("y1"))


@query(with_tables("SELECT id // 100 AS part, min(l) AS l, max(r) AS r, min(b) AS b, max(t) AS t FROM rects GROUP BY part", "rects"))
def r06_merge(t: Tables) -> DataFrame:
    return t.rects.groupBy(F.floor(F.col("id") / 100).alias("part")).agg(F.min("l").alias("l"), F.max("r").alias("r"), F.min("b").alias("b"), F.max("t").alias("t"))


@query(with_tables("SELECT id, l, r, b, t FROM rects", "rects"))
def r07_copy(t: Tables) -> DataFrame:
    return t.rects.select("id", "l", "r", "b", "t")


_INTER = "greatest(0, least(r, qr) - greatest(l, ql)) * greatest(0, least(t, qt) - greatest(b, qb))"


@query(with_tables(f"SELECT id, (t - b) * (r - l) + (qt - qb) * (qr - ql) AS areas, 2.0 * (t - b + r - l) + 2.0 * (qt - qb + qr - ql) AS perimeters, ({_INTER})::DOUBLE AS overlap FROM pairs", "rects", **_P))
def r08_split_measures(t: Tables) -> DataFrame:
    a, q = g.rect(), g.rect("q")
    return _pairs(t).select(
        "id", (g.area(a) + g.area(q)).alias("areas"), (g.perimeter(a) + g.perimeter(q)).alias("perimeters"), g.overlap_area(a, q).alias("overlap")
    )


_CLIP = "CASE WHEN least({r}, qr) > greatest({l}, ql) AND least({t}, qt) > greatest({b}, qb) THEN {f} ELSE 0 END"
_WIDE = {"l": "least(l, nl)", "r": "greatest(r, nr)", "b": "least(b, nb)", "t": "greatest(t, nt)"}
_OWN = {c: c for c in "lrbt"}


def _growth_sql(measure: str) -> str:
    def one(x: dict) -> str:
        w, h = f"(least({x['r']}, qr) - greatest({x['l']}, ql))", f"(least({x['t']}, qt) - greatest({x['b']}, qb))"
        return _CLIP.format(**x, f=f"{w} * {h}" if measure == "area" else f"2.0 * ({w} + {h})")

    return f"({one(_WIDE)} - {one(_OWN)})::DOUBLE"


@query(with_tables(f"SELECT id, {_growth_sql('perimeter')} AS d_perimeter, {_growth_sql('area')} AS d_area FROM (SELECT *, l + 3 AS nl, r + 4 AS nr, b + 2 AS nb, t + 9 AS nt FROM pairs)", "rects", **_P))
def r09_margin_overlap(t: Tables) -> DataFrame:
    a, q = g.rect(), g.rect("q")
    added = g.Rect(a.l + 3, a.r + 4, a.b + 2, a.t + 9)
    return _pairs(t).select(
        "id", g.overlap_growth(a, q, added, g.overlap_perimeter).alias("d_perimeter"), g.overlap_growth(a, q, added).alias("d_area")
    )


_RANKS = ", ".join(
    f"row_number() OVER (PARTITION BY node_id ORDER BY {keys}, ordinal) AS by_{name}"
    for name, keys in (("left", "l, r, b, t"), ("right", "r, l, b, t"), ("bottom", "b, t, l, r"), ("top", "t, b, l, r"), ("area", "(t - b) * (r - l)"))
)


@query(with_tables(f"SELECT node_id, ordinal, {_RANKS} FROM node_entries", "node_entries"))
def r10_orders(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    from gridloom.operators.splits import ORDERS

    node = Window.partitionBy("node_id")
    ranks = [F.row_number().over(node.orderBy(*keys, "ordinal")).cast("long").alias(f"by_{name}") for name, keys in ORDERS.items()]
    by_area = F.row_number().over(node.orderBy(g.area(g.rect()), "ordinal")).cast("long").alias("by_area")
    return t.node_entries.select("node_id", "ordinal", *ranks, by_area)


def _count_sql(predicate: str) -> str:
    return f"SELECT q.qid, count(a.id) AS n FROM boxes q LEFT JOIN rects a ON {predicate} GROUP BY q.qid"


@query(with_tables(_count_sql(_HOLDS), "boxes", "rects"))
def r11_contains_count(t: Tables) -> DataFrame:
    return rtree.contains_count(t.boxes, t.rects)


@query(with_tables(_count_sql(_OPEN), "boxes", "rects"))
def r11b_overlap_count(t: Tables) -> DataFrame:
    return rtree.overlap_count(t.boxes, t.rects)


@query(with_tables("SELECT count(*) AS queries, sum(n)::BIGINT AS found, max(n) AS most FROM (" + _count_sql(_HOLDS) + ")", "boxes", "rects"))
def r13_query_result(t: Tables) -> DataFrame:
    return rtree.contains_count(t.boxes, t.rects).agg(F.count(F.lit(1)).alias("queries"), F.sum("n").alias("found"), F.max("n").alias("most"))


_DIST = "((x - qx) * (x - qx) + (y - qy) * (y - qy))"


@query(with_tables(f"""SELECT qid, rank, id, round(sqrt(d), 6) AS dist FROM (SELECT qid, k, id, {_DIST} AS d, row_number() OVER (PARTITION BY qid ORDER BY {_DIST}, id) AS rank
 FROM (SELECT qid, x AS qx, y AS qy, k FROM knn_queries), points) WHERE rank <= k""", "knn_queries", "points"))
def r14_knn(t: Tables) -> DataFrame:
    found = rtree.nearest(t.knn_queries, t.points)
    return found.select("qid", F.col("rank").cast("long").alias("rank"), "id", F.round("dist", 6).alias("dist"))


@query(with_tables("SELECT id, round(sqrt(greatest(l - 60, 0, 60 - r) ** 2 + greatest(b - 200, 0, 200 - t) ** 2), 6) AS dist FROM rects", "rects"))
def r15_min_distance(t: Tables) -> DataFrame:
    return t.rects.select("id", F.round(F.sqrt(g.squared_distance(g.rect(), F.lit(60.0), F.lit(200.0))), 6).alias("dist"))


def _tree_sql() -> dict[str, str]:
    """The same bulk load in SQL, three levels and the root above them, enough for a million rectangles."""
    cap, out, below = 50, {}, "rects"
    for level in range(4):
        out[f"size{level}"] = f"SELECT count(*) AS n, (ceil(sqrt(ceil(count(*) / {cap}.0))) * {cap})::BIGINT AS s FROM {below}"
        out[f"tile{level}"] = (
            f"SELECT *, slice * (s // {cap}) + (row_number() OVER (PARTITION BY slice ORDER BY b, l, id) - 1) // {cap} AS node FROM "
            f"(SELECT x.*, z.s, (row_number() OVER (ORDER BY l, b, id) - 1) // z.s AS slice FROM {below} x, size{level} z)"
        )
        out[f"up{level}"] = f"SELECT node AS id, min(l) AS l, max(r) AS r, min(b) AS b, max(t) AS t, count(*) AS n_entries FROM tile{level} GROUP BY node"
        below = f"up{level}"
    parts = []
    for level in range(4):
        # a level exists where the one below it has more than one node
        exists = "TRUE" if level == 0 else f"(SELECT count(*) FROM up{level - 1}) > 1"
        parts.append(f"SELECT {level} AS level, id AS node_id, l, r, b, t, n_entries FROM up{level} WHERE {exists}")
    out["nodes"] = " UNION ALL ".join(parts)
    return out


_TREE = _tree_sql()


def _nodes(t: Tables) -> DataFrame:
    return rtree.bulk_load(t.rects)[0]


@query(with_tables("SELECT level::INT AS level, node_id, l, r, b, t, n_entries FROM nodes", "rects", **_TREE))
def r18_bulk_load(t: Tables) -> DataFrame:
    return _nodes(t).select("level", "node_id", "l", "r", "b", "t", "n_entries")


@query(with_tables(f"SELECT q.qid, count(a.node_id) AS n FROM boxes q LEFT JOIN nodes a ON {_OPEN} GROUP BY q.qid", "boxes", "rects", **_TREE))
def r12_node_accesses(t: Tables) -> DataFrame:
    return rtree.node_accesses(t.boxes, _nodes(t))


_PLACED = "SELECT a.level::INT AS level, a.node_id, arg_max(p.numa, q.cid) AS numa FROM nodes a JOIN (SELECT cid, lx AS l, hx AS r, ly AS b, hy AS t FROM cells_2d) q ON " + _OPEN + " JOIN placement p ON p.cid = q.cid GROUP BY ALL"


@query(with_tables(_PLACED, "rects", "cells_2d", "placement", **_TREE))
def r16_node_placement(t: Tables) -> DataFrame:
    return rtree.place_nodes(_nodes(t), t.cells_2d, t.placement)


@query(with_tables(f"SELECT numa, count(*) AS n FROM ({_PLACED}) GROUP BY numa", "rects", "cells_2d", "placement", **_TREE))
def r17_numa_status(t: Tables) -> DataFrame:
    return rtree.place_nodes(_nodes(t), t.cells_2d, t.placement).groupBy("numa").agg(F.count(F.lit(1)).alias("n"))


@query(with_tables("""SELECT count(*) AS n_nodes, (max(level) + 1)::INT AS height, round(avg((t - b) * (r - l)), 6) AS avg_area, round(avg(n_entries), 6) AS avg_children,
 round((sum(CASE WHEN level = 0 THEN n_entries ELSE 0 END) * 36 + sum(26 + 4 * n_entries)) / 1048576.0, 6)::DOUBLE AS size_mb FROM nodes""", "rects", **_TREE))
def r47_stats(t: Tables) -> DataFrame:
    return rtree.tree_stats(_nodes(t))


@query(with_tables("SELECT level::INT AS level, count(*) AS nodes, sum(n_entries)::BIGINT AS entries FROM nodes GROUP BY level", "rects", **_TREE))
def s17_tree_levels(t: Tables) -> DataFrame:
    return _nodes(t).groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n_entries").alias("entries"))


# --- quadtree ----------------------------------------------------------------------------------------------------

DEPTH = 6


def _path_sql() -> dict[str, str]:
    out = {"q0": "SELECT id, l, r, b, t, '' AS path, x0, x1, y0, y1, FALSE AS done FROM rects, (SELECT min(l) AS x0, max(r) AS x1, min(b) AS y0, max(t) AS y1 FROM rects)"}
    digit = "CASE WHEN l > mx AND t < my THEN 0 WHEN r < mx AND t < my THEN 1 WHEN r < mx AND b > my THEN 2 WHEN l > mx AND b > my THEN 3 END"
    for d in range(DEPTH):
        out[f"q{d + 1}"] = (
            "SELECT id, l, r, b, t, CASE WHEN go THEN path || digit ELSE path END AS path, CASE WHEN go AND digit IN (0, 3) THEN mx ELSE x0 END AS x0, "
            "CASE WHEN go AND digit IN (1, 2) THEN mx ELSE x1 END AS x1, CASE WHEN go AND digit IN (2, 3) THEN my ELSE y0 END AS y0, "
            "CASE WHEN go AND digit IN (0, 1) THEN my ELSE y1 END AS y1, done OR digit IS NULL AS done FROM "
            f"(SELECT *, NOT done AND digit IS NOT NULL AS go FROM (SELECT *, {digit} AS digit FROM (SELECT *, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM q{d})))"
        )
    return out


_QUAD = _path_sql()


def _tree(t: Tables) -> DataFrame:
    return quadtree.build(t.rects, t.rect_range, DEPTH)


@query(with_tables(_count_sql(_CLOSED), "boxes", "rects"))
def q01_intersects_count(t: Tables) -> DataFrame:
    return quadtree.objects_in_bound(t.boxes, t.rects)


def _by_storage_sql() -> str:
    one = lambda body: body[body.index("SELECT qid") :] if body.startswith("WITH") else body
    return f"SELECT 'rtree' AS storage, * FROM ({one(_count_sql(_OPEN))}) UNION ALL SELECT 'quadtree', * FROM ({one(_count_sql(_CLOSED))})"


@query(with_tables(_by_storage_sql(), "boxes", "rects"))
def x02_range_by_storage(t: Tables) -> DataFrame:
    """The range requests, each answered by its storage: open overlaps for the one, closed ones for the other."""
    return rtree.range_counts(t.boxes, t.rects, {"rtree": rtree.overlaps_open, "quadtree": quadtree.intersects_closed})


@query(with_tables("SELECT id, l - (r - l) / 2 AS x_low, l + (r - l) / 2 AS x_mid, b - (t - b) / 2 AS y_low, b + (t - b) / 2 AS y_mid FROM rects", "rects"))
def q02_half_extents(t: Tables) -> DataFrame:
    w, h = (F.col("r") - F.col("l")) / 2, (F.col("t") - F.col("b")) / 2
    return t.rects.select("id", (F.col("l") - w).alias("x_low"), (F.col("l") + w).alias("x_mid"), (F.col("b") - h).alias("y_low"), (F.col("b") + h).alias("y_mid"))


@query(with_tables("""SELECT id, (CASE WHEN l > mx AND t < my THEN 0 WHEN r < mx AND t < my THEN 1 WHEN r < mx AND b > my THEN 2 WHEN l > mx AND b > my THEN 3 END)::INT AS digit
 FROM rects, (SELECT (min(l) + max(r)) / 2 AS mx, (min(b) + max(t)) / 2 AS my FROM rects)""", "rects"))
def q03_child_digit(t: Tables) -> DataFrame:
    low_x, high_x, low_y, high_y = t.rect_range
    return t.rects.select("id", g.quadrant(g.rect(), F.lit((low_x + high_x) / 2), F.lit((low_y + high_y) / 2)).alias("digit"))


@query(with_tables(f"SELECT id, path FROM q{DEPTH}", "rects", **_QUAD))
def q04_paths(t: Tables) -> DataFrame:
    return _tree(t).select("id", "path")


@query(with_tables(f"SELECT path, count(*) AS n FROM q{DEPTH} GROUP BY path", "rects", **_QUAD))
def q05_objects_per_quadrant(t: Tables) -> DataFrame:
    return _tree(t).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(with_tables("SELECT * FROM rects WHERE id % 10 <> 3 AND id % 10 <> 4 UNION ALL SELECT id, l + 1, r + 1, b, t FROM rects WHERE id % 10 = 4", "rects"))
def q06_remove_update(t: Tables) -> DataFrame:
    kept = quadtree.remove(t.rects, t.rects.filter("id % 10 = 3"))
    moved = t.rects.filter("id % 10 = 4").select("id", (F.col("l") + 1).alias("l"), (F.col("r") + 1).alias("r"), "b", "t")
    return quadtree.update(kept, moved)


@query(with_tables(f"""SELECT 4 * (SELECT count(DISTINCT path[1:i]) FROM (SELECT path, unnest(range(0, len(path))) AS i FROM q{DEPTH} WHERE len(path) > 0)) AS n_children,
 (SELECT count(*) FROM rects) AS n_objects""", "rects", **_QUAD))
def q08_totals(t: Tables) -> DataFrame:
    return quadtree.totals(_tree(t))


@query(with_tables("SELECT a.id, arg_max(p.numa, q.cid) AS numa FROM rects a JOIN (SELECT cid, lx AS l, hx AS r, ly AS b, hy AS t FROM cells_2d) q ON " + _CLOSED + " JOIN placement p ON p.cid = q.cid GROUP BY a.id", "cells_2d", "placement"))
def q11_object_placement(t: Tables) -> DataFrame:
    return quadtree.place_objects(t.rects, t.cells_2d, t.placement)
