"""Choosing children and splitting overfull nodes, for all nodes of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.hashing import fnv_mod
from gridloom.operators import splits
from gridloom.plans.tables import Tables, query, with_tables

_INTER = "greatest(0, least({0}r, o.r) - greatest({0}l, o.l)) * greatest(0, least({0}t, o.t) - greatest({0}b, o.b))"
_CHILDREN = {
    "own": "SELECT e.*, p.l AS pl, p.r AS pr, p.b AS pb, p.t AS pt, least(e.l, p.l) AS ul, greatest(e.r, p.r) AS ur, least(e.b, p.b) AS ub, greatest(e.t, p.t) AS ut FROM node_entries e JOIN probes p USING (node_id)",
    "sibling": f"SELECT e.node_id, e.ordinal, sum({_INTER.format('e.')})::DOUBLE AS overlap, sum({_INTER.format('e.u')} - {_INTER.format('e.')})::DOUBLE AS d_overlap FROM own e JOIN node_entries o ON o.node_id = e.node_id AND o.ordinal <> e.ordinal GROUP BY ALL",
    "children": """SELECT node_id, ordinal, (t - b) * (r - l) AS area, 2.0 * (t - b + r - l) AS perim, overlap, (ut - ub) * (ur - ul) - (t - b) * (r - l) AS d_area,
 2.0 * (ut - ub + ur - ul) - 2.0 * (t - b + r - l) AS d_perim, d_overlap, l <= pl AND pr <= r AND b <= pb AND t >= pt AS holds FROM own JOIN sibling USING (node_id, ordinal)""",
}


def _children_sql(body: str) -> str:
    return with_tables(body, "probes", **_CHILDREN)


def _choose_sql(*by: str) -> str:
    return _children_sql(f"SELECT node_id, ordinal FROM children QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY {', '.join(by)}, ordinal) = 1")


@query(_children_sql("SELECT * FROM children"))
def r09b_child_growth(t: Tables) -> DataFrame:
    return t.children


@query(_choose_sql("d_area", "area"))
def r19_choose_area(t: Tables) -> DataFrame:
    return splits.choose(t.children, "d_area", "area")


@query(_choose_sql("d_perim", "area"))
def r20_choose_margin(t: Tables) -> DataFrame:
    return splits.choose(t.children, "d_perim", "area")


@query(_choose_sql("d_overlap", "d_area"))
def r21_choose_overlap(t: Tables) -> DataFrame:
    return splits.choose(t.children, "d_overlap", "d_area")


@query()
def r22_choose_random(t: Tables) -> DataFrame:
    return splits.choose_random(t.node_entries, fnv_mod(F.col("node_id"), 1 << 30))


@query()
def r23_choose_covering(t: Tables) -> DataFrame:
    return splits.choose_covering(t.node_entries, t.probes)


_ORDER = {"left": "l, r, b, t", "right": "r, l, b, t", "bottom": "b, t, l, r", "top": "t, b, l, r"}


def candidates_sql(orders: list[str]) -> dict[str, str]:
    parts = []
    for i, name in enumerate(orders):
        order = f"PARTITION BY node_id ORDER BY {_ORDER[name]}, ordinal"
        upto, after = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
        sides = ", ".join(
            f"{f}({c}) OVER (w {frame}) AS {side}_{c}"
            for c, f in zip("lrbt", ("min", "max", "min", "max"), strict=True)
            for side, frame in (("p", upto), ("s", after))
        )
        parts.append(f"SELECT node_id, {i} AS ord, row_number() OVER w - 1 AS idx, {sides} FROM node_entries WINDOW w AS ({order})")
    measured = """SELECT *, (p_t - p_b) * (p_r - p_l) AS area1, (s_t - s_b) * (s_r - s_l) AS area2, 2.0 * (p_t - p_b + p_r - p_l) AS perim1, 2.0 * (s_t - s_b + s_r - s_l) AS perim2,
 (greatest(0, least(p_r, s_r) - greatest(p_l, s_l)) * greatest(0, least(p_t, s_t) - greatest(p_b, s_b)))::DOUBLE AS overlap FROM raw WHERE idx BETWEEN 19 AND 30"""
    return {"raw": " UNION ALL ".join(f"({p})" for p in parts), "cand": measured}


def _best_sql(orders: list[str], first: str, second: str) -> str:
    return with_tables(
        f"SELECT node_id, ord::INT AS ord, idx::INT AS idx, {first} AS s1, {second} AS s2 FROM cand QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY {first}, {second}, ord, idx) = 1",
        "node_entries",
        **candidates_sql(orders),
    )


_FOUR, _TWO = ["left", "right", "bottom", "top"], ["left", "bottom"]


@query(with_tables("SELECT node_id, ord::INT AS ord, idx::INT AS idx, area1, area2, perim1, perim2, overlap FROM cand", "node_entries", **candidates_sql(_FOUR)))
def r24_split_candidates(t: Tables) -> DataFrame:
    return splits.split_candidates(t.node_entries, _FOUR).select("node_id", "ord", "idx", "area1", "area2", "perim1", "perim2", "overlap")


@query(_best_sql(_FOUR, "area1 + area2", "overlap"))
def r25_split_area(t: Tables) -> DataFrame:
    return splits.split_min_area(t.node_entries)


@query(_best_sql(_TWO, "perim1 + perim2", "overlap"))
def r26_split_margin(t: Tables) -> DataFrame:
    return splits.split_min_margin(t.node_entries)


@query(_best_sql(_FOUR, "overlap", "area1 + area2"))
def r27_split_overlap(t: Tables) -> DataFrame:
    return splits.split_min_overlap(t.node_entries)


_WASTE = "(greatest(e.t, o.t) - least(e.b, o.b)) * (greatest(e.r, o.r) - least(e.l, o.l)) - (e.t - e.b) * (e.r - e.l) - (o.t - o.b) * (o.r - o.l)"
_SEEDS = {
    "seeds": f"SELECT e.node_id, e.ordinal AS seed1, o.ordinal AS seed2 FROM node_entries e JOIN node_entries o ON o.node_id = e.node_id AND e.ordinal < o.ordinal QUALIFY row_number() OVER (PARTITION BY e.node_id ORDER BY {_WASTE} DESC, e.ordinal, o.ordinal) = 1"
}


@query(with_tables("SELECT * FROM seeds", "node_entries", **_SEEDS))
def r28_quadratic_seeds(t: Tables) -> DataFrame:
    return splits.seeds(t.node_entries)


@query()
def r28_quadratic_split(t: Tables) -> DataFrame:
    return splits.quadratic_split(t.node_entries)


_GREENE = {
    **_SEEDS,
    "hull": "SELECT node_id, min(l) AS nl, max(r) AS nr, min(b) AS nb, max(t) AS nt FROM node_entries GROUP BY node_id",
    "axis": """SELECT node_id, abs(least(x.r, y.r) - greatest(x.l, y.l)) / (nr - nl) < abs(least(x.t, y.t) - greatest(x.b, y.b)) / (nt - nb) AS by_bottom FROM seeds JOIN hull USING (node_id)
 JOIN node_entries x ON x.node_id = seeds.node_id AND x.ordinal = seed1 JOIN node_entries y ON y.node_id = seeds.node_id AND y.ordinal = seed2""",
    "placed": """SELECT e.*, row_number() OVER (PARTITION BY e.node_id ORDER BY CASE WHEN by_bottom THEN b ELSE l END, CASE WHEN by_bottom THEN t ELSE r END, CASE WHEN by_bottom THEN l ELSE b END, CASE WHEN by_bottom THEN r ELSE t END, ordinal) AS pos
 FROM node_entries e JOIN axis USING (node_id)""",
    "halves": "SELECT node_id, CASE WHEN pos <= 25 THEN 1 ELSE 2 END AS side, min(l) AS l, max(r) AS r, min(b) AS b, max(t) AS t FROM placed WHERE pos <> 26 GROUP BY ALL",
    "middle": """SELECT p.node_id, p.ordinal, h.side, (greatest(h.t, p.t) - least(h.b, p.b)) * (greatest(h.r, p.r) - least(h.l, p.l)) - (h.t - h.b) * (h.r - h.l) AS grows
 FROM placed p JOIN halves h ON h.node_id = p.node_id WHERE p.pos = 26""",
}


@query(with_tables("""SELECT node_id, ordinal, (CASE WHEN pos <= 25 THEN 1 ELSE 2 END)::INT AS side FROM placed WHERE pos <> 26
 UNION ALL SELECT node_id, ordinal, arg_min(side, (grows, -side))::INT FROM middle GROUP BY node_id, ordinal""", "node_entries", **_GREENE))
def r29_greene(t: Tables) -> DataFrame:
    return splits.greene_split(t.node_entries)


def _origins(t: Tables) -> DataFrame:
    first = t.node_entries.filter("ordinal = 0")
    return first.select("node_id", ((F.col("l") + F.col("r")) / 2).alias("ox"), ((F.col("b") + F.col("t")) / 2).alias("oy"))


_RR = {
    **candidates_sql(_TWO),
    "sums": "SELECT node_id, sum(CASE WHEN ord = 0 THEN perim1 + perim2 END) AS s0, sum(CASE WHEN ord = 1 THEN perim1 + perim2 END) AS s1 FROM cand GROUP BY node_id",
    "hull": "SELECT node_id, min(l) AS nl, max(r) AS nr, min(b) AS nb, max(t) AS nt FROM node_entries GROUP BY node_id",
    "node": """SELECT node_id, CASE WHEN s0 < s1 THEN 0 ELSE 1 END AS dim, 2 * (nr - nl + nt - nb) - least(nr - nl, nt - nb) AS perim_max,
 (1 - 40.0 / 51) * 2 * CASE WHEN s0 < s1 THEN ((nr + nl) / 2 - (e.l + e.r) / 2) / (nr - nl) ELSE ((nt + nb) / 2 - (e.b + e.t) / 2) / (nt - nb) END AS mean
 FROM sums JOIN hull USING (node_id) JOIN node_entries e USING (node_id) WHERE e.ordinal = 0""",
    "weighted": """SELECT c.node_id, dim, idx, overlap, perim1 + perim2 - perim_max AS rest, (exp(-((x - mean) / d) * ((x - mean) / d)) - exp(-4.0)) / (1 - exp(-4.0)) AS w FROM
 (SELECT c.*, n.dim, n.mean, n.perim_max, 2.0 * idx / 51 - 1 AS x, 0.5 * (1 + abs(mean)) AS d FROM cand c JOIN node n ON n.node_id = c.node_id AND n.dim = c.ord) c""",
    "scored": "SELECT node_id, dim, idx, round(CASE WHEN overlap > 0 THEN overlap / w ELSE rest * w END, 6) AS score FROM weighted",
}


@query(with_tables("SELECT node_id, dim::INT AS dim, idx::INT AS idx, score FROM scored QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY score, idx) = 1", "node_entries", **_RR))
def r31_rr_split(t: Tables) -> DataFrame:
    return splits.rr_split(t.node_entries, _origins(t))


@query(with_tables("""SELECT node_id, ordinal FROM (SELECT e.node_id, ordinal, ((l + r) / 2 - (nl + nr) / 2) ** 2 + ((b + t) / 2 - (nb + nt) / 2) ** 2 AS d FROM node_entries e JOIN hull USING (node_id))
 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY d DESC, ordinal) <= ceil(0.3 * 51)""", "node_entries", hull=_GREENE["hull"]))
def r32_reinsert(t: Tables) -> DataFrame:
    return splits.reinsert(t.node_entries)


@query(_children_sql("SELECT node_id, ordinal, (ordinal % 2 = 0)::INT AS inserted FROM children QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY d_area, area, ordinal) = 1"))
def r33_try_insert(t: Tables) -> DataFrame:
    """Inserted where the chosen child has room; every second child counts as full here."""
    return splits.choose(t.children, "d_area", "area").withColumn("inserted", (F.col("ordinal") % 2 == 0).cast("int"))


@query(_children_sql("SELECT node_id, ordinal FROM children WHERE ordinal = node_id % 51"))
def r34_insert_at(t: Tables) -> DataFrame:
    """The child at an ordinal, which is taken modulo the number of children."""
    return t.children.filter("ordinal = node_id % 51").select("node_id", "ordinal")


@query(with_tables("SELECT node_id, ord::INT AS ord, idx::INT AS idx, area1, area2 FROM cand WHERE ord = (node_id % 48) // 12 AND idx = node_id % 12 + 19", "node_entries", **candidates_sql(_FOUR)))
def r34_split_at(t: Tables) -> DataFrame:
    """The split a single number stands for: its order and its position."""
    found = splits.split_candidates(t.node_entries, _FOUR).filter("ord = floor((node_id % 48) / 12) and idx = node_id % 12 + 19")
    return found.select("node_id", "ord", "idx", "area1", "area2")


@query(_children_sql("SELECT node_id, coalesce(arg_min(ordinal, (area, ordinal)) FILTER (WHERE holds), -1) AS ordinal FROM children GROUP BY node_id"))
def r35_containing_child(t: Tables) -> DataFrame:
    return splits.containing_child(t.children)


@query(_children_sql("SELECT node_id, count(*) FILTER (WHERE NOT holds) AS n FROM children GROUP BY node_id"))
def r36_enlarged_children(t: Tables) -> DataFrame:
    return splits.enlarged_children(t.children)


_TABLE = {
    **candidates_sql(_TWO),
    "tab": "SELECT node_id, ord::INT AS dim, idx::INT AS location, greatest(perim1, perim2) AS perim_max, least(perim1, perim2) AS perim_min, greatest(area1, area2) AS area_max, least(area1, area2) AS area_min, overlap FROM cand",
}


@query(with_tables("SELECT * FROM tab", "node_entries", **_TABLE))
def r37_split_table(t: Tables) -> DataFrame:
    return splits.split_table(t.node_entries)


@query(with_tables("SELECT node_id, dim, location, row_number() OVER (PARTITION BY node_id ORDER BY perim_max + perim_min, dim, location) AS place FROM tab", "node_entries", **_TABLE))
def r38_sorted_splits(t: Tables) -> DataFrame:
    found = splits.by_total_perimeter(splits.split_table(t.node_entries))
    return found.select("node_id", "dim", "location", F.col("place").cast("long").alias("place"))


@query(with_tables("SELECT node_id, count(*) FILTER (WHERE overlap = 0) AS n_free, arg_min(dim, (overlap, dim, location)) AS dim, arg_min(location, (overlap, dim, location)) AS location FROM tab GROUP BY node_id", "node_entries", **_TABLE))
def r39_free_splits(t: Tables) -> DataFrame:
    least = F.min(F.struct("overlap", "dim", "location"))
    return splits.split_table(t.node_entries).groupBy("node_id").agg(
        F.count_if(F.col("overlap") == 0).alias("n_free"), least["dim"].alias("dim"), least["location"].alias("location")
    )


@query(_children_sql("SELECT node_id, ordinal, row_number() OVER (PARTITION BY node_id ORDER BY area, ordinal) AS by_area, row_number() OVER (PARTITION BY node_id ORDER BY d_area, ordinal) AS by_growth FROM children"))
def r40_sorted_children(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    node = Window.partitionBy("node_id")
    place = lambda c: F.row_number().over(node.orderBy(c, "ordinal")).cast("long")
    return t.children.select("node_id", "ordinal", place("area").alias("by_area"), place("d_area").alias("by_growth"))


def _scaled_sql(columns: dict[str, list[str]], pad: float) -> str:
    out = []
    for group in columns.values():
        low = "least(" + ", ".join(f"min({c}) OVER w" for c in group) + ")"
        high = "greatest(" + ", ".join(f"max({c}) OVER w" for c in group) + ")"
        out += [f"round(({c} - {low}) / ({high} - {low} + {pad}), 6) AS {c}" for c in group]
    return ", ".join(out)


_SHORT = {"area": ["area1", "area2"], "perim": ["perim1", "perim2"], "overlap": ["overlap"]}
_BEST2 = {"area": ["area_max", "area_min"], "perim": ["perim_max", "perim_min"]}


@query(with_tables(f"SELECT node_id, idx::INT AS idx, {_scaled_sql(_SHORT, 0.01)} FROM cand WHERE ord = 0 WINDOW w AS (PARTITION BY node_id)", "node_entries", **candidates_sql(_TWO)))
def r41_short_split_features(t: Tables) -> DataFrame:
    return splits.short_split_features(t.node_entries)


@query(with_tables(f"SELECT node_id, dim, location, place, {_scaled_sql(_BEST2, 0.1)} FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY perim_max, dim, location) AS place FROM tab WHERE overlap = 0) WHERE place <= 2 WINDOW w AS (PARTITION BY node_id)", "node_entries", **_TABLE))
def r42_zero_overlap_features(t: Tables) -> DataFrame:
    return splits.zero_overlap_features(t.node_entries).select(
        "node_id", "dim", "location", F.col("place").cast("long").alias("place"), "area_max", "area_min", "perim_max", "perim_min"
    )


@query(_children_sql("SELECT node_id, ordinal, l AS x, b AS y, r - l AS w, t - b AS h, CASE WHEN r > l THEN round((t - b) / (r - l), 6) END AS aspect, area, d_area, d_perim, d_overlap FROM own JOIN children USING (node_id, ordinal)"))
def r43_raw_insert_features(t: Tables) -> DataFrame:
    return splits.raw_insert_features(t.node_entries, t.probes)


_FEATURES = ", ".join(f"round({c} / (greatest(max({c}) OVER w, 0) + 0.001), 6) AS f_{c[2:]}" for c in ("d_area", "d_perim", "d_overlap"))


@query(_children_sql(f"SELECT node_id, ordinal, {_FEATURES} FROM children WINDOW w AS (PARTITION BY node_id)"))
def r44_insert_features(t: Tables) -> DataFrame:
    return splits.insert_features(t.children)


@query(_children_sql(f"SELECT node_id, ordinal, place, {_FEATURES} FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY d_area, ordinal) AS place FROM children) WHERE place <= 5 WINDOW w AS (PARTITION BY node_id)"))
def r45_sorted_insert_features(t: Tables) -> DataFrame:
    found = splits.sorted_insert_features(t.children)
    return found.select("node_id", "ordinal", F.col("place").cast("long").alias("place"), "f_area", "f_perim", "f_overlap")


_COSTS = {
    **candidates_sql(_FOUR),
    "best": "SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY area1 + area2, overlap, ord, idx) = 1",
    "hull": "SELECT node_id, (max(t) - min(b)) * (max(r) - min(l)) AS na, 2.0 * (max(t) - min(b) + max(r) - min(l)) AS np FROM node_entries GROUP BY node_id",
}


@query(with_tables("SELECT node_id, round(area1 / na, 6) AS area1, round(area2 / na, 6) AS area2, round(perim1 / np, 6) AS perim1, round(perim2 / np, 6) AS perim2, round(overlap / na, 6) AS overlap FROM best JOIN hull USING (node_id)", "node_entries", **_COSTS))
def r46_split_costs(t: Tables) -> DataFrame:
    measures = ["area1", "area2", "perim1", "perim2", "overlap"]
    return splits.split_costs(t.node_entries, splits.split_min_area(t.node_entries, *measures))


_AREA4, _OVERLAP4 = "area1 + area2, overlap", "overlap, area1 + area2"


def _same_sql(order: str) -> str:
    return f"SELECT node_id, least(p_l, s_l) AS l, p_l, p_r, p_b, p_t, s_l, s_r, s_b, s_t FROM cand QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY {order}, ord, idx) = 1"


@query(with_tables("""SELECT node_id, NOT ((a.p_l, a.p_r, a.p_b, a.p_t, a.s_l, a.s_r, a.s_b, a.s_t) = (o.p_l, o.p_r, o.p_b, o.p_t, o.s_l, o.s_r, o.s_b, o.s_t)
 OR (a.p_l, a.p_r, a.p_b, a.p_t, a.s_l, a.s_r, a.s_b, a.s_t) = (o.s_l, o.s_r, o.s_b, o.s_t, o.p_l, o.p_r, o.p_b, o.p_t)) AS differs FROM a JOIN o USING (node_id)""", "node_entries", **candidates_sql(_FOUR), a=_same_sql(_AREA4), o=_same_sql(_OVERLAP4)))
def r46_splits_differ(t: Tables) -> DataFrame:
    """Whether the area and the overlap rules split a node differently, whichever side comes first."""
    cand = splits.split_candidates(t.node_entries, _FOUR)
    box = lambda p: F.struct(*(f"{p}_{c}" for c in "lrbt"))
    sides = F.array_sort(F.array(box("p"), F.struct(*(F.col(f"s_{c}").alias(f"p_{c}") for c in "lrbt"))))
    areas, measured = F.col("area1") + F.col("area2"), cand.withColumn("sides", sides)
    least = lambda *by: F.min(F.struct(*by, "ord", "idx", "sides"))["sides"]
    both = measured.groupBy("node_id").agg(least(areas.alias("s1"), "overlap").alias("a"), least("overlap", areas.alias("s2")).alias("o"))
    return both.select("node_id", (F.col("a") != F.col("o")).alias("differs"))
