"""Request generation. Ids are those of ``events``; draws are functions of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import hashing as h
from gridloom.operators import workload as w
from gridloom.plans.tables import Tables, query, with_tables
from gridloom.sources.shared import shared_path

_PRIME = 1099511628211


def _fnv_sql(value: str, name: str = "f", source: str = "events", id_: str = "event_id::BIGINT") -> dict[str, str]:
    """Octet by octet; the hash is a HUGEINT, and only its lowest octet takes part in the exclusive or."""
    out = {f"{name}0": f"SELECT id, v, {h.FNV_OFFSET}::HUGEINT AS hash FROM (SELECT {id_} AS id, {value} AS v FROM {source})"}
    for i in range(8):
        octet = f"((v >> {8 * i}) & 255)"
        out[f"{name}{i + 1}"] = f"SELECT id, v, ((hash - hash % 256 + xor((hash % 256)::BIGINT, {octet})) * {_PRIME}) % 18446744073709551616 AS hash FROM {name}{i}"
    return out


def _uniform_sql(draw: int, name: str) -> dict[str, str]:
    return _fnv_sql(f"event_id::BIGINT * 1024 + {draw}", f"{name}_f") | {name: f"SELECT id, ((hash // 4294967296) // 2)::DOUBLE / 2147483648.0 AS u FROM {name}_f8"}


def _draws_sql(*draws: int) -> dict[str, str]:
    """A table d of id and the draws u<number>."""
    out = {}
    for i in draws:
        out |= _uniform_sql(i, f"u{i}")
    columns = ", ".join(f"u{i}.u AS u{i}" for i in draws)
    joins = " ".join(f"JOIN u{i} USING (id)" for i in draws[1:])
    return out | {"d": f"SELECT u{draws[0]}.id AS id, {columns} FROM u{draws[0]} {joins}"}


def _normal_sql(draw: int) -> str:
    return f"sqrt(-2.0 * ln(1.0 - u{draw})) * cos({2 * math.pi!r} * u{draw + 1})"


def _lognormal_sql(mean: float, sd: float, draw: int) -> str:
    return f"exp({mean} + {_normal_sql(draw)} * {sd})"


def _mixture_sql(components: list[tuple[float, str, str]], draw: int) -> str:
    """components: weights and SQL of means and deviations."""
    total, at, means, sds = sum(c[0] for c in components), 0.0, "", ""
    for weight, mean, sd in components[:-1]:
        at += weight / total
        means += f"WHEN u{draw} < {at!r} THEN {mean} "
        sds += f"WHEN u{draw} < {at!r} THEN {sd} "
    _, mean, sd = components[-1]
    return f"(CASE {means}ELSE {mean} END + {_normal_sql(draw + 1)} * CASE {sds}ELSE {sd} END)"


def _boxes_sql(x: str, y: str, width: str, height: str, more: str = "TRUE") -> str:
    """Rounded boxes of requests from d and box."""
    drawn = f"SELECT id AS req_id, x0, x1, y0, y1, {x} AS x, {y} AS y, {width} AS w, {height} AS h FROM d, box"
    rounded = f"SELECT req_id, x0, x1, y0, y1, round(x, 6) AS l, round(x + w, 6) AS r, round(y, 6) AS b, round(y + h, 6) AS t FROM ({drawn})"
    return f"SELECT req_id, l, r, b, t FROM ({rounded}) WHERE {more}"


def _zipf_table_sql(n: str, theta: float) -> str:
    """One row: n and the constants of a zipfian draw over it."""
    zeta = f"(SELECT sum(1.0 / pow(i, {theta})) FROM range(1, {n} + 1) AS r(i))"
    return f"SELECT n, zn, (1 - pow(2.0 / n, {1 - theta!r})) / (1 - {h.zeta(2, theta)!r} / zn) AS eta FROM (SELECT {n} AS n, {zeta} AS zn)"


def _zipf_of_sql(u: str, theta: float) -> str:
    """The rank of a draw, beside the row of constants."""
    return f"(CASE WHEN {u} * zn < 1.0 THEN 0 WHEN {u} * zn < 1.0 + {0.5**theta!r} THEN 1 ELSE least(floor(n::DOUBLE * pow(eta * {u} - eta + 1, {1 / (1 - theta)!r})), n - 1) END)::BIGINT"


def _scrambled_sql(draw: int, name: str, n: str, theta: float) -> dict[str, str]:
    """A table (id, key) of scrambled draws of d's column u<draw>."""
    items = w.SCRAMBLED_ITEMS + 1
    known = w.SCRAMBLED_ZETA if theta == w.ZIPF_THETA else None
    rank = _zipf_sql(items, theta, *h.zipf_constants(items, theta, known), u=f"u{draw}")
    return _fnv_sql(rank, f"{name}_f", "d", "id") | {name: f"SELECT id, (hash % {n})::BIGINT AS key FROM {name}_f8"}


_N = "(SELECT count(*) FROM keys)"
_BOXES = "SELECT min(l) AS x0, max(r) AS x1, min(b) AS y0, max(t) AS y1 FROM rects"


def _ids(t: Tables) -> DataFrame:
    return t.base("events").select(F.col("event_id").cast("long").alias("req_id"))


def _key() -> Column:
    """The column that draws depend on; made when a query is, as there is no session at import."""
    return F.col("req_id")


@query(with_tables("SELECT id AS req_id, hash::VARCHAR AS hash FROM f8", **_fnv_sql("event_id::BIGINT * 7919")))
def w08_fnv64(t: Tables) -> DataFrame:
    return _ids(t).select("req_id", h.fnv64(_key() * 7919).cast("string").alias("hash"))


@query(with_tables("SELECT id AS req_id, (10 + floor(u * 91))::BIGINT AS x FROM u0", **_uniform_sql(0, "u0")))
def w01_uniform(t: Tables) -> DataFrame:
    return _ids(t).select("req_id", w.uniform_int(_key(), 10, 100).alias("x"))


_ZN, _ETA, _ALPHA = h.zipf_constants(1000, 0.99)


def _zipf_sql(n: int, theta: float, zn: float, eta: float, alpha: float, u: str = "u") -> str:
    return f"(CASE WHEN {u} * {zn!r} < 1.0 THEN 0 WHEN {u} * {zn!r} < 1.0 + {0.5**theta!r} THEN 1 ELSE least(floor({float(n)!r} * pow({eta!r} * {u} - ({eta!r}) + 1, {alpha!r})), {n - 1}) END)::BIGINT"


@query(with_tables(f"SELECT rank, count(*) AS n FROM (SELECT {_zipf_sql(1000, 0.99, _ZN, _ETA, _ALPHA)} AS rank FROM u0) WHERE rank < 2 GROUP BY rank", **_uniform_sql(0, "u0")))
def w02_zipf_head(t: Tables) -> DataFrame:
    """The two most frequent ranks, which need no power and so agree in all engines; tests check the rest."""
    return w_rank(_ids(t)).filter("rank < 2").groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


def w_rank(ids: DataFrame) -> DataFrame:
    return ids.select("req_id", h.zipf(h.uniform(_key(), 0), 1000, 0.99).alias("rank"))


@query(with_tables(f"SELECT id AS req_id, {_zipf_sql(1000, 0.99, _ZN, _ETA, _ALPHA)} AS rank FROM u0", **_uniform_sql(0, "u0")))
def w02_zipf(t: Tables) -> DataFrame:
    return w_rank(_ids(t))


@query(with_tables("SELECT id AS req_id, key AS key_index FROM s", "keys", **_draws_sql(0), **_scrambled_sql(0, "s", _N, w.ZIPF_THETA)))
def w03_scrambled_zipf(t: Tables) -> DataFrame:
    return _ids(t).select("req_id", w.scrambled_zipf(_key(), t.n_keys).alias("key_index"))


@query(with_tables(f"SELECT id AS req_id, n - 1 - {_zipf_of_sql('u0', w.ZIPF_THETA)} AS key_index FROM d, z", "keys", z=_zipf_table_sql(_N, w.ZIPF_THETA), **_draws_sql(0)))
def w04_latest(t: Tables) -> DataFrame:
    return _ids(t).select("req_id", w.latest(_key(), t.n_keys - 1).alias("key_index"))


@query(with_tables("SELECT CASE WHEN u < 0.5 THEN 'READ' WHEN u < 0.75 THEN 'INSERT' ELSE 'SCAN' END AS op, count(*) AS n FROM u0 GROUP BY op", **_uniform_sql(0, "u0")))
def w05_op_mix(t: Tables) -> DataFrame:
    op = w.discrete(h.uniform(_key(), 0), {"READ": 2, "INSERT": 1, "SCAN": 1})
    return _ids(t).select(op.alias("op")).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id::BIGINT AS req_id, row_number() OVER (ORDER BY event_id) + 99 AS counter, 7::BIGINT AS constant FROM events")
def w06_counter(t: Tables) -> DataFrame:
    from gridloom.operators.ranking import global_rank

    ranked = global_rank(_ids(t), "req_id", [], "counter")
    return ranked.select("req_id", (F.col("counter") + 99).alias("counter"), F.lit(7).cast("long").alias("constant"))


_ACK = "SELECT DISTINCT event_id::BIGINT AS id FROM events WHERE event_id % 1000 <> 777"


@query(f"SELECT min(id) AS last FROM ({_ACK}) WHERE id + 1 NOT IN ({_ACK})")
def w07_contiguous_ack(t: Tables) -> DataFrame:
    acks = t.base("events").filter("event_id % 1000 <> 777").select(F.col("event_id").cast("long").alias("id"))
    return w.contiguous_ack(acks)


_LETTERS = "chr((48 + ((hash // {0}) % 75))::INT)"
_NAME = " || ".join(_LETTERS.format(256**i) for i in range(7))


@query(with_tables(f"SELECT id AS req_id, {_NAME} AS field FROM f8", **_fnv_sql("event_id::BIGINT")))
def w11_field_values(t: Tables) -> DataFrame:
    """Printable characters 48 to 122 from the hash, in place of a twister's draws."""

    def name(x: Column) -> Column:
        high, low = x["high"], x["low"]
        # (hash div 256^i) mod 75 from the two halves
        parts = [(high % 75) * ((1 << (32 - 8 * i)) % 75) + F.shiftrightunsigned(low, 8 * i) % 75 for i in range(4)]
        parts += [F.shiftrightunsigned(high, 8 * i) % 75 for i in range(3)]
        return F.concat(*(F.char(48 + p % 75) for p in parts))

    high, low = h.fnv64_parts(_key())
    return _ids(t).select("req_id", h.let(F.struct(high.alias("high"), low.alias("low")), name).alias("field"))


@query(with_tables(f"SELECT id AS req_id, round({_normal_sql(0)}, 6) AS normal, round({_lognormal_sql(0.0, 0.5, 2)}, 6) AS lognormal, round(-1.0 + u4 * 2.0, 6) AS uniform FROM d", **_draws_sql(0, 1, 2, 3, 4)))
def w13_continuous(t: Tables) -> DataFrame:
    return _ids(t).select(
        "req_id", F.round(h.normal(_key(), 0), 6).alias("normal"), F.round(w.lognormal(_key(), 0.0, 0.5, 2), 6).alias("lognormal"), F.round(w.uniform_real(_key(), -1.0, 1.0, 4), 6).alias("uniform")
    )


# --- templates ---------------------------------------------------------------------------------------------------


def _box(t: Tables) -> tuple[float, float, float, float]:
    return t.rect_range


def _extent(draw: int) -> Column:
    return w.uniform_real(_key(), 0.5, 8.0, draw)


@query(with_tables("""SELECT u0.id AS req_id, round(x0 + u0.u * (x1 - x0), 6) AS l, round(x0 + u0.u * (x1 - x0) + (0.5 + u2.u * 7.5), 6) AS r, round(y0 + u1.u * (y1 - y0), 6) AS b,
 round(y0 + u1.u * (y1 - y0) + (0.5 + u3.u * 7.5), 6) AS t FROM u0 JOIN u1 USING (id) JOIN u2 USING (id) JOIN u3 USING (id), box""", "rects", box=_BOXES,
 **_uniform_sql(0, "u0"), **_uniform_sql(1, "u1"), **_uniform_sql(2, "u2"), **_uniform_sql(3, "u3")))
def w20_uniform_boxes(t: Tables) -> DataFrame:
    x0, x1, y0, y1 = _box(t)
    return w.box_requests(_ids(t), w.uniform_real(_key(), x0, x1, 0), w.uniform_real(_key(), y0, y1, 1), _extent(2), _extent(3))


@query(with_tables(_boxes_sql(f"(x0 + x1) / 2 + {_normal_sql(0)} * ((x1 - x0) / 6)", f"(y0 + y1) / 2 + {_normal_sql(2)} * ((y1 - y0) / 6)", "0.5 + u4 * 7.5", "0.5 + u5 * 7.5"), "rects", box=_BOXES, **_draws_sql(0, 1, 2, 3, 4, 5)))
def w21_normal_boxes(t: Tables) -> DataFrame:
    x0, x1, y0, y1 = _box(t)
    x = F.lit((x0 + x1) / 2) + h.normal(_key(), 0) * ((x1 - x0) / 6)
    y = F.lit((y0 + y1) / 2) + h.normal(_key(), 2) * ((y1 - y0) / 6)
    return w.box_requests(_ids(t), x, y, _extent(4), _extent(5))


@query(with_tables("SELECT u0.id AS req_id, r.id, r.l, r.b FROM u0 JOIN rects r ON r.id = floor(u0.u * (SELECT count(*) FROM rects))::BIGINT", "rects", **_uniform_sql(0, "u0")))
def w22_point_lookups(t: Tables) -> DataFrame:
    """A stored object for each request, by its number."""
    n = t.rects.count()
    drawn = _ids(t).select("req_id", F.floor(h.uniform(_key(), 0) * n).cast("long").alias("id"))
    return drawn.join(t.rects.select("id", "l", "b"), "id")


@query(with_tables(
    _boxes_sql("x0 + zx", "y0 + zy", "0.5 + u2 * 7.5", "0.5 + u3 * 7.5").replace("FROM d, box", f"FROM (SELECT d.*, {_zipf_of_sql('u0', 0.4)} AS zx FROM d, nx) JOIN (SELECT id, {_zipf_of_sql('u1', 0.4)} AS zy FROM d, ny) USING (id), box"),
    "rects", box=_BOXES, nx=_zipf_table_sql("(SELECT floor(x1 - x0)::BIGINT + 1 FROM box)", 0.4), ny=_zipf_table_sql("(SELECT floor(y1 - y0)::BIGINT + 1 FROM box)", 0.4), **_draws_sql(0, 1, 2, 3),
))
def w23_zipf_boxes(t: Tables) -> DataFrame:
    x0, x1, y0, y1 = _box(t)
    x = F.lit(x0) + h.zipf(h.uniform(_key(), 0), int(x1 - x0) + 1, 0.4)
    y = F.lit(y0) + h.zipf(h.uniform(_key(), 1), int(y1 - y0) + 1, 0.4)
    return w.box_requests(_ids(t), x, y, _extent(2), _extent(3))


def _hotspots(t: Tables, n: int) -> DataFrame:
    x0, x1, y0, y1 = _box(t)
    spots = [(0.8 / n, x0 + (i + 1) * (x1 - x0) / (n + 1), (x1 - x0) / 50) for i in range(n)] + [(0.2, (x0 + x1) / 2, (x1 - x0) / 4)]
    rows = [(0.8 / n, y0 + (n - i) * (y1 - y0) / (n + 1), (y1 - y0) / 50) for i in range(n)] + [(0.2, (y0 + y1) / 2, (y1 - y0) / 4)]
    return w.box_requests(_ids(t), w.mixture_normal(_key(), spots, 0), w.mixture_normal(_key(), rows, 4), _extent(8), _extent(9))


def _hotspots_sql(n: int) -> str:
    spots = [(0.8 / n, f"x0 + {i + 1} * (x1 - x0) / {n + 1}", "(x1 - x0) / 50") for i in range(n)] + [(0.2, "(x0 + x1) / 2", "(x1 - x0) / 4")]
    rows = [(0.8 / n, f"y0 + {n - i} * (y1 - y0) / {n + 1}", "(y1 - y0) / 50") for i in range(n)] + [(0.2, "(y0 + y1) / 2", "(y1 - y0) / 4")]
    boxes = _boxes_sql(_mixture_sql(spots, 0), _mixture_sql(rows, 4), "0.5 + u8 * 7.5", "0.5 + u9 * 7.5")
    return with_tables(boxes, "rects", box=_BOXES, **_draws_sql(0, 1, 2, 4, 5, 6, 8, 9))


@query(_hotspots_sql(3))
def w24_hot3_boxes(t: Tables) -> DataFrame:
    return _hotspots(t, 3)


@query(_hotspots_sql(5))
def w24_hot5_boxes(t: Tables) -> DataFrame:
    return _hotspots(t, 5)


@query(_hotspots_sql(7))
def w24_hot7_boxes(t: Tables) -> DataFrame:
    return _hotspots(t, 7)


def _mixed(t: Tables, share: float) -> DataFrame:
    """Points for a share of the requests, fixed boxes of 4 by 2 for the others."""
    x0, x1, y0, y1 = _box(t)
    point = h.uniform(_key(), 2) < share
    side = lambda v: F.when(point, 0.0).otherwise(float(v))
    return w.box_requests(_ids(t), w.uniform_real(_key(), x0, x1, 0), w.uniform_real(_key(), y0, y1, 1), side(4), side(2))


def _mixed_sql(share: float) -> str:
    size = lambda v: f"CASE WHEN u2.u < {share} THEN 0.0 ELSE {v}.0 END"
    return with_tables(
        f"SELECT u0.id AS req_id, round(x0 + u0.u * (x1 - x0), 6) AS l, round(x0 + u0.u * (x1 - x0) + {size(4)}, 6) AS r, round(y0 + u1.u * (y1 - y0), 6) AS b, round(y0 + u1.u * (y1 - y0) + {size(2)}, 6) AS t "
        "FROM u0 JOIN u1 USING (id) JOIN u2 USING (id), box", "rects", box=_BOXES, **_uniform_sql(0, "u0"), **_uniform_sql(1, "u1"), **_uniform_sql(2, "u2"),
    )


@query(_mixed_sql(0.25))
def w25_mixed_25_75(t: Tables) -> DataFrame:
    return _mixed(t, 0.25)


@query(_mixed_sql(0.5))
def w25_mixed_50_50(t: Tables) -> DataFrame:
    return _mixed(t, 0.5)


@query(_mixed_sql(0.75))
def w25_mixed_75_25(t: Tables) -> DataFrame:
    return _mixed(t, 0.75)


@query(with_tables(
    _boxes_sql(_lognormal_sql(3.5, 0.6, 0), _lognormal_sql(4.5, 0.6, 2), _lognormal_sql(0.0, 0.5, 4), _lognormal_sql(0.0, 0.5, 4), "l >= x0 AND r <= x1 AND b >= y0 AND t <= y1"),
    "rects", box=_BOXES, **_draws_sql(0, 1, 2, 3, 4, 5),
))
def w26_lognormal_boxes(t: Tables) -> DataFrame:
    """Draws outside the extent are left out."""
    x0, x1, y0, y1 = _box(t)
    width = w.lognormal(_key(), 0.0, 0.5, 4)
    drawn = w.box_requests(_ids(t), w.lognormal(_key(), 3.5, 0.6, 0), w.lognormal(_key(), 4.5, 0.6, 2), width, width)  # one draw for both sides
    return drawn.filter((F.col("l") >= x0) & (F.col("r") <= x1) & (F.col("b") >= y0) & (F.col("t") <= y1))


# The mixes' properties, a line for each file. What a mix leaves out has a default.
MIX_FILES = {
    "ycsb_a": "readproportion=0.5;updateproportion=;scanproportion=0;insertproportion=0.5;requestdistribution=zipfian",
    "ycsb_a1": "readproportion=0.75;updateproportion=0;scanproportion=0;insertproportion=0.25;requestdistribution=zipfian",
    "ycsb_a00": "readproportion=0.5;updateproportion=0;scanproportion=0;insertproportion=0.5;requestdistribution=latest",
    "ycsb_a01": "readproportion=0.75;updateproportion=0;scanproportion=0;insertproportion=0.25;requestdistribution=latest",
    "ycsb_b": "readproportion=0.95;updateproportion=0.05;scanproportion=0;insertproportion=0;requestdistribution=zipfian",
    "ycsb_c": "readproportion=1;updateproportion=0;scanproportion=0;insertproportion=0;requestdistribution=zipfian",
    "ycsb_c1": "readproportion=1;updateproportion=0;scanproportion=0;insertproportion=0;requestdistribution=uniform",
    "ycsb_d": "readproportion=0.95;updateproportion=0;scanproportion=0;insertproportion=0.05;requestdistribution=latest",
    "ycsb_e": "readproportion=0;updateproportion=0;scanproportion=0.95;insertproportion=0.05;requestdistribution=zipfian;maxscanlength=100",
    "ycsb_e1": "readproportion=0;updateproportion=0;scanproportion=0.70;insertproportion=0.30;requestdistribution=zipfian;maxscanlength=100",
    "ycsb_f": "readproportion=0.5;updateproportion=0;scanproportion=0;insertproportion=0;readmodifywriteproportion=0.5;requestdistribution=zipfian",
    "ycsb_f3": "readproportion=0.34;updateproportion=0;scanproportion=0.33;insertproportion=0.33;requestdistribution=zipfian;maxscanlength=30000",
    "ycsb_g": "readproportion=0;updateproportion=0;scanproportion=1;insertproportion=0;requestdistribution=zipfian;minscanlength=5000;maxscanlength=500000",
    "ycsb_h": "readproportion=0;updateproportion=0;scanproportion=1;insertproportion=0;requestdistribution=zipfian;maxscanlength=30000",
    "ycsb_h1": "readproportion=0;updateproportion=0;scanproportion=1;insertproportion=0;requestdistribution=zipfian;zipfian_const=1.2;maxscanlength=30000",
    "ycsb_h2": "readproportion=0;updateproportion=0;scanproportion=1;insertproportion=0;requestdistribution=zipfian;zipfian_const=1.5;maxscanlength=30000",
    "ycsb_h3": "readproportion=0;updateproportion=0;scanproportion=1;insertproportion=0;requestdistribution=zipfian;zipfian_const=0.7;maxscanlength=30000",
    "ycsb_h11": "readproportion=0;updateproportion=0;scanproportion=1;insertproportion=0;requestdistribution=uniform;maxscanlength=30000",
    "ycsb_i": "readproportion=0.5;updateproportion=0;scanproportion=0.5;insertproportion=0;requestdistribution=zipfian;maxscanlength=30000",
    "wiki_a": "readproportion=0.5;updateproportion=0;scanproportion=0;insertproportion=0.5;requestdistribution=zipfian",
    "wiki_a1": "readproportion=0.75;updateproportion=0;scanproportion=0;insertproportion=0.25;requestdistribution=zipfian",
    "wiki_a2": "readproportion=0.25;updateproportion=0;scanproportion=0;insertproportion=0.75;requestdistribution=zipfian",
    "wiki_c": "readproportion=1;updateproportion=0;scanproportion=0;insertproportion=0;requestdistribution=zipfian",
    "wiki_e": "readproportion=0;updateproportion=0;scanproportion=0.95;insertproportion=0.05;requestdistribution=zipfian;maxscanlength=100",
    "wiki_i": "readproportion=0.5;updateproportion=0;scanproportion=0.5;insertproportion=0;requestdistribution=uniform;minscanlength=500;maxscanlength=50000",
    "osm_a0": "readproportion=0.5;updateproportion=0;scanproportion=0;insertproportion=0.5;requestdistribution=latest",
    "osm_c": "readproportion=1;updateproportion=0;scanproportion=0;insertproportion=0;requestdistribution=zipfian",
    "osm_h": "readproportion=0;updateproportion=0;scanproportion=1;insertproportion=0;requestdistribution=zipfian;maxscanlength=100000",
}


def _properties(line: str) -> dict[str, str]:
    return dict(x.split("=") for x in line.split(";"))


MIXES = {name: w.mix_of(_properties(line)) for name, line in MIX_FILES.items()}


def _mix_folder(t: Tables) -> str:
    path = shared_path(t.spark, "mixes")
    lines = t.spark.createDataFrame([(name, "# a mix\n" + line.replace(";", "\n")) for name, line in MIX_FILES.items()], "mix string, value string")
    lines.repartition(1).write.partitionBy("mix").text(path)
    return path


_PROPERTIES = [f"('{name}', '{k}', '{v}')" for name, line in MIX_FILES.items() for k, v in _properties(line).items()]


@query(f"SELECT * FROM (VALUES {', '.join(_PROPERTIES)}) AS p(mix, key, value)")
def s07_mix_files(t: Tables) -> DataFrame:
    """The mixes' files, written and read: a row for each property."""
    return w.read_mix_properties(t.spark, _mix_folder(t))


def _op_sql(mix: w.Mix) -> str:
    at, cases, labels = 0.0, "", list(mix.operations)
    for label in labels[:-1]:
        at += mix.operations[label] / sum(mix.operations.values())
        cases += f"WHEN u0 < {at!r} THEN '{label}' "
    return f"CASE {cases}ELSE '{labels[-1]}' END" if cases else f"'{labels[-1]}'"


def _mixes_sql() -> str:
    tables, thetas = _draws_sql(0, 1, 2), sorted({m.theta for m in MIXES.values() if m.keys == "zipfian"})
    for theta in thetas:
        tables |= _scrambled_sql(1, f"s{round(100 * theta)}", _N, theta)
    parts = []
    for name, mix in MIXES.items():
        source, key = "d", f"floor(u1 * {_N})::BIGINT"
        if mix.keys == "latest":
            source, key = "d, z", f"n - 1 - {_zipf_of_sql('u1', mix.theta)}"
        elif mix.keys == "zipfian":
            source, key = f"d JOIN s{round(100 * mix.theta)} USING (id)", "key"
        length = f"{mix.scan_low} + floor(u2 * {mix.scan_high - mix.scan_low + 1})::BIGINT"
        drawn = f"SELECT '{name}' AS mix, id AS req_id, {_op_sql(mix)} AS op, {key} AS key_index, {length} AS length FROM {source}"
        parts.append(f"SELECT mix, req_id, op, key_index, CASE WHEN op = 'SCAN' THEN length ELSE 0 END AS scan_len FROM ({drawn})")
    return with_tables(" UNION ALL ".join(parts), "keys", z=_zipf_table_sql(_N, w.ZIPF_THETA), **tables)


@query(_mixes_sql())
def w27_mixes(t: Tables) -> DataFrame:
    """The requests of all mixes, one after the other."""
    return w.mixed_requests(_ids(t), w.read_mixes(t.spark, _mix_folder(t)), t.n_keys)


@query(with_tables(" UNION ALL ".join(f"SELECT '{n}' AS mix, {_op_sql(m)} AS op, count(*) AS n FROM d GROUP BY ALL" for n, m in MIXES.items()), **_draws_sql(0)))
def w27_mix_counts(t: Tables) -> DataFrame:
    return w27_mixes(t).groupBy("mix", "op").agg(F.count(F.lit(1)).alias("n"))


def _growing_sql(name: str) -> str:
    mix = MIXES[name]
    share = mix.operations["INSERT"] / sum(mix.operations.values())
    space = f"({_N} + floor((SELECT count(*) FROM events) * {share!r} * 2)::BIGINT)"
    tables = _draws_sql(0, 1, 2, *range(3, 3 + w.TRIES))
    for i in range(w.TRIES):
        tables |= _scrambled_sql(3 + i, f"k{i}", space, mix.theta)
    tables["ops"] = f"SELECT id, op, u2, n0 + count(*) FILTER (op = 'INSERT') OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (op = 'INSERT')::INT AS there FROM (SELECT *, {_op_sql(mix)} AS op, {_N} AS n0 FROM d)"
    tries = " ".join(f"WHEN k{i}.key < there THEN k{i}.key" for i in range(w.TRIES))
    joins = " ".join(f"JOIN k{i} USING (id)" for i in range(w.TRIES))
    key = f"CASE WHEN op = 'INSERT' THEN there {tries} ELSE k{w.TRIES - 1}.key % there END"
    length = f"CASE WHEN op = 'SCAN' THEN {mix.scan_low} + floor(u2 * {mix.scan_high - mix.scan_low + 1})::BIGINT ELSE 0 END"
    return with_tables(f"SELECT id AS req_id, op, ({key})::BIGINT AS key_index, {length} AS scan_len FROM ops {joins}", "keys", **tables)


@query(_growing_sql("ycsb_f3"))
def w27_growing_keys(t: Tables) -> DataFrame:
    """Reads, scans and inserts over a key space that the inserts extend."""
    return w.growing_requests(_ids(t), MIXES["ycsb_f3"], t.n_keys)


def _rank_spots_sql(low: str, high: str) -> str:
    step = f"(({high} - {low}) / 9.0)"
    return _mixture_sql([(1 / 8, f"{low} + {i + 1} * {step}", f"{step} / 12") for i in range(8)], 0)


def _rank_hotspots(low: float, high: float) -> list[tuple[float, float, float]]:
    step = (high - low) / 9
    return [(1 / 8, low + (i + 1) * step, step / 12) for i in range(8)]


_SCAN_LENGTH = "1 + floor(u5 * 30000)::BIGINT AS scan_len"


@query(with_tables(f"SELECT * FROM (SELECT id AS req_id, floor({_rank_spots_sql('0.0', 'n')})::BIGINT AS rank, {_SCAN_LENGTH} FROM d, (SELECT {_N} AS n)) WHERE rank BETWEEN 0 AND {_N} - 1", "keys", **_draws_sql(0, 1, 2, 5)))
def w28_rank_hotspot_scans(t: Tables) -> DataFrame:
    """Scans that begin at ranks around eight hotspots; draws beyond the keys are left out."""
    rank = F.floor(w.mixture_normal(_key(), _rank_hotspots(0, t.n_keys), 0)).cast("long")
    drawn = _ids(t).select("req_id", rank.alias("rank"), w.uniform_int(_key(), 1, 30_000, 5).alias("scan_len"))
    return drawn.filter(F.col("rank").between(0, t.n_keys - 1))


@query(with_tables(f"SELECT req_id, key, scan_len FROM (SELECT id AS req_id, floor({_rank_spots_sql('low', 'high')})::BIGINT AS key, {_SCAN_LENGTH}, low, high FROM d, (SELECT min(key)::DOUBLE AS low, max(key)::DOUBLE AS high FROM keys)) WHERE key BETWEEN low AND high", "keys", **_draws_sql(0, 1, 2, 5)))
def w29_key_hotspot_scans(t: Tables) -> DataFrame:
    """The same in key space."""
    low, high = t.key_range
    key = F.floor(w.mixture_normal(_key(), _rank_hotspots(low, high), 0)).cast("long")
    drawn = _ids(t).select("req_id", key.alias("key"), w.uniform_int(_key(), 1, 30_000, 5).alias("scan_len"))
    return drawn.filter(F.col("key").between(int(low), int(high)))
