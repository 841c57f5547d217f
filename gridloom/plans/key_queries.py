"""Key index, grid, routing and execution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import grid, keyindex, workload
from gridloom.plans.tables import CELLS, SIDE, Tables, query, with_tables


def key_cells(t: Tables) -> DataFrame:
    return grid.key_cells(t.keys, t.cells_1d, *t.key_range, CELLS)


def request_cells(t: Tables) -> DataFrame:
    return grid.key_cells(t.requests, t.cells_1d, *t.key_range, CELLS)


def rect_cells(t: Tables) -> DataFrame:
    return grid.rect_cells(t.rects, t.cells_2d, t.rect_range, SIDE, SIDE).select("id", "cid")


@query(with_tables("SELECT c.cid, p.numa, count(*) AS n FROM key_cells c JOIN placement p USING (cid) GROUP BY ALL", "key_cells", "placement"))
def g12_keys_per_cell_numa(t: Tables) -> DataFrame:
    counted = grid.cells_histogram(key_cells(t))
    return counted.join(t.placement, "cid").select("cid", "numa", "n")


@query("SELECT range AS i, CASE WHEN range = 10 THEN 7.5::DOUBLE ELSE 0.5::DOUBLE + ((7.5::DOUBLE - 0.5::DOUBLE) / 10) * range END AS x FROM range(11)")
def g01_linspace(t: Tables) -> DataFrame:
    return t.spark.range(11).select(F.col("id").alias("i"), grid.linspace(0.5, 7.5, 11, F.col("id")).alias("x"))


@query(with_tables("SELECT * FROM cells_2d", "cells_2d"))
def g02_grid_cells(t: Tables) -> DataFrame:
    return t.cells_2d


@query(with_tables("SELECT c.*, p.numa, p.cpu FROM cells_2d c JOIN placement p USING (cid)", "cells_2d", "placement"))
def g03_placed_cells(t: Tables) -> DataFrame:
    return t.cells_2d.join(t.placement, "cid")


@query(with_tables(f"SELECT cid, cid // ({CELLS} // 56 + 1) AS cpu FROM cells_1d", "cells_1d"))
def g04_default_placement(t: Tables) -> DataFrame:
    return grid.default_placement(t.cells_1d.select("cid"), CELLS, 56)


@query(with_tables("SELECT req_id, cid FROM request_cells", "request_cells"))
def g05_request_cells(t: Tables) -> DataFrame:
    return request_cells(t).select("req_id", "cid")


@query(with_tables("SELECT id, cid FROM rect_cells", "rect_cells"))
def g06_rect_cells(t: Tables) -> DataFrame:
    return rect_cells(t)


@query(with_tables("SELECT req_id, key FROM requests WHERE req_id NOT IN (SELECT req_id FROM request_cells)", "request_cells"))
def g07_unroutable(t: Tables) -> DataFrame:
    return grid.unroutable(t.requests, request_cells(t)).select("req_id", "key")


_CHOSEN = "SELECT req_id, cells[(req_id % len(cells))::INT + 1] AS cid FROM (SELECT req_id, list_sort(list(DISTINCT cid)) AS cells FROM request_cells GROUP BY req_id)"


@query(with_tables(_CHOSEN, "request_cells"))
def g08_chosen_cell(t: Tables) -> DataFrame:
    return grid.choose_cell(request_cells(t))


@query(with_tables("SELECT req_id, cid, numa, cpu FROM chosen JOIN placement USING (cid)", "request_cells", "placement", chosen=_CHOSEN))
def g09_routed(t: Tables) -> DataFrame:
    return grid.route(grid.choose_cell(request_cells(t)), t.placement).select("req_id", "cid", "numa", "cpu")


_CO = """SELECT a AS cell_a, b AS cell_b, sum(n)::BIGINT AS n FROM (
 SELECT x.cid AS a, y.cid AS b, count(*) AS n FROM ranked x JOIN ranked y ON x.id = y.id AND x.p <= y.p AND x.p < x.m GROUP BY ALL
 UNION ALL SELECT y.cid, x.cid, count(*) FROM ranked x JOIN ranked y ON x.id = y.id AND x.p <= y.p AND x.p < x.m GROUP BY ALL) GROUP BY ALL"""


@query(with_tables(_CO, "rect_cells", ranked="SELECT id, cid, row_number() OVER (PARTITION BY id ORDER BY cid) AS p, count(*) OVER (PARTITION BY id) AS m FROM rect_cells"))
def g10_cooccurrence(t: Tables) -> DataFrame:
    return grid.co_access(rect_cells(t), "id")


@query(with_tables("""SELECT cid, count(*) AS pushed, count(*) FILTER (WHERE op IN ('READ', 'SCAN', 'INSERT')) AS completed,
 count(*) FILTER (WHERE op NOT IN ('READ', 'SCAN', 'INSERT')) AS outstanding FROM chosen JOIN requests USING (req_id) GROUP BY cid""", "request_cells", chosen=_CHOSEN))
def g11_pushed_completed(t: Tables) -> DataFrame:
    both = grid.choose_cell(request_cells(t)).join(t.requests.select("req_id", "op"), "req_id")
    done = F.col("op").isin("READ", "SCAN", "INSERT")
    return both.groupBy("cid").agg(F.count(F.lit(1)).alias("pushed"), F.count_if(done).alias("completed"), F.count_if(~done).alias("outstanding"))


@query(with_tables("SELECT page, min(numa)::BIGINT AS numa FROM (SELECT *, (row_number() OVER (ORDER BY key) - 1) // 255 AS page FROM keys) JOIN key_cells USING (key) JOIN placement USING (cid) GROUP BY page", "key_cells", "placement"))
def g13_page_placement(t: Tables) -> DataFrame:
    pages = keyindex.page_layout(t.keys).select("key", "page")
    owned = pages.join(key_cells(t).select("key", "cid"), "key").join(t.placement, "cid")
    return owned.groupBy("page").agg(F.min("numa").alias("numa"))


_CLASS = "CASE WHEN scan_len < 20 THEN 'MICE' WHEN scan_len < 80 THEN 'ELEPHANT' ELSE 'MAMMOTH' END"


@query(with_tables(f"SELECT cid, {_CLASS} AS qclass, count(*) AS n FROM chosen JOIN requests USING (req_id) GROUP BY ALL", "request_cells", chosen=_CHOSEN))
def g14_class_counts(t: Tables) -> DataFrame:
    qclass = F.when(F.col("scan_len") < 20, "MICE").when(F.col("scan_len") < 80, "ELEPHANT").otherwise("MAMMOTH")
    both = grid.choose_cell(request_cells(t)).join(t.requests.select("req_id", qclass.alias("qclass")), "req_id")
    return both.groupBy("cid", "qclass").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n AS numa, c AS slot, 12 * n + c AS cpu, CASE WHEN c = 1 THEN 'router' WHEN c = 2 THEN 'sweeper' WHEN c BETWEEN 3 AND 9 THEN 'worker' ELSE 'idle' END AS part
 FROM (SELECT range AS n FROM range(8)), (SELECT range AS c FROM range(12))""")
def g15_topology(t: Tables) -> DataFrame:
    slot = F.col("id") % 12
    part = F.when(slot == 1, "router").when(slot == 2, "sweeper").when(slot.between(3, 9), "worker").otherwise("idle")
    return t.spark.range(96).select(F.floor(F.col("id") / 12).alias("numa"), slot.alias("slot"), F.col("id").alias("cpu"), part.alias("part"))


@query(with_tables("SELECT numa, count(DISTINCT cpu) AS cpus, count(*) AS cells FROM placement GROUP BY numa", "placement"))
def g16_registry(t: Tables) -> DataFrame:
    return t.placement.groupBy("numa").agg(F.countDistinct("cpu").alias("cpus"), F.count(F.lit(1)).alias("cells"))


@query(with_tables("SELECT req_id, cpu, row_number() OVER (PARTITION BY cpu ORDER BY scan_len DESC, req_id) AS place FROM chosen JOIN placement USING (cid) JOIN requests USING (req_id)", "request_cells", "placement", chosen=_CHOSEN))
def g17_priority_order(t: Tables) -> DataFrame:
    routed = grid.route(grid.choose_cell(request_cells(t)), t.placement).join(t.requests.select("req_id", "scan_len"), "req_id")
    return grid.priority_order(routed, "scan_len", "req_id").select("req_id", "cpu", F.col("place").cast("long").alias("place"))


@query(with_tables("SELECT cid, round(1.5 * lx + 0.25 * (hx - lx) + 2.0 * cid + 3.0, 6) AS stamp FROM cells_1d", "cells_1d"))
def g18_linear_model(t: Tables) -> DataFrame:
    coefficients = F.array(*(F.lit(v) for v in (1.5, 0.25, 2.0, 3.0)))
    features = [F.col("lx"), F.col("hx") - F.col("lx"), F.col("cid").cast("double"), F.lit(1.0)]
    return t.cells_1d.select("cid", F.round(grid.linear_model(features, coefficients), 6).alias("stamp"))


# --- key index ---------------------------------------------------------------------------------------------------


@query(with_tables("SELECT key, arg_max(value, seq) AS value FROM key_log GROUP BY key", "key_log"))
def k01_upsert_latest(t: Tables) -> DataFrame:
    return keyindex.upsert_latest(t.key_log)


@query(with_tables("SELECT key, arg_max(value, seq) AS value FROM (SELECT key, value, -1 AS seq FROM keys UNION ALL SELECT * FROM key_log) GROUP BY key", "keys", "key_log"))
def k02_upsert_into_keys(t: Tables) -> DataFrame:
    return keyindex.upsert_latest(t.keys.withColumn("seq", F.lit(-1).cast("long")).unionByName(t.key_log))


@query(with_tables("SELECT req_id, k.value FROM requests q LEFT JOIN keys k USING (key)", "requests", "keys"))
def k03_lookup(t: Tables) -> DataFrame:
    return keyindex.lookup(t.requests.select("req_id", "key"), t.keys).select("req_id", "value")


@query(with_tables("""SELECT req_id, count(key) AS n, min(key) AS lo, max(key) AS hi FROM starts LEFT JOIN ranked ON rank BETWEEN start + 1 AND start + scan_len GROUP BY req_id""", "requests", "keys",
 ranked="SELECT key, row_number() OVER (ORDER BY key) AS rank FROM keys",
 starts="SELECT req_id, scan_len, coalesce((SELECT max(rank) FROM ranked r WHERE r.key < q.key), 0) AS start FROM requests q WHERE op = 'SCAN'"))
def k04_scan_many(t: Tables) -> DataFrame:
    return keyindex.scan_many(t.requests.filter("op = 'SCAN'"), t.keys)


@query(with_tables("SELECT key, value FROM keys WHERE key >= 1000 ORDER BY key LIMIT 300", "keys"))
def k04_scan_one(t: Tables) -> DataFrame:
    return keyindex.scan(t.keys, 1000, 300)


_PAGED = "SELECT key, value, (row_number() OVER (ORDER BY key) - 1) // 255 AS page FROM keys"


@query(with_tables("SELECT key, page, numa FROM paged JOIN key_cells USING (key) JOIN placement USING (cid) WHERE key >= 500 AND key < 2500", "key_cells", "placement", paged=_PAGED))
def k05_range_pages(t: Tables) -> DataFrame:
    pages = keyindex.range_pages(keyindex.page_layout(t.keys), 500, 2500).select("key", "page")
    return pages.join(key_cells(t).select("key", "cid"), "key").join(t.placement, "cid").select("key", "page", "numa")


@query(with_tables("SELECT key, page FROM (SELECT * FROM paged WHERE key >= 500 ORDER BY key LIMIT 1000) WHERE page > (SELECT min(page) FROM paged WHERE key >= 500)", "keys", paged=_PAGED))
def k06_moved_pages(t: Tables) -> DataFrame:
    """The scan's pages but for the first one, which such a migration leaves where it is."""
    found = keyindex.scan(keyindex.page_layout(t.keys).drop("value"), 500, 1000)
    first = found.agg(F.min("page").alias("first"))
    return found.crossJoin(F.broadcast(first)).filter("page > first").select("key", "page")


@query(with_tables("SELECT numa, count(DISTINCT page) AS pages FROM paged JOIN key_cells USING (key) JOIN placement USING (cid) GROUP BY numa", "key_cells", "placement", paged=_PAGED))
def k07_pages_per_numa(t: Tables) -> DataFrame:
    pages = keyindex.page_layout(t.keys).select("key", "page")
    owned = pages.join(key_cells(t).select("key", "cid"), "key").join(t.placement, "cid")
    return owned.groupBy("numa").agg(F.countDistinct("page").alias("pages"))


@query(with_tables("SELECT req_id, coalesce((SELECT max(rank) FROM ranked r WHERE r.key < q.key), 0) AS position FROM requests q", "requests", "keys", ranked="SELECT key, row_number() OVER (ORDER BY key) AS rank FROM keys"))
def k08_lower_bound(t: Tables) -> DataFrame:
    return keyindex.lower_bound(t.requests.select("req_id", "key"), t.keys).select("req_id", "position")


@query(with_tables("SELECT page, n, n // 2 AS n_left, n - n // 2 AS n_right FROM (SELECT page, count(*) AS n FROM paged GROUP BY page)", "keys", paged=_PAGED))
def k09_leaf_split(t: Tables) -> DataFrame:
    sizes = keyindex.page_layout(t.keys).groupBy("page").agg(F.count(F.lit(1)).alias("n"))
    left, right = keyindex.split_sizes(F.col("n"))
    return sizes.select("page", "n", left.alias("n_left"), right.alias("n_right"))


@query(with_tables("SELECT page // 255 AS parent, count(*) AS n, max(sep)::BIGINT AS separator FROM (SELECT page, max(key) AS sep FROM paged GROUP BY page) GROUP BY parent", "keys", paged=_PAGED))
def k10_inner_pages(t: Tables) -> DataFrame:
    leaves = keyindex.page_layout(t.keys).groupBy("page").agg(F.max("key").alias("sep"))
    return leaves.groupBy(F.floor(F.col("page") / 255).alias("parent")).agg(F.count(F.lit(1)).alias("n"), F.max("sep").alias("separator"))


@query(with_tables("SELECT key, page FROM paged", "keys", paged=_PAGED))
def k12_page_layout(t: Tables) -> DataFrame:
    return keyindex.page_layout(t.keys).select("key", "page")


@query(with_tables("SELECT count(DISTINCT page) AS pages, count(DISTINCT page) * 4096 AS bytes FROM paged", "keys", paged=_PAGED))
def k13_index_size(t: Tables) -> DataFrame:
    return keyindex.page_layout(t.keys).agg(F.countDistinct("page").alias("pages")).select("pages", (F.col("pages") * keyindex.PAGE_BYTES).alias("bytes"))


@query(with_tables("SELECT key, key + 1 AS next FROM keys", "keys"))
def k16_successor(t: Tables) -> DataFrame:
    return t.keys.select("key", keyindex.successor(F.col("key")).alias("next"))


@query("SELECT c_custkey::BIGINT AS id, substring(c_name, 1, 15) AS skey, substring(c_name, 1, 15) < 'Customer#000000500' AS below FROM customer")
def k17_string_keys(t: Tables) -> DataFrame:
    key = keyindex.string_key(F.col("c_name"), 16)
    return t.base("customer").select(F.col("c_custkey").cast("long").alias("id"), key.alias("skey"), (key < "Customer#000000500").alias("below"))


# --- execution ---------------------------------------------------------------------------------------------------


@query(with_tables("""SELECT q.req_id, op, k.value AS result FROM requests q LEFT JOIN keys k USING (key) WHERE op IN ('READ', 'READMODIFYWRITE')
 UNION ALL SELECT req_id, op, value FROM requests WHERE op IN ('INSERT', 'UPDATE')
 UNION ALL SELECT req_id, 'SCAN', least(scan_len, (SELECT count(*) FROM keys) - start) FROM starts""", "requests", "keys",
 ranked="SELECT key, row_number() OVER (ORDER BY key) AS rank FROM keys",
 starts="SELECT req_id, scan_len, coalesce((SELECT max(rank) FROM ranked r WHERE r.key < q.key), 0) AS start FROM requests q WHERE op = 'SCAN'"))
def x01_mixed_ops(t: Tables) -> DataFrame:
    return workload.run_mixed(t.requests, t.keys)


@query(with_tables("SELECT key, arg_max(value, seq) AS value FROM (SELECT key, value, -1 AS seq FROM keys UNION ALL SELECT key, value, req_id FROM requests WHERE op IN ('INSERT', 'UPDATE', 'READMODIFYWRITE')) GROUP BY key", "keys", "requests"))
def x01_keys_after_writes(t: Tables) -> DataFrame:
    return workload.apply_writes(t.keys, t.requests)
