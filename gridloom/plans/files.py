"""Sources and sinks. Where a query needs a file in one of the formats, it writes it first, through Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import grid, workload
from gridloom.plans.tables import CELLS, SIDE, Tables, query, with_tables
from gridloom.sources import files
from gridloom.sources.shared import shared_path


def _folder(t: Tables, name: str) -> str:
    return shared_path(t.spark, name)


def _text(t: Tables, df: DataFrame, name: str) -> str:
    path = _folder(t, name)
    df.write.text(path)
    return path


@query(with_tables("SELECT l, r, b, t FROM rects", "rects"))
def s01_rect_scan(t: Tables) -> DataFrame:
    return files.read_rects(t.spark, _text(t, t.rects.select(F.concat_ws(" ", "l", "r", "b", "t").alias("value")), "rects"))


@query(with_tables("SELECT l AS x, b AS y FROM rects", "rects"))
def s02_point_scan(t: Tables) -> DataFrame:
    return files.read_points(t.spark, _text(t, t.rects.select(F.concat_ws(" ", "l", "r", "b", "t").alias("value")), "rects"))


@query(with_tables("SELECT key::VARCHAR AS key FROM keys", "keys"))
def s03_key_scan(t: Tables) -> DataFrame:
    lines = t.keys.select(F.concat_ws(" ", F.lit("INSERT"), "key").alias("value"))
    return files.read_keys(t.spark, _text(t, lines, "keys")).select(F.col("key").cast("string").alias("key"))


@query(with_tables("SELECT key, key AS own, (key * 7919 + 17) % 1000003 AS drawn FROM keys", "keys"))
def s04_value_synthesis(t: Tables) -> DataFrame:
    """Both kinds of values: the key itself, and a number that looks random but follows from the key."""
    return t.keys.select("key", workload.own_value(F.col("key")).alias("own"), workload.drawn_value(F.col("key")).alias("drawn"))


@query(with_tables("SELECT cid, numa::INT AS numa, cpu::INT AS cpu FROM placement", "placement"))
def s05_placement_parse(t: Tables) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("cid", "numa", "cpu")))
    both = t.placement.agg(ordered.alias("p")).select(
        F.array_join(F.concat(F.transform("p", lambda x: x["numa"].cast("string")), F.transform("p", lambda x: x["cpu"].cast("string"))), " ").alias("value")
    )
    return files.read_placement(t.spark, _text(t, both, "placement")).select("cid", "numa", "cpu")


@query(with_tables("""SELECT 'shipped' AS mode, cid, numa + 2 AS numa, cpu FROM placement UNION ALL SELECT 'learned', cid, numa + 30, cpu FROM placement""", "placement"))
def s06_placement_resolver(t: Tables) -> DataFrame:
    """Placements of two machines, modes, workloads, configurations and storages; two are chosen by their parts."""
    path = _folder(t, "placements")
    parts = F.explode(F.array(*(
        F.struct(F.lit(m).alias("machine"), F.lit(mode).alias("mode"), F.lit(w).alias("workload"), F.lit(c).alias("config"), F.lit(st).alias("storage"), F.lit(x).alias("x"))
        for m, a in (("skx", 0), ("ice", 100)) for mode, w, b in (("shipped", -1, 0), ("learned", 11, 20), ("learned", 12, 30)) for c in (1, 2) for st, e in (("keys", 0), ("rects", 1000))
        for x in [a + b + e + (2 if c == 2 and mode == "shipped" else 0)]
    ))).alias("p")
    every = t.placement.select(parts, "cid", "numa", "cpu").select("p.*", "cid", "numa", "cpu")
    files.write_placements(every.withColumn("numa", F.col("numa") + F.col("x")).drop("x"), path)
    shipped = files.resolve_placement(t.spark, path, "skx", "shipped", 12, 2, "keys").withColumn("mode", F.lit("shipped"))
    learned = files.resolve_placement(t.spark, path, "skx", "learned", 12, 2, "keys").withColumn("mode", F.lit("learned"))
    return shipped.unionByName(learned).select("mode", "cid", "numa", "cpu")


@query("SELECT 'readproportion' AS key, '0.75' AS value UNION ALL SELECT 'recordcount', '1000' UNION ALL SELECT 'requestdistribution', 'zipfian'")
def s07_props_parse(t: Tables) -> DataFrame:
    text = "# a mix\nrecordcount = 10\n readproportion=0.75 \nrequestdistribution=zipfian\n#scanproportion=1\nrecordcount=1000"
    path = _text(t, t.spark.range(1).select(F.lit(text).alias("value")), "mix")
    return files.read_properties(t.spark, path).select("key", "value")


@query(with_tables("SELECT target, cid, [cid * 0.5 + add, cid * 0.25 + add, 1.0 + add, add]::DOUBLE[] AS coef FROM cells_1d, (VALUES ('accesses', 0.125), ('instructions', 0.0)) AS x(target, add)", "cells_1d"))
def s08_coefficients(t: Tables) -> DataFrame:
    """The model's coefficients for each cell, a file for each target."""
    path = _folder(t, "coefficients")
    c = F.col("cid").cast("double")
    for target, add in (("accesses", 0.125), ("instructions", 0.0)):
        own = F.concat_ws(" ", *((v + add).cast("string") for v in (c * 0.5, c * 0.25, F.lit(1.0), F.lit(0.0))))
        lines = t.cells_1d.select(F.struct("cid", own.alias("line")).alias("x")).agg(F.sort_array(F.collect_list("x")).alias("x"))
        lines.select(F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("value")).write.text(f"{path}/target={target}")
    found = files.read_coefficients(t.spark, path)
    return found.select(F.regexp_extract("file", "target=([^/]+)", 1).alias("target"), "cid", "coef")


@query(with_tables("""SELECT key FROM (SELECT key, row_number() OVER (ORDER BY key) - 1 AS p2 FROM (SELECT key, row_number() OVER (ORDER BY key) - 1 AS p1 FROM keys) WHERE p1 % 4 <> 0) WHERE p2 % 4 = 0""", "keys"))
def s09_systematic_sample(t: Tables) -> DataFrame:
    return workload.systematic_sample(t.keys, "key").select("key")


_VIEW = "SELECT 1 AS config, (event_id // 2500)::INT AS slice, 12 AS workload, 0 AS index, (event_id % 256)::INT AS cell, count(*) AS n FROM events GROUP BY ALL"


def _view(t: Tables) -> DataFrame:
    id_ = F.col("event_id").cast("long")
    return t.base("events").groupBy(
        F.lit(1).alias("config"), F.floor(id_ / 2500).cast("int").alias("slice"), F.lit(12).alias("workload"), F.lit(0).alias("index"), (id_ % 256).cast("int").alias("cell")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT config, slice, workload, index, cell, n FROM ({_VIEW})")
def s13_query_view_sink(t: Tables) -> DataFrame:
    """The long form, appended by configuration and slice and read back."""
    path = _folder(t, "view")
    files.write_view(_view(t), path)
    return t.spark.read.parquet(path).select("config", "slice", "workload", "index", "cell", "n")


@query(f"SELECT config, slice, workload, index, cell, n FROM ({_VIEW})")
def s15_view_parse(t: Tables) -> DataFrame:
    """The line form, written and read; cells without a count are left out again."""
    path = _folder(t, "lines")
    files.write_query_lines(_view(t), path, 256)
    return files.read_query_view(t.spark, path).filter("n > 0")


_MEM = "SELECT 1 AS config, range::INT AS slice, 12 AS workload, 0 AS index FROM range(3)"
_KINDS = " UNION ALL ".join(
    f"SELECT config, slice, workload, index, '{k}' AS kind, (p // {c})::INT AS socket, (p % {c})::INT AS channel, (slice * 100 + p + {o})::DOUBLE AS value FROM mem, (SELECT range AS p FROM range({4 * c}))"
    for k, c, o in (("rd", 6, 0), ("wr", 6, 24), ("upi_in", 3, 48), ("upi_out", 3, 60))
)


@query(f"WITH mem AS ({_MEM}) {_KINDS}")
def s11_memory_view(t: Tables) -> DataFrame:
    numbers = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: (F.col("id") * 100 + i).cast("string"))
    lines = t.spark.range(3).select(F.concat_ws(" ", F.lit("1"), F.col("id").cast("string"), F.lit("12"), F.lit("0"), F.array_join(numbers, " ")).alias("value"))
    return files.read_memory_view(t.spark, _text(t, lines, "memory"))


_COUNTERS = ", ".join(f"coalesce(sum(CASE WHEN isnan(c{i}) THEN NULL ELSE c{i} END), 0)" for i in range(16))
_DATA = f"SELECT slice, cell, [{_COUNTERS}] AS v, count(*) AS samples FROM pmu GROUP BY ALL"
_EVERY = f"SELECT slice, range AS cell FROM (SELECT DISTINCT slice FROM pmu), range({CELLS})"


@query(with_tables("""SELECT 1 AS config, slice::INT AS slice, 12 AS workload, 0 AS index, cell::INT AS cell, i::INT AS counter, coalesce(v[i + 1], 0.0)::DOUBLE AS value, coalesce(samples, 0)::BIGINT AS samples
 FROM every LEFT JOIN data USING (slice, cell), (SELECT range AS i FROM range(16))""", "pmu", data=_DATA, every=_EVERY))
def s12_data_view_sink(t: Tables) -> DataFrame:
    """All counters and the samples of each cell, appended as lines by slice and read back."""
    path = _folder(t, "data-view")
    total = lambda c: F.sum(F.when(~F.isnan(c), F.col(c)))
    view = t.pmu.groupBy("slice", "cell").agg(F.array(*(total(f"c{i}") for i in range(16))).alias("counters"), F.count(F.lit(1)).alias("samples"))
    head = (F.lit(1).alias("config"), F.col("slice").cast("int"), F.lit(12).alias("workload"), F.lit(0).alias("index"), F.col("cell").cast("int"))
    files.write_data_lines(view.select(*head, "counters", "samples"), path, CELLS)
    return files.read_data_view(t.spark, path, CELLS)


@query(with_tables("SELECT x.cid AS cell_a, y.cid AS cell_b, count(*) AS n FROM rect_cells x JOIN rect_cells y USING (id) WHERE x.cid < y.cid GROUP BY ALL", "rect_cells"))
def s14_correlation_view(t: Tables) -> DataFrame:
    from gridloom.plans.key_queries import rect_cells

    cells = rect_cells(t)
    other = cells.select("id", F.col("cid").alias("cell_b"))
    pairs = cells.join(other, "id").filter(F.col("cid") < F.col("cell_b"))
    return pairs.groupBy(F.col("cid").alias("cell_a"), "cell_b").agg(F.count(F.lit(1)).alias("n"))


_ROW = ", ".join(f"coalesce(sum(n) FILTER (WHERE cid % {SIDE} = {j}), 0)::BIGINT AS c{j}" for j in range(SIDE))


@query(with_tables(f"SELECT cid // {SIDE} AS i, {_ROW} FROM (SELECT cid, count(id) AS n FROM cells_2d LEFT JOIN rect_cells USING (cid) GROUP BY cid) GROUP BY i", "rect_cells"))
def s16_grid_dump(t: Tables) -> DataFrame:
    """Objects for each cell as the grid's rows and columns."""
    from gridloom.plans.key_queries import rect_cells

    counts = t.spark.range(CELLS).select(F.col("id").alias("cid")).join(grid.cells_histogram(rect_cells(t)), "cid", "left")
    wide = grid.matrix(counts.select("cid", F.coalesce("n", F.lit(0)).alias("n")), "n", SIDE)
    return wide.select("i", *(F.coalesce(F.col(f"`{j}`"), F.lit(0)).alias(f"c{j}") for j in range(SIDE)))


_DONE = "op IN ('READ', 'SCAN', 'INSERT')"
_AT = f"cid // {SIDE} AS i, cid % {SIDE} AS j"


@query(with_tables(f"""SELECT view, {_AT}, value::BIGINT AS value FROM (
 SELECT 'pushed' AS view, cid, count(*) AS value FROM moved GROUP BY ALL UNION ALL SELECT 'completed', cid, count(*) FILTER ({_DONE}) FROM moved GROUP BY ALL
 UNION ALL SELECT 'outstanding', cid, count(*) FILTER (NOT {_DONE}) FROM moved GROUP BY ALL UNION ALL SELECT 'keys', cid, count(*) FROM key_cells GROUP BY ALL
 UNION ALL SELECT 'numa', cid, numa FROM placement)""", "key_cells", "request_cells", "placement",
 chosen="SELECT req_id, cells[(req_id % len(cells)) + 1] AS cid FROM (SELECT req_id, list_sort(list(DISTINCT cid)) AS cells FROM request_cells GROUP BY req_id)", moved="SELECT cid, op FROM chosen JOIN requests USING (req_id)"))
def s16_grid_views(t: Tables) -> DataFrame:
    """What the grid holds and does, a row for each view and cell at (i, j)."""
    from gridloom.plans.key_queries import g11_pushed_completed, key_cells

    at = (F.floor(F.col("cid") / SIDE).alias("i"), (F.col("cid") % SIDE).alias("j"))
    views = grid.long_views(g11_pushed_completed(t), ["pushed", "completed", "outstanding"])
    views = views.unionByName(grid.long_views(grid.cells_histogram(key_cells(t)).withColumnRenamed("n", "keys"), ["keys"]))
    return views.unionByName(grid.long_views(t.placement, ["numa"])).select("view", *at, "value")


@query(with_tables("SELECT cell_a, cell_b, n FROM (SELECT x.cid AS cell_a, y.cid AS cell_b, count(*) AS n FROM rect_cells x JOIN rect_cells y USING (id) WHERE x.cid < y.cid GROUP BY ALL) WHERE cell_a < 10 AND cell_b < 10", "rect_cells"))
def s16_correlation_corner(t: Tables) -> DataFrame:
    """The first ten cells' part of the correlation matrix."""
    return s14_correlation_view(t).filter("cell_a < 10 AND cell_b < 10")
