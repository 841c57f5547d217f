"""Text formats of rectangles, keys, placements, properties and monitoring views, read and written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _words(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(file, line): lines, or whole files, as arrays of words."""
    lines = spark.read.text(path, wholetext=whole).withColumn("file", F.input_file_name())
    return lines.select("file", F.filter(F.split(F.trim("value"), r"\s+"), lambda w: w != "").alias("words")).filter(F.size("words") > 0)


def read_rects(spark: SparkSession, path: str) -> DataFrame:
    """l, r, b, t of a rectangle on each line; a line that has no four numbers gives nulls."""
    lines = _words(spark, path)
    return lines.select(*(F.get("words", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate("lrbt")))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """x, y of the low corners on each line."""
    return read_rects(spark, path).select(F.col("l").alias("x"), F.col("b").alias("y"))


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """Keys of the INSERT lines of a load file, exact up to 20 digits."""
    lines = _words(spark, path).filter(F.col("words")[0] == "INSERT")
    return lines.select(F.get("words", F.lit(1)).try_cast("decimal(20,0)").alias("key"))


def read_placement(spark: SparkSession, path: str) -> DataFrame:
    """file, cid, numa, cpu: the first half of a file's numbers are nodes, the second half cpus. Files are small."""
    files = _words(spark, path, whole=True).select("file", F.transform("words", lambda w: w.try_cast("int")).alias("v"), (F.size("words") / 2).cast("int").alias("n"))
    numa, cpu = F.slice("v", F.lit(1), F.col("n")), F.slice("v", F.col("n") + 1, F.col("n"))
    both = files.select("file", F.posexplode(F.arrays_zip(numa.alias("numa"), cpu.alias("cpu"))).alias("cid", "p"))
    return both.select("file", F.col("cid").cast("long"), "p.numa", "p.cpu")


#: Folders of placements, from the outside in.
PLACEMENT_KEYS = ["machine", "mode", "workload", "config", "storage"]


def write_placements(placements: DataFrame, path: str) -> None:
    """Append placements (PLACEMENT_KEYS, cid, numa, cpu) by folders; mode tells shipped from learned ones."""
    placements.write.mode("append").partitionBy(*PLACEMENT_KEYS).parquet(path)


def resolve_placement(spark: SparkSession, path: str, machine: str, mode: str, workload: int, config: int, storage: str) -> DataFrame:
    """cid, numa, cpu of one placement; only its folder is read. Shipped placements hold for any workload."""
    chosen = {"machine": machine, "mode": mode, "workload": -1 if mode == "shipped" else workload, "config": config, "storage": storage}
    found = spark.read.parquet(path)
    for key, value in chosen.items():
        found = found.filter(F.col(key) == value)
    return found.select("cid", "numa", "cpu")


def read_coefficients(spark: SparkSession, path: str, n: int = 4) -> DataFrame:
    """file, cid, coef: a file's numbers are ``n`` coefficients for each cell in turn. Files are small: n numbers a cell."""
    words = _words(spark, path, whole=True).select("file", F.posexplode("words").alias("p", "w"))
    at = words.select("file", F.floor(F.col("p") / n).cast("long").alias("cid"), (F.col("p") % n).alias("i"), F.col("w").try_cast("double").alias("v"))
    return at.groupBy("file", "cid").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("coef"))


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """file, key, value of ``key=value`` lines; # comments are left out, both sides trimmed, the last of equal keys wins."""
    lines = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "line")
    )
    line = F.trim("line")
    at = F.instr(line, "=")
    pairs = lines.filter(~line.startswith("#") & (at > 0)).select(
        "file", "pos", F.trim(F.expr("substring(trim(line), 1, instr(trim(line), '=') - 1)")).alias("key"),
        F.trim(F.expr("substring(trim(line), instr(trim(line), '=') + 1)")).alias("value"),
    )
    return pairs.groupBy("file", "key").agg(F.max_by("value", "pos").alias("value"))


def typed(properties: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """One row for each file with a column for each default."""
    return properties.groupBy("file").agg(
        *(F.coalesce(F.max(F.when(F.col("key") == k, F.col("value"))), F.lit(v)).alias(k) for k, v in defaults.items())
    )


HEAD = ["config", "slice", "workload", "index"]


def _view(spark: SparkSession, path: str) -> DataFrame:
    lines = _words(spark, path)
    return lines.select("file", *(F.col("words")[i].cast("int").alias(c) for i, c in enumerate(HEAD)), F.expr("slice(words, 5, size(words))").alias("v"))


def read_query_view(spark: SparkSession, path: str) -> DataFrame:
    """config, slice, workload, index, cell, n of lines with a count for each cell."""
    rows = _view(spark, path).select(*HEAD, F.posexplode("v").alias("cell", "n"))
    return rows.withColumn("n", F.col("n").cast("long"))


def write_data_lines(df: DataFrame, path: str, n_cells: int, n_counters: int = 16) -> None:
    """Append a data view (head, cell, counters array, samples) as lines: head, the counters of each cell in turn, then the
    samples of each cell; 0 where there is nothing."""
    wide = df.groupBy(*HEAD).agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct("counters", "samples")))).alias("m"))
    cells = F.sequence(F.lit(0), F.lit(n_cells - 1))
    none = F.array(*[F.lit(0.0)] * n_counters)
    counters = F.flatten(F.transform(cells, lambda c: F.coalesce(F.try_element_at("m", c)["counters"], none)))
    samples = F.transform(cells, lambda c: F.coalesce(F.try_element_at("m", c)["samples"], F.lit(0)).cast("string"))
    values = F.concat(F.transform(counters, lambda v: F.coalesce(v, F.lit(0.0)).cast("string")), samples)
    wide.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in HEAD), F.array_join(values, " ")).alias("value")).write.mode("append").text(path)


def read_data_view(spark: SparkSession, path: str, n_cells: int, n_counters: int = 16) -> DataFrame:
    """config, slice, workload, index, cell, counter, value, samples: a row for each counter of each cell."""
    rows = _view(spark, path).withColumn("samples", F.expr(f"slice(v, {n_cells * n_counters + 1}, {n_cells})"))
    at = rows.select(*HEAD, "samples", F.posexplode(F.slice("v", 1, n_cells * n_counters)).alias("p", "value"))
    cell = F.floor(F.col("p") / n_counters).cast("int")
    return at.select(
        *HEAD, cell.alias("cell"), (F.col("p") % n_counters).alias("counter"), F.col("value").cast("double").alias("value"),
        F.get("samples", cell).cast("long").alias("samples"),
    )


def read_memory_view(spark: SparkSession, path: str, sockets: int = 4, channels: int = 6, links: int = 3) -> DataFrame:
    """config, slice, workload, index, kind (rd, wr, upi_in, upi_out), socket, channel, value of lines of all four groups."""
    rows = _view(spark, path).select(*HEAD, F.posexplode("v").alias("p", "value"))
    mem, upi = sockets * channels, sockets * links
    kind = F.when(F.col("p") < mem, "rd").when(F.col("p") < 2 * mem, "wr").when(F.col("p") < 2 * mem + upi, "upi_in").otherwise("upi_out")
    at = F.when(F.col("p") < 2 * mem, F.col("p") % mem).otherwise((F.col("p") - 2 * mem) % upi)
    per = F.when(F.col("p") < 2 * mem, F.lit(channels)).otherwise(F.lit(links))
    return rows.select(*HEAD, kind.alias("kind"), F.floor(at / per).cast("int").alias("socket"), (at % per).cast("int").alias("channel"), F.col("value").cast("double").alias("value"))


def write_view(df: DataFrame, path: str) -> None:
    """Append a view in long form, by configuration and slice."""
    df.write.mode("append").partitionBy("config", "slice").parquet(path)


def write_query_lines(df: DataFrame, path: str, n_cells: int) -> None:
    """Append a query view as lines: head and a count for each cell, 0 where there is none."""
    wide = df.groupBy(*HEAD).agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("m"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(n_cells - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("string"))
    wide.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in HEAD), F.array_join(counts, " ")).alias("value")).write.mode("append").text(path)


def read_binary_keys(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, key of files of unsigned 64-bit little-endian integers after a count of the same kind.

    A file is one row of at most 2 GB; larger sets come as several files.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    n = (F.octet_length("content") / 8).cast("int") - 1
    at = files.select("path", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    eight = F.reverse(F.expr("substring(hex(substring(content, 9 + pos * 8, 8)), 1, 16)"))
    # reversing hex digits turns bytes and nibbles around; pairs are put right again
    hexes = F.regexp_replace(eight, "(.)(.)", "$2$1")
    return at.select(F.col("path").alias("file"), "pos", F.conv(hexes, 16, 10).cast("decimal(20,0)").alias("key"))
