"""Hardware counters, bandwidths and latencies: corrections, samples and time-sliced views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ranking import buckets_of

# Fixed order of the sixteen counters.
COUNTERS = [
    "cycles", "instructions", "l1d_misses", "l1i_misses", "llc_misses", "branch_misses", "memory_misses", "dtlb_miss",
    "memory_accesses", "llc_write_misses", "memory_write_misses", "local_dram", "remote_dram", "cycles_l3_miss",
    "cycles_mem_any", "task_clock",
]
SAMPLE_EVERY = 100


def multiplexed(value: Column, enabled: Column, running: Column) -> Column:
    """A counter that ran for a part of the time, brought up to the whole; null if it never ran."""
    return value * F.try_divide(enabled, running)


def finite(value: Column) -> Column:
    """0 for null, NaN and infinite values."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0.0)).otherwise(value)


def sample(executions: DataFrame, worker: str, seq: str, every: int = SAMPLE_EVERY) -> DataFrame:
    """Each ``every``-th execution of a worker: the last one of its group."""
    place = F.row_number().over(Window.partitionBy(worker).orderBy(seq))
    return executions.withColumn("_n", place).filter(F.col("_n") % every == 0).drop("_n")


def data_view(pmu: DataFrame, by: list[str], counters: list[str], instructions: str) -> DataFrame:
    """Sums by cell of each counter for 1000 instructions; the instructions themselves are summed as they are."""
    per = lambda c: finite(F.try_divide(finite(F.col(c)) * 1000, finite(F.col(instructions))))
    sums = [F.round(F.sum(finite(F.col(c)) if c == instructions else per(c)), 4).alias(c) for c in counters]
    return pmu.groupBy(*by).agg(*sums, (F.count(F.lit(1)) * SAMPLE_EVERY).alias("samples"))


def cumulative(counts: DataFrame, by: list[str], slice_: str, n: str = "n") -> DataFrame:
    """Counts carried on from slice to slice."""
    order = Window.partitionBy(*by).orderBy(slice_).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("total", F.sum(n).over(order))


def last_sample(samples: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    """The last sample of each slice."""
    return samples.groupBy(*by).agg(F.max_by(value, ts).alias(value))


def bandwidth(events: Column, ms: Column) -> Column:
    """MB/s of transfers of 64 bytes."""
    return F.try_divide(events * 64 / 1e6, ms / 1000.0)


def socket_bandwidth(channels: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sum over channels; an inactive one is -1 and not counted."""
    return channels.groupBy(*by).agg(F.round(F.sum(F.when(F.col(value) >= 0, F.col(value)).otherwise(0.0)), 6).alias(value))


def additional_bandwidth(total: Column, miss: Column) -> Column:
    return F.greatest(total - miss, F.lit(0.0))


def ratios(cycles: Column, instructions: Column, task_clock: Column, seconds: Column) -> dict[str, Column]:
    return {
        "ipc": F.try_divide(instructions, cycles),
        "cpus": F.try_divide(task_clock, seconds * 1e9),
        "ghz": F.try_divide(cycles, task_clock),
    }


def operation_stats(latency: DataFrame, op: str = "op", ns: str = "ns") -> DataFrame:
    """Count, sum, least, greatest and mean latency in microseconds of each operation."""
    us = lambda c: F.round(c / 1000.0, 6)
    return latency.groupBy(op).agg(
        F.count(ns).alias("n"), us(F.sum(ns)).alias("sum_us"), us(F.min(ns)).alias("min_us"), us(F.max(ns)).alias("max_us"), us(F.avg(ns)).alias("avg_us")
    )


def percentiles(latency: DataFrame, points: dict[str, float], op: str = "op", ns: str = "ns") -> DataFrame:
    """Exact interpolated percentiles of latency. Equal values are counted first, and positions come from counts in value
    ranges, so no task holds all values of an operation."""
    known = latency.filter(F.col(ns).isNotNull())
    counts = known.groupBy(op, ns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_range", buckets_of(known, ns).of(F.col(ns)))
    sizes = counts.groupBy(op, "_range").agg(F.sum("_n").alias("_size"))
    whole = Window.partitionBy(op)
    before = F.sum("_size").over(whole.orderBy("_range")) - F.col("_size")
    sizes = sizes.select(op, "_range", before.alias("_before"), F.sum("_size").over(whole).alias("_all"))
    upto = F.sum("_n").over(Window.partitionBy(op, "_range").orderBy(ns)) + F.col("_before")
    placed = counts.join(sizes, [op, "_range"]).withColumn("_upto", upto)

    def at(place: Column) -> Column:
        """The value at a position from 0."""
        return F.max(F.when((place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_n")), F.col(ns)))

    place = {name: (F.col("_all") - 1) * F.lit(p) for name, p in points.items()}
    ends = placed.groupBy(op).agg(
        F.max("_all").alias("_all"),
        *(at(F.floor(x)).alias(f"_low_{name}") for name, x in place.items()),
        *(at(F.ceil(x)).alias(f"_high_{name}") for name, x in place.items()),
    )
    between = lambda name, x: F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * (x - F.floor(x))
    return ends.select(op, *(F.round(between(name, x).cast("double"), 4).alias(name) for name, x in place.items()))


def by_status(op: Column, ok: Column) -> Column:
    """The label an operation is counted under."""
    return F.when(ok, op).otherwise(F.concat(op, F.lit("-FAILED")))
