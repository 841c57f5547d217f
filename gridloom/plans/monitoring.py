"""Counters, latencies and time-sliced views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import profiling as p
from gridloom.plans.tables import Tables, query, with_tables
from gridloom.streaming import snapshots

_C = [f"c{i}" for i in range(16)]
_FINITE = "CASE WHEN {0} IS NULL OR isnan({0}) OR isinf({0}) THEN 0 ELSE {0} END"


@query(with_tables("SELECT sample_id, round(c0 * (c2 / c3), 6) AS corrected FROM pmu", "pmu"))
def p01_multiplexed(t: Tables) -> DataFrame:
    return t.pmu.select("sample_id", F.round(p.multiplexed(F.col("c0"), F.col("c2"), F.col("c3")), 6).alias("corrected"))


@query(with_tables("SELECT sample_id, worker, cell FROM pmu QUALIFY row_number() OVER (PARTITION BY worker ORDER BY sample_id) % 100 = 0", "pmu"))
def p02_sample_100(t: Tables) -> DataFrame:
    return p.sample(t.pmu, "worker", "sample_id").select("sample_id", "worker", "cell")


@query(with_tables(f"SELECT sample_id, {_FINITE.format('c4')} AS c4 FROM pmu", "pmu"))
def p03_sanitised(t: Tables) -> DataFrame:
    return t.pmu.select("sample_id", p.finite(F.col("c4")).alias("c4"))


_VIEW = ", ".join(
    f"round(sum({_FINITE.format('c1')}), 4) AS c1" if c == "c1" else f"round(sum(({_FINITE.format(c)}) * 1000 / c1), 4) AS {c}" for c in _C
)


@query(with_tables(f"SELECT slice, cell, {_VIEW}, count(*) * 100 AS samples FROM pmu GROUP BY slice, cell", "pmu"))
def p04_data_view(t: Tables) -> DataFrame:
    return p.data_view(t.pmu, ["slice", "cell"], _C, "c1")


@query(with_tables("SELECT cell, count(*) * 100 AS samples FROM pmu GROUP BY cell", "pmu"))
def p05_sample_count(t: Tables) -> DataFrame:
    return t.pmu.groupBy("cell").agg((F.count(F.lit(1)) * p.SAMPLE_EVERY).alias("samples"))


_SLICED = "SELECT slice, cell, count(*) AS n FROM pmu GROUP BY ALL"


@query(with_tables("SELECT slice, cell, n, sum(n) OVER (PARTITION BY cell ORDER BY slice)::BIGINT AS total FROM sliced", "pmu", sliced=_SLICED))
def p06_cumulative(t: Tables) -> DataFrame:
    return p.cumulative(t.pmu.groupBy("slice", "cell").agg(F.count(F.lit(1)).alias("n")), ["cell"], "slice")


@query(with_tables("SELECT slice, worker, arg_max(c0, sample_id) AS c0 FROM pmu GROUP BY ALL", "pmu"))
def p07_last_sample(t: Tables) -> DataFrame:
    return p.last_sample(t.pmu, ["slice", "worker"], "sample_id", "c0")


@query(with_tables("SELECT sample_id, round(c8 * 64 / 1e6 / ((1000 + sample_id % 50) / 1000.0), 9) AS mbps FROM pmu", "pmu"))
def p08_bandwidth(t: Tables) -> DataFrame:
    ms = (1000 + F.col("sample_id") % 50).cast("double")
    return t.pmu.select("sample_id", F.round(p.bandwidth(F.col("c8"), ms), 9).alias("mbps"))


_CHANNEL = "SELECT sample_id % 4 AS socket, sample_id % 6 AS channel, CASE WHEN sample_id % 12 = 5 THEN -1 ELSE c8 END AS rd FROM pmu"


@query(with_tables("SELECT socket, round(sum(CASE WHEN rd >= 0 THEN rd ELSE 0 END), 6) AS rd FROM channels GROUP BY socket", "pmu", channels=_CHANNEL))
def p09_socket_bandwidth(t: Tables) -> DataFrame:
    channels = t.pmu.select((F.col("sample_id") % 4).alias("socket"), F.when(F.col("sample_id") % 12 == 5, F.lit(-1.0)).otherwise(F.col("c8")).alias("rd"))
    return p.socket_bandwidth(channels, ["socket"], "rd")


@query(with_tables("SELECT sample_id, round(c6 / (c6 + c8), 9) AS hit_rate, round(c10 * 64 / 1e6, 9) AS partial_mb FROM pmu", "pmu"))
def p10_memory_modes(t: Tables) -> DataFrame:
    return t.pmu.select("sample_id", F.round(F.try_divide(F.col("c6"), F.col("c6") + F.col("c8")), 9).alias("hit_rate"), F.round(F.col("c10") * 64 / 1e6, 9).alias("partial_mb"))


@query(with_tables("SELECT sample_id, greatest(c8 - c11, 0)::DOUBLE AS ad_bw, round(c6 / c11, 9) AS mm_ratio FROM pmu", "pmu"))
def p11_additional_bandwidth(t: Tables) -> DataFrame:
    return t.pmu.select(
        "sample_id", p.additional_bandwidth(F.col("c8"), F.col("c11")).alias("ad_bw"), F.round(F.try_divide(F.col("c6"), F.col("c11")), 9).alias("mm_ratio")
    )


@query(with_tables("SELECT sample_id % 4 AS socket, sample_id % 3 AS link, sum(c11)::BIGINT AS in_bytes, sum(c12)::BIGINT AS out_bytes FROM pmu GROUP BY ALL", "pmu"))
def p12_link_traffic(t: Tables) -> DataFrame:
    by = [(F.col("sample_id") % 4).alias("socket"), (F.col("sample_id") % 3).alias("link")]
    return t.pmu.groupBy(*by).agg(F.sum("c11").cast("long").alias("in_bytes"), F.sum("c12").cast("long").alias("out_bytes"))


@query(with_tables("SELECT sample_id, round(c1 / c0, 9) AS ipc, round(c15 / (2.0 * 1e3), 6) AS cpus, round(c0 / c15, 9) AS ghz FROM pmu", "pmu"))
def p13_ratios(t: Tables) -> DataFrame:
    found = p.ratios(F.col("c0"), F.col("c1"), F.col("c15"), F.lit(2.0e-6))
    return t.pmu.select("sample_id", *(F.round(c, 9).alias(k) for k, c in found.items()))


@query(with_tables("SELECT slice, sum(c8)::BIGINT AS rd, sum(c10)::BIGINT AS wr, sum(c8 + c10)::BIGINT AS memory FROM pmu GROUP BY slice", "pmu"))
def p14_system_totals(t: Tables) -> DataFrame:
    total = lambda c: F.sum(c).cast("long")
    return t.pmu.groupBy("slice").agg(total(F.col("c8")).alias("rd"), total(F.col("c10")).alias("wr"), total(F.col("c8") + F.col("c10")).alias("memory"))


_US = "round({0}(ns) / 1000.0, 6)::DOUBLE AS {1}_us"
_STATS = "count(ns) AS n, " + ", ".join(_US.format(f, f) for f in ("sum", "min", "max", "avg"))


@query(with_tables(f"SELECT op, {_STATS} FROM latency GROUP BY op", "latency"))
def p15_op_latency(t: Tables) -> DataFrame:
    return p.operation_stats(t.latency)


_POINTS = {"p90": 0.9, "p99": 0.99, "p999": 0.999, "p9999": 0.9999}


@query(with_tables("SELECT op, " + ", ".join(f"round(quantile_cont(ns, {v}), 4) AS {k}" for k, v in _POINTS.items()) + " FROM latency GROUP BY op", "latency"))
def p16_percentiles(t: Tables) -> DataFrame:
    return p.percentiles(t.latency, _POINTS)


@query(with_tables(f"SELECT CASE WHEN ok THEN op ELSE op || '-FAILED' END AS op, {_STATS} FROM latency GROUP BY ALL", "latency"))
def p17_status_split(t: Tables) -> DataFrame:
    return p.operation_stats(t.latency.select(p.by_status(F.col("op"), F.col("ok")).alias("op"), "ns"))


@query(with_tables("SELECT time_bucket(INTERVAL 1 DAY, ts::TIMESTAMP) AS start, cell, count(*) AS n FROM stream GROUP BY ALL", "stream"))
def x04_tumbling_exec(t: Tables) -> DataFrame:
    return snapshots.tumbling(t.stream, "ts", ["cell"], "1 day")


_RANKED = "SELECT start, arg_max(cell, (ts, cell)) AS cell, dense_rank() OVER (ORDER BY start) - 1 AS k FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ts::TIMESTAMP) AS start FROM stream) GROUP BY start"


@query(with_tables(f"SELECT start, cell, (2 * k) % 8 AS rank_a, (2 * k + 1) % 8 AS rank_b FROM ({_RANKED})", "stream"))
def x05_rank_rotation(t: Tables) -> DataFrame:
    """The sampled windows with the pair of memory ranks that is programmed in each, one pair after the other."""
    return snapshots.rotate_ranks(x05_system_samples(t), "start", 8)


@query(with_tables("SELECT time_bucket(INTERVAL 1 DAY, ts::TIMESTAMP) AS start, arg_max(cell, (ts, cell)) AS cell FROM stream GROUP BY ALL", "stream"))
def x05_system_samples(t: Tables) -> DataFrame:
    # ties of the time go to the higher cell
    marked = t.stream.select("ts", "cell", F.struct("ts", "cell").alias("at"))
    daily = marked.groupBy(F.window("ts", "1 day")).agg(F.max("at").alias("at"))
    return daily.select(F.col("window.start").alias("start"), F.col("at.cell").alias("cell"))
