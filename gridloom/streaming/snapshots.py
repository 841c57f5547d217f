"""Streaming forms of the monitoring views. Event time in place of the snapshot loop's tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    """Watermarks need a timestamp with a zone; one without takes that of the session. Tables stay as they are."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if stream.isStreaming else stream


def tumbling(stream: DataFrame, ts: str, by: list[str], width: str = "40 seconds", late: str = "40 seconds") -> DataFrame:
    """start, by..., n: executions in each window; works on streams and on tables."""
    marked = _timed(stream, ts, late)
    counted = marked.groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), *by, "n")


def system_samples(stream: DataFrame, ts: str, values: list[str], width: str = "30 seconds", late: str = "30 seconds") -> DataFrame:
    """start and the last of each value in the window."""
    marked = _timed(stream, ts, late)
    last = marked.groupBy(F.window(ts, width)).agg(*(F.max_by(v, ts).alias(v) for v in values))
    return last.select(F.col("window.start").alias("start"), *values)


def running_totals(stream: DataFrame, key: str) -> DataFrame:
    """(key, total): executions so far, kept as state from batch to batch."""

    def add(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        total = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((total,))
        yield pd.DataFrame({"key": [k[0]], "total": [total]})

    return stream.groupBy(key).applyInPandasWithState(add, "key long, total long", "total long", "update", "NoTimeout")


def acknowledged(stream: DataFrame, id_: str, shards: int = 1) -> DataFrame:
    """(shard, last): the highest id up to which all ids of a shard (ids of one remainder) are acknowledged.

    State is the last id and the ids beyond the first gap, so it stays as small as the disorder of the stream.
    """

    def move(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, beyond = state.get if state.exists else (int(k[0]) - shards, [])
        waiting = set(beyond) | {int(i) for b in batches for i in b[id_]}
        while last + shards in waiting:
            last += shards
            waiting.discard(last)
        waiting = {i for i in waiting if i > last}
        state.update((last, sorted(waiting)))
        yield pd.DataFrame({"shard": [int(k[0])], "last": [last]})

    keyed = stream.withColumn("_shard", F.pmod(F.col(id_), F.lit(shards)).cast("long"))
    return keyed.groupBy("_shard").applyInPandasWithState(move, "shard long, last long", "last long, beyond array<long>", "update", "NoTimeout")


def rotate_ranks(samples: DataFrame, start: str, ranks: int) -> DataFrame:
    """samples (one for each window) with rank_a and rank_b: each sample in turn takes the next pair of ranks."""
    from gridloom.operators.ranking import global_rank

    numbered = global_rank(samples.withColumn("_at", F.unix_micros(F.col(start).cast("timestamp"))), "_at", [], "_k")
    first = 2 * (F.col("_k") - 1)
    return numbered.withColumn("rank_a", first % ranks).withColumn("rank_b", (first + 1) % ranks).drop("_k", "_at")
