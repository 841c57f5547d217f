"""Rendezvous sharding over weighted shards, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridloom.llm.common import settle, shuffle_width

#: Hash values in [0, 2^53) become uniform draws in (0, 1).
_DRAWS = 1 << 53


def _score(key: Column, shard: int, weight: float) -> Column:
    """Rendezvous score of a shard for a key: -ln(u) / weight is least for the winner, so a shard wins in proportion to its weight."""
    draw = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / _DRAWS
    return F.struct((F.log(draw) / F.lit(float(weight))).alias("score"), F.lit(-shard).alias("tie"))


def rendezvous_shard(key: Column, weights: list[float]) -> Column:
    """The shard 0..len(weights)-1 of a key. Only key and weights decide. A new shard at the end takes keys only into itself."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scores = [_score(key, i, w) for i, w in enumerate(weights)]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["tie"]).cast("int")


def shard_documents(
    df: DataFrame,
    n_shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: list[float] | None = None,
    new_weight: float = 1.0,
) -> DataFrame:
    """Deal documents to weighted shards by rendezvous hashing of their ids.

    Returns doc_id, size (UTF-8 bytes of the text, null: none, plus 16), text_crc32 (of a null text: 0, as of an
    empty one), law ``key``, shard, slot (gapless from 0 in each shard), grown_shard (the shard
    with one more at the end, which moves rows only into itself).

    The id alone decides, so rows with one id meet in one shard and a null id is a key like any other. Slots do not
    need a shard's rows in one task: rows are numbered in sub-blocks of (shard, block of the written row number) and
    shifted by the sizes of the blocks before, so a repeated id or a heavy shard is spread like any other rows.
    An empty table gives an empty result; other columns are ignored.
    """
    weights = weights or [1.0] * n_shards
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.col(f"`{id_col}`")
    rows = df.select(
        key.alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous_shard(key, weights).alias("shard"),
        rendezvous_shard(key, [*weights, new_weight]).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = settle(rows, "shards")
    blocks = max(4, shuffle_width(df.sparkSession))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    sizes = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    # at most shards x blocks rows, a table whose size does not follow the documents
    before = sizes.select(
        "shard",
        "block",
        (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before"),
    )
    numbered = rows.withColumn(
        "within", F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "row"))
    )
    return numbered.join(F.broadcast(before), ["shard", "block"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("before") + F.col("within") - 1).cast("long").alias("slot"),
        "grown_shard",
    )
