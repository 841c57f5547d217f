"""The key index: ordered (key, value) tables with lookups, range scans and a page layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ranking import buckets_of, global_rank

#: Entries of a page and its bytes.
PAGE_ENTRIES, PAGE_BYTES = 255, 4096


def upsert_latest(log: DataFrame) -> DataFrame:
    """(key, value) after all writes of (key, value, seq): the one with the highest seq wins. One shuffle, map-side combined."""
    return log.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def lookup(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Value of each request's key; null where there is none."""
    return requests.join(keys, "key", "left")


def scan(keys: DataFrame, start, n: int) -> DataFrame:
    """The first n entries with a key at or above start."""
    return keys.filter(F.col("key") >= F.lit(start)).orderBy("key").limit(n)


def lower_bound(probes: DataFrame, keys: DataFrame, probe: str = "key", name: str = "position") -> DataFrame:
    """How many keys are below each probe. Probes and keys meet in value ranges; there is no join on a range."""
    ranges = buckets_of(keys, "key")
    left = probes.select(F.struct("*").alias("_row"), F.col(probe).alias("_k"), F.lit(0).alias("_is_key"))
    right = keys.select(F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col("key").alias("_k"), F.lit(1).alias("_is_key"))
    both = left.unionByName(right).withColumn("_bucket", ranges.of(F.col("_k")))
    sizes = both.groupBy("_bucket").agg(F.sum("_is_key").alias("_n"))
    before = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    order = Window.partitionBy("_bucket").orderBy("_k", "_is_key").rowsBetween(Window.unboundedPreceding, -1)
    return (
        both.withColumn("_below", F.coalesce(F.sum("_is_key").over(order), F.lit(0)))
        .filter("_is_key = 0")
        .join(before, "_bucket")
        .select("_row.*", (F.col("_before") + F.col("_below")).cast("long").alias(name))
    )


def scan_many(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """(req_id, n, lo, hi) of many scans (req_id, key, scan_len): number, first and last key found.

    Each scan is two positions in the ranked keys, so long scans don't multiply rows: the first and last key come by
    two joins on the rank.
    """
    ranked = global_rank(keys, "key", [], "rank").select("rank", "key")
    total = keys.count()
    at = lower_bound(requests.select("req_id", "key", "scan_len"), keys)
    n = F.greatest(F.least(F.col("scan_len").cast("long"), F.lit(total) - F.col("position")), F.lit(0))
    spans = at.select("req_id", n.alias("n"), (F.col("position") + 1).alias("first"), (F.col("position") + n).alias("last"))
    first = ranked.select(F.col("rank").alias("first"), F.col("key").alias("lo"))
    last = ranked.select(F.col("rank").alias("last"), F.col("key").alias("hi"))
    return spans.join(first, "first", "left").join(last, "last", "left").select(
        "req_id", "n", F.when(F.col("n") > 0, F.col("lo")).alias("lo"), F.when(F.col("n") > 0, F.col("hi")).alias("hi")
    )


def page_layout(keys: DataFrame, entries: int = PAGE_ENTRIES) -> DataFrame:
    """keys with the page of a bulk load: consecutive runs of ``entries`` keys. Splitting page by page gives another layout."""
    ranked = global_rank(keys, "key", [], "rank")
    return ranked.withColumn("page", F.floor((F.col("rank") - 1) / entries).cast("long")).drop("rank")


def range_pages(pages: DataFrame, low, high) -> DataFrame:
    """Entries of [low, high) with their pages."""
    return pages.filter((F.col("key") >= F.lit(low)) & (F.col("key") < F.lit(high)))


def split_sizes(n: Column) -> tuple[Column, Column]:
    """Entries left and right of a leaf split: the right one gets n - n/2."""
    half = F.floor(n / 2).cast("long")
    return half, n - half


def successor(key: Column) -> Column:
    return key + 1


def string_key(s: Column, n: int) -> Column:
    """A key of n bytes: what fits before the closing zero."""
    return F.substring(s, 1, n - 1)
