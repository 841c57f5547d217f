"""Global ranks without a single-task sort."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one bucket of a global order, and buckets at most. A bucket is sorted by one task, which may spill.
BUCKET_ROWS, MOST_BUCKETS = 1 << 18, 4096
#: Edges that one expression looks through.
EDGES = 64


@dataclass(frozen=True)
class Buckets:
    """Value ranges of about equal numbers of rows, by quantiles. A value that fills a whole range is hot."""

    edges: list
    hot: list

    def of(self, value: Column) -> Column:
        """How many edges are at or below a value; among many edges the part of them is found first."""
        if not self.edges:
            return F.lit(0)
        count = lambda edges, v: F.size(F.filter(edges, lambda e: e <= v))
        if len(self.edges) <= EDGES:
            return count(F.array(*map(F.lit, self.edges)), value)
        parts = [self.edges[i : i + EDGES] for i in range(0, len(self.edges), EDGES)]
        firsts = F.array(*(F.lit(p[0]) for p in parts[1:]))
        all_parts = F.array(*(F.array(*map(F.lit, p)) for p in parts))
        part = count(firsts, value)
        return part * EDGES + count(F.get(all_parts, part), value)


def buckets_of(df: DataFrame, by: str, rows: int | None = None) -> Buckets:
    """Ranges of a numeric column; as many as its number of rows asks for."""
    n = df.count() if rows is None else rows
    buckets = min(MOST_BUCKETS, -(-n // BUCKET_ROWS))
    if buckets <= 1:
        return Buckets([], [])
    found = df.agg(F.percentile_approx(by, [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] or []
    return Buckets(sorted(set(found)), sorted({a for a, b in zip(found, found[1:], strict=False) if a == b}))


def global_rank(df: DataFrame, by: str, then: list[str], name: str = "rank") -> DataFrame:
    """Add the 1-based position in the order (by, *then). Rows are numbered inside value ranges, which are then shifted
    by the sizes of the ranges before; the table of sizes has a row for each range. The rows of a hot value, the first of
    its range, are divided by the next column of the order."""
    ranges, part = buckets_of(df, by), F.lit(0)
    if ranges.hot and then:
        hot = F.col(by).isin(ranges.hot)
        part = F.when(hot, buckets_of(df.filter(hot), then[0]).of(F.col(then[0]))).otherwise(MOST_BUCKETS)
    placed = df.withColumn("_bucket", ranges.of(F.col(by))).withColumn("_part", part)
    keys = ["_bucket", "_part"]
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(*keys, (F.sum("_n").over(Window.orderBy(*keys)) - F.col("_n")).alias("_before"))
    within = Window.partitionBy(*keys).orderBy(by, *then)
    return (
        placed.withColumn("_within", F.row_number().over(within))
        .join(before, keys)
        .withColumn(name, (F.col("_before") + F.col("_within")).cast("long"))
        .drop(*keys, "_before", "_within")
    )
