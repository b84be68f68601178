"""Exact percentiles from ranks, for values too many to keep in one aggregate.

`percentile` keeps a map of distinct values per group: right for whole grams, heavy for one global group of many distinct
doubles. Here values are counted, the ranges that hold a wanted rank are cut until they hold few values, and only these are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from measurekit.operators.ranges import MOST, value_ranges


def value_counts(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, value, n): equal values combine before the shuffle."""
    return df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("v")).agg(F.count("*").alias("n"))


def ranked_percentiles(df: DataFrame, column: str, qs: list[float], keys: list[str] | None = None, most: int = MOST) -> DataFrame:
    """(keys, q, value) by linear interpolation at (n - 1) * q; rows whose keys are NULL are in no group.

    A wanted rank is looked for among counted values, in ranges cut until one holds at most `most` distinct values.
    """
    c = F.col
    for q in qs:
        if not 0 <= q <= 1:
            raise ValueError(f"q must lie in [0, 1], got {q}")
    shown = list(keys or [])
    if not keys:
        df, keys = df.withColumn("_all", F.lit(1)), ["_all"]
    counts = value_counts(df.dropna(subset=keys), column, keys)
    position = (c("total") - 1) * c("q")
    wanted = (counts.groupBy(*keys).agg(F.sum("n").alias("total")).withColumn("q", F.explode(F.array(*[F.lit(q) for q in qs])))
              .withColumn("lo_rank", F.floor(position).cast("bigint")).withColumn("hi_rank", F.least(c("lo_rank") + 1, c("total") - 1))
              .withColumn("fraction", position - c("lo_rank")).drop("total"))
    ranks = wanted.select(*keys, F.explode(F.array("lo_rank", "hi_rank")).alias("rank")).distinct()
    ranges = value_ranges(counts, keys, most, ranks)
    inside = Window.partitionBy(*keys, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranges.withColumn("upto", c("before") + F.sum("n").over(inside))

    def at(rank: str):
        return F.max(F.when((c(rank) >= c("upto") - c("n")) & (c(rank) < c("upto")), c("v")))

    pairs = ranked.join(wanted, keys).groupBy(*keys, "q").agg(at("lo_rank").alias("lo"), at("hi_rank").alias("hi"), F.max("fraction").alias("fraction"))
    return pairs.select(*shown, "q", (c("lo") + c("fraction") * (c("hi") - c("lo"))).alias("value"))


def neighbour_rank_percentile(df: DataFrame, column: str, q: float) -> DataFrame:
    """One value the way plain SQL writes it, with the ranks taken from value counts instead of a global row_number."""
    return ranked_percentiles(df, column, [q]).select("value")
