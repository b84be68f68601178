"""Ordered work on hot keys: rows of one key cut into ranges of its order, so that no task sorts a whole key.

`range_blocks` cuts the rows of keys that hold many into blocks for windows; what a block needs from the ones before it is
carried over by one row per block. `value_ranges` cuts counted values again and again until no range holds many of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurekit.session import settled

# Rows or values one task orders at once.
MOST = 100_000
# Parts a range is cut into: the square of the number of splits looked at first.
PARTS = 256
_STEP = 16


def _splits(value: str) -> Column:
    """PARTS - 1 values that part the rows evenly, nearly: they decide how work is divided, never a result."""
    return F.percentile_approx(value, F.array(*[F.lit((k + 1) / PARTS) for k in range(PARTS - 1)]), F.lit(10 * PARTS))


def _part(splits: Column, value: Column) -> Column:
    """How many splits lie below a value; first among every 16th, then among the 16 after."""
    tops = F.transform(F.sequence(F.lit(_STEP), F.lit(PARTS - 1), F.lit(_STEP)), lambda k: F.element_at(splits, k))
    coarse = F.size(F.filter(tops, lambda s: s < value)) * _STEP
    return coarse + F.size(F.filter(F.slice(splits, coarse + 1, _STEP), lambda s: s < value))


def range_blocks(df: DataFrame, keys: list[str], order: str, most: int = MOST, ties: tuple[Column, ...] = ()) -> DataFrame:
    """Adds `block`: blocks of one key sort like its rows by `order`, and rows with one value are in one block or in blocks that sort by `ties`.

    A key of at most `most` rows is one block. The others are cut at approximate quantiles. A value that more than one quantile
    falls on is cut further by `ties`, which must sort like the columns that order its rows.
    """
    c = F.col
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(c("_n") > most).select(*[c(k).alias(f"_hot_{k}") for k in keys])
    same = [c(k).eqNullSafe(c(f"_hot_{k}")) for k in keys]
    of_hot = df.select(*keys, order).join(hot, same, "left_semi")
    splits = of_hot.groupBy(*keys).agg(_splits(order).alias("_splits")).select(*[c(k).alias(f"_hot_{k}") for k in keys], "_splits")
    part = _part(c("_splits"), c(order))
    heavy = F.coalesce(F.get("_splits", c("_part") + 1) == c(order), F.lit(False)) if ties else F.lit(False)
    out = df.join(splits, same, "left").withColumn("_part", F.coalesce(part, F.lit(0))).withColumn("_heavy", heavy)
    block = F.struct(c("_part").alias("part"), c("_heavy").alias("heavy"), *[F.when(c("_heavy"), t).alias(f"tie_{k}") for k, t in enumerate(ties)])
    return out.withColumn("block", block).select(*df.columns, "block")


def lagged(blocked: DataFrame, keys: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """Adds, under the names given, the values of the row before in the order of a key. `blocked` has the blocks of these keys or of fewer.

    A block's first row takes the last one of the block before.
    """
    row = F.struct(*[F.col(v).alias(n) for n, v in values.items()])
    here = Window.partitionBy(*keys, "block").orderBy(*order)
    tails = blocked.groupBy(*keys, "block").agg(F.max_by(row, F.struct(*order)).alias("tail"))
    carried = tails.withColumn("carry", F.lag("tail").over(Window.partitionBy(*keys).orderBy("block"))).drop("tail")
    # same keys as the window, so the join adds no shuffle of the rows
    out = blocked.withColumn("back", F.lag(row).over(here)).join(carried, [*keys, "block"], "left").withColumn("back", F.coalesce("back", "carry"))
    return out.select(*blocked.columns, *[F.col(f"back.{n}").alias(n) for n in values])


def value_ranges(counts: DataFrame, keys: list[str], most: int = MOST, ranks: DataFrame | None = None) -> DataFrame:
    """(keys, v, n, range, before) of counted values (keys, v, n): ranges that hold at most `most` values, and the rows in lower ranges.

    With ranks (keys, rank) only ranges that hold a wanted rank are kept and cut further. Each round counts the values of all ranges and cuts
    those with too many into PARTS; a few rounds do for any number of values. Rounds run when this function is called. Where the session has a
    checkpoint folder, the counts are kept there, so that a round does not count again.
    """
    c = F.col
    current = settled(counts).select(*keys, "v", "n", F.lit(0).cast("bigint").alias("range"), F.lit(0).cast("bigint").alias("before"))
    at = [*keys, "range", "before"]
    while True:
        large = current.groupBy(*at).agg(F.count("*").alias("values")).where(c("values") > most).drop("values")
        if large.isEmpty():
            return current
        splits = current.join(large, at, "left_semi").groupBy(*at).agg(_splits("v").alias("splits"))
        cut = current.join(splits, at, "left").withColumn("part", F.coalesce(_part(c("splits"), c("v")), F.lit(0))).drop("splits")
        held = cut.groupBy(*at, "part").agg(F.sum("n").alias("held"))
        below = F.coalesce(F.sum("held").over(Window.partitionBy(*at).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = held.withColumn("below", below)
        if ranks is not None:
            first = c("before") + c("below")
            wanted = held.join(ranks, keys).where((c("rank") >= first) & (c("rank") < first + c("held"))).select(*at, "part").distinct()
            held = held.join(wanted, [*at, "part"], "left_semi")
        current = cut.join(held.drop("held"), [*at, "part"]).select(
            *keys, "v", "n", (c("range") * PARTS + c("part")).alias("range"), (c("before") + c("below")).alias("before"))
