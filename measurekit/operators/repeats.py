"""Exact repeats inside a file: the first copy counts, later copies are marked and kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def repeat_groups(staged: DataFrame) -> DataFrame:
    """(file, row hash) groups with more than one copy. Copies combine before the shuffle, so a hot group stays one small row."""
    return (staged.groupBy("source_file", "row_sha256")
            .agg(F.count("*").alias("copies"), F.min("source_row_number").alias("first_row_number"))
            .where("copies > 1")
            .select("source_file", "row_sha256", "first_row_number"))


def mark_repeats(staged: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Adds `is_repeat` and `repeats_event_id`. `groups` is `repeat_groups(staged)`, given where it is kept as a table.

    The rows are joined to the few repeated groups rather than ranked in a window: a group of copies that holds a large share
    of all rows would be one task of a window, while the join is broadcast when the groups are small and split on hot keys
    when they are not.
    """
    joined = staged.join(repeat_groups(staged) if groups is None else groups, ["source_file", "row_sha256"], "left")
    later = F.col("first_row_number").isNotNull() & (F.col("source_row_number") > F.col("first_row_number"))
    return (joined.withColumn("is_repeat", later)
            .withColumn("repeats_event_id", F.when(later, F.concat_ws("#", "source_file", F.col("first_row_number").cast("string"))))
            .drop("first_row_number"))


def duplicated_members(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row whose key occurs more than once."""
    dup = df.groupBy(*keys).count().where("count > 1").drop("count")
    return df.join(dup, keys, "left_semi")


def natural_key_duplicates(staged: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of equal natural keys: how many in all, within one population, across populations."""
    groups = (staged.groupBy(*keys)
              .agg(F.count("*").alias("rows"), (F.min("population") != F.max("population")).alias("across"))
              .where("rows > 1"))
    return groups.agg(F.count("*").alias("groups"), F.count_if(~F.col("across")).alias("within_population"),
                      F.count_if("across").alias("across_populations"))


def inversions(staged: DataFrame) -> DataFrame:
    """Per file: rows whose time lies before the previous row's time. Row order is reported, never relied on.

    The previous row is found inside (file, hour-of-rows) blocks, and across blocks by the last row of the block before, so no
    task sorts a whole file.
    """
    block_rows = 100_000
    timed = (staged.where(F.col("event_local").isNotNull())
             .select("source_file", "source_row_number", "event_local",
                     F.floor(F.col("source_row_number") / block_rows).alias("block")))
    in_block = Window.partitionBy("source_file", "block").orderBy("source_row_number")
    inner = (timed.withColumn("previous", F.lag("event_local").over(in_block))
             .groupBy("source_file", "block")
             .agg(F.count("*").alias("rows"), F.count_if(F.col("previous") > F.col("event_local")).alias("inverted"),
                  F.min_by("event_local", "source_row_number").alias("head"),
                  F.max_by("event_local", "source_row_number").alias("tail")))
    blocks = Window.partitionBy("source_file").orderBy("block")
    return (inner.withColumn("before", F.lag("tail").over(blocks))
            .groupBy("source_file")
            .agg(F.sum("rows").alias("rows"),
                 F.sum(F.col("inverted") + F.when(F.col("before") > F.col("head"), 1).otherwise(0)).alias("inversions")))
