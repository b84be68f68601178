"""What files are there, are they the declared ones, and did they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from measurekit.config import Config
from measurekit.functions import text as X
from measurekit.functions import times as T
from measurekit.sources.labels import label, roots_of


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Path below the folder, size and checksums of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(label(F.col("path"), roots_of(spark, [path])).alias("source_file"), F.col("length").alias("size"),
                        F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def content_fingerprint(df: DataFrame, columns: list[str], name: str = "fingerprint") -> DataFrame:
    """One hash of a table of any size, whatever the order of its rows: their number, and the exclusive or and the sum of four
    60-bit slices of each row's hash. Every task hands over nine numbers; no rows or hashes are gathered. A cell is written with its
    length and a null as `-`, so no two different rows are written alike."""
    def cell(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    row = F.sha2(F.concat(*map(cell, columns)), 256)
    hashed = df.select(row.alias("h"))
    slices = [F.conv(F.substring("h", 1 + 16 * k, 15), 16, 10).cast("bigint") for k in range(4)]
    numbers = [F.count("*").cast("string"), *[F.coalesce(F.bit_xor(x), F.lit(0)).cast("string") for x in slices],
               *[F.coalesce(F.sum(x.cast("decimal(28,0)")), F.lit(0)).cast("decimal(38,0)").cast("string") for x in slices]]
    return hashed.agg(F.sha2(F.concat_ws(",", *numbers), 256).alias(name))


def snapshot_id(inventory: DataFrame) -> DataFrame:
    """Identity of a set of files: order-free hash of kind, name, checksum and size."""
    return content_fingerprint(inventory, ["kind", "source_file", "sha256", "size"], "snapshot_id")


def compare_with_pins(pins: DataFrame, inventory: DataFrame, row_counts: DataFrame | None = None) -> DataFrame:
    """Observed files against declared ones. The first difference of a file decides its status.

    `pins(source_file, pinned_size, pinned_sha256, pinned_rows)`; rows are compared where `row_counts(source_file, rows)` is given.
    """
    c = F.col
    joined = pins.join(inventory, "source_file", "full_outer")
    if row_counts is not None:
        joined = joined.join(row_counts, "source_file", "left")
    else:
        joined = joined.withColumn("rows", F.lit(None).cast("bigint"))
    pinned, found = c("pinned_size").isNotNull() | c("pinned_sha256").isNotNull(), c("sha256").isNotNull()
    status = (F.when(~pinned, "UNEXPECTED").when(~found, "MISSING").when(c("size") != c("pinned_size"), "SIZE_MISMATCH")
              .when(c("sha256") != c("pinned_sha256"), "CHECKSUM_MISMATCH").when(c("rows") != c("pinned_rows"), "ROW_COUNT_MISMATCH")
              .when(c("pinned_rows").isNotNull() & c("rows").isNull(), "NOT_CHECKED").otherwise("OK"))
    return joined.select("source_file", status.alias("status"))


def inventory_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that appeared, disappeared or changed between two inventories."""
    c = F.col
    a = before.select("source_file", c("sha256").alias("sha_before"))
    b = after.select("source_file", c("sha256").alias("sha_after"))
    change = (F.when(c("sha_before").isNull(), "appeared").when(c("sha_after").isNull(), "disappeared")
              .when(c("sha_before") != c("sha_after"), "changed"))
    return a.join(b, "source_file", "full_outer").select("source_file", change.alias("change")).where("change is not null")


def file_contract(inventory: DataFrame, headers: DataFrame, row_counts: DataFrame, cfg: Config) -> DataFrame:
    """Per file: population, rows, header variant and status, and the clock treatment it gets."""
    f: Column = F.col("source_file")
    return (inventory.join(headers.select("source_file", "variant", "header_status"), "source_file", "left")
            .join(row_counts, "source_file", "left")
            .select("source_file", X.population_of(f, cfg.populations).alias("population"), "rows", "variant", "header_status", "sha256",
                    T.override_label(f, cfg.overrides).alias("tz_handling"), T.override_offset(f, cfg.overrides).alias("tz_offset_hours")))
