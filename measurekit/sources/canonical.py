"""Tables with a declared schema: read as declared, written in a fixed order."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_canonical(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table by its declared schema. Another header refuses the table."""
    header = spark.read.option("header", True).csv(path).columns
    if header != schema.names:
        raise ValueError(f"{path}: columns {header} are not the declared {schema.names}")
    return spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").schema(schema).csv(path)


def with_row_contract(df: DataFrame, expected_rows: int, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """The table, and a check to call after it was read by an action: another number of rows than recorded refuses it.

    The rows are counted as they go by, in the scan the action makes anyway: write or collect the table as it is. An action that reads
    only its first rows has not seen all of them, one that sorts it by range has seen them twice, and the check says so.
    """
    seen = Observation(f"rows-{uuid.uuid4().hex}")

    def check() -> None:
        rows = seen.get["rows"]
        if rows != expected_rows:
            raise ValueError(f"{name}: {rows} rows, {expected_rows} recorded")

    return df.observe(seen, F.count(F.lit(1)).alias("rows")), check


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text: lists joined by `;` in sorted order, booleans in lower case, NULL as empty text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        text = F.array_join(F.array_sort(c), ";") if isinstance(f.dataType, T.ArrayType) else c.cast("string")
        out.append(F.coalesce(text, F.lit("")).alias(f.name))
    return df.select(*out)


def write_table(df: DataFrame, path: str, sort: list[str], partitions: int | None = None) -> None:
    """Sorted CSV. The sort is by range, so the files follow each other in order; ask for one partition to get one file."""
    ordered = df.orderBy(*sort) if partitions is None else df.repartitionByRange(partitions, *sort).sortWithinPartitions(*sort)
    as_text(ordered).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """JSON lines, NULL fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
