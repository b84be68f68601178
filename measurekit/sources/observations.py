"""XML observation files: (time, parameter, value) triples and the count each file declares.

Files are cut into elements as text, in splits, and each element is parsed on its own: one that is no well-formed XML, or that lacks a
time or a parameter, is a row with a reason instead of values, and costs none of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from measurekit.sources.labels import label, roots_of

TRIPLE = "Time string, ParameterName string, ParameterValue string"
CORRUPT = "_corrupt_record"


def _reject_reason(corrupt: Column, time: Column, parameter: Column) -> Column:
    return (F.when(corrupt.isNotNull(), "MALFORMED").when(F.coalesce(F.trim(time), F.lit("")) == "", "NO_TIME")
            .when(F.coalesce(F.trim(parameter), F.lit("")) == "", "NO_PARAMETER"))


def parse_elements(elements: DataFrame, element: str = "element") -> DataFrame:
    """Adds time_raw, parameter, value_raw and reject_reason to rows that hold the text of one element each.

    reject_reason is NULL, MALFORMED, NO_TIME or NO_PARAMETER. A rejected row keeps its text and has no values.
    """
    row = F.from_xml(element, f"{TRIPLE}, {CORRUPT} string", {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    parsed = elements.withColumn("_x", row)
    parsed = parsed.withColumn("reject_reason", _reject_reason(F.coalesce(F.col(f"_x.{CORRUPT}"), F.when(F.col("_x").isNull(), "")), F.col("_x.Time"), F.col("_x.ParameterName")))
    kept = F.col("reject_reason").isNull()
    return parsed.withColumns({"time_raw": F.when(kept, F.col("_x.Time")), "parameter": F.when(kept, F.col("_x.ParameterName")),
                               "value_raw": F.when(kept, F.col("_x.ParameterValue"))}).drop("_x")


def element_texts(spark: SparkSession, paths: str, row_tag: str) -> DataFrame:
    """(source_file, element): the text of each element of that name, without name prefixes and attributes.

    The text is cut after each tag that ends with the name, so what comes before an end tag is what an element holds. Text of an observation
    that another element's start tag follows instead belongs to an element that was never closed.
    """
    c = F.col
    prefix = r"(?:[A-Za-z_][\w.-]*:)?"
    text = spark.read.option("lineSep", f"{row_tag}>").text(paths)
    closed = c("value").rlike(f"</{prefix}$")
    inner = F.regexp_replace(F.regexp_replace("value", f"</?{prefix}$", ""), f"(?s)^.*<{prefix}{row_tag}\\s[^>]*>", "")
    inner = F.regexp_replace(inner, rf"<(/?){prefix}([\w.-]+)(?:\s[^<>]*?)?(/?)>", "<$1$2$3>")
    holds = inner.rlike("<(?:Time|ParameterName|ParameterValue)/?>")
    return text.where(closed | holds).select(label(c("_metadata.file_path"), roots_of(spark, [paths])).alias("source_file"),
                                             F.concat(F.lit(f"<{row_tag}>"), inner, F.when(closed, f"</{row_tag}>").otherwise("")).alias("element"))


def read_observations(spark: SparkSession, paths: str, row_tag: str, station: str) -> DataFrame:
    """Long rows as `stage_observations` takes them. Namespace prefixes are ignored; values stay text."""
    rows = parse_elements(element_texts(spark, paths, row_tag)).where("reject_reason IS NULL")
    return rows.select("source_file", F.lit(station).alias("station"), "time_raw", "parameter", "value_raw").withColumn(
        "observation_id", F.concat_ws("/", "station", "parameter", "time_raw"))


def rejected_observations(spark: SparkSession, paths: str, row_tag: str) -> DataFrame:
    """(source_file, reject_reason, element): the elements of the files that are no observations, with their text."""
    return parse_elements(element_texts(spark, paths, row_tag)).where("reject_reason IS NOT NULL").select("source_file", "reject_reason", "element")


def declared_counts(spark: SparkSession, paths: str, root_tag: str) -> DataFrame:
    """Number of elements each file says it returns (attribute of its root element)."""
    rows = (spark.read.format("xml").option("rowTag", root_tag).option("ignoreNamespace", True).schema("_numberReturned bigint").load(paths))
    name = label(F.input_file_name(), roots_of(spark, [paths]))
    return rows.select(name.alias("source_file"), F.col("_numberReturned").alias("declared_rows"))
