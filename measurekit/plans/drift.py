"""The `events` table written as lines of delimited files whose layout drifts, so that the reader meets real rows at any table size.

Every event is a row of the file of its type and week. Five layouts: all columns; columns in another order with one that has no
name; one column nobody declared; the optional column missing; all columns, and a quote that is never closed. Rules on the event id
put line breaks, commas and quotes into cells, add cells beyond the header, cut rows short and leave blank lines between rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measurekit.functions import times as T
from measurekit.plans.roles import spread, table
from measurekit.sources.delimited import running_sum

REQUIRED, OPTIONAL = ("event_id", "ts", "amount"), ("note",)
MOST_LINES = 20
HEADERS = {"click": "event_id,ts,amount,note", "view": "amount,event_id,,ts", "purchase": "event_id,ts,amount,note,extra",
           "signup": "event_id,ts,amount", "error": "event_id,ts,amount,note"}
_BLOCK = 100_000


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_path, source_file, line_no, line) of the files; line 0 of each is its header."""
    i, kind = F.col("event_id"), F.col("event_type")
    number = i.cast("string")
    stray = (kind == "error") & (i % 997 == 0)
    quoted = kind.isin("click", "purchase")
    note = (F.when(stray, F.lit('"never closed'))
            .when(quoted & (i % 11 == 0), F.concat(F.lit('"line one\nline two, ""x"" '), number, F.lit('"')))
            .when(quoted & (i % 11 == 1), F.lit('"a, b"'))
            .when(quoted & (i % 11 == 2), F.lit('say "hi"'))
            .otherwise(F.concat(F.lit("n"), number)))
    amount = F.floor(F.col("value") * 10).cast("bigint").cast("string")
    time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    hidden = F.when(i % 13 == 0, "hidden").otherwise("")
    cells = (F.when(kind == "view", F.array(amount, number, hidden, time))
             .when(kind == "signup", F.array(number, time, amount))
             .when(kind == "purchase", F.array(number, time, amount, note, F.concat(F.lit("e"), number)))
             .otherwise(F.array(number, time, amount, note)))
    cells = F.when((i % 19 == 0) & ~stray, F.slice(cells, 1, 1)).when((i % 17 == 0) & ~stray, F.concat(cells, F.array(F.lit("more"), F.lit("cells")))).otherwise(cells)
    text = F.concat(F.array_join(cells, ","), F.when(i % 23 == 0, "\n , ,").otherwise(""))
    rows = spread(table(spark, sf_dir, "events"), "event_id").select(
        F.concat(kind, F.lit("_"), T.week_start(F.col("ts").cast("date")).cast("string"), F.lit(".csv")).alias("source_file"),
        i.alias("event_id"), F.floor(i / _BLOCK).alias("block"), F.split(text, "\n").alias("lines"), kind.alias("kind"))
    rows = running_sum(rows, ["source_file"], "block", "event_id", F.size("lines"), "before")
    body = rows.select("source_file", "before", F.posexplode("lines").alias("at", "line")).select(
        "source_file", (F.col("before") + F.col("at") + 1).alias("line_no"), "line")
    header = F.element_at(F.create_map(*[F.lit(x) for pair in HEADERS.items() for x in pair]), F.col("kind"))
    heads = rows.groupBy("source_file", "kind").agg(F.lit(0).cast("bigint").alias("line_no")).select("source_file", "line_no", header.alias("line"))
    return body.unionByName(heads).select(F.col("source_file").alias("source_path"), "source_file", "line_no", "line")


def event_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, element): every event as the text of an XML element; by rules on the id some are cut off, some lack a time or have a blank parameter."""
    i = F.col("event_id")
    time = F.when(i % 37 == 0, F.lit("")).otherwise(F.concat(F.lit("<t:Time>"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</t:Time>")))
    name = F.concat(F.lit("<t:ParameterName>"), F.when(i % 41 == 0, " ").otherwise(F.col("event_type")), F.lit("</t:ParameterName>"))
    value = F.concat(F.lit("<t:ParameterValue>"), F.when(i % 43 == 0, "a &lt; b &amp; c").otherwise(F.floor(F.col("value") * 10).cast("bigint").cast("string")), F.lit("</t:ParameterValue>"))
    end = F.when(i % 31 == 0, F.lit("")).otherwise(F.lit("</t:El>"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('<t:El xmlns:t="t">'), time, name, value, end).alias("element"))


def pinned_files(files: DataFrame) -> DataFrame:
    """What was declared of an inventory (source_file, sha256, size), by rules on the names: some files have another size or checksum or number of rows, some are not declared, and one is declared but not there."""
    name = F.col("source_file")
    pins = files.where(~name.endswith("-22.csv")).select(
        "source_file", (F.col("size") + F.when(name.endswith("-08.csv"), 1).otherwise(0)).alias("pinned_size"),
        F.when(name.endswith("-15.csv"), F.lit("other")).otherwise(F.col("sha256")).alias("pinned_sha256"),
        (F.col("size") + F.when(name.startswith("secondary_2024-01-01"), 5).otherwise(0)).alias("pinned_rows"))
    gone = files.agg(F.lit("gone.csv").alias("source_file"), F.count("*").alias("pinned_size"), F.lit("none").alias("pinned_sha256"), F.lit(1).cast("bigint").alias("pinned_rows"))
    return pins.unionByName(gone)
