"""Drift-tolerant scan of delimited event files: columns by name, nothing repaired, nothing lost.

The files are read as text, so ragged rows, blank header cells and cells beyond the header stay visible. A file is known by its
full path; `source_file` is its path below the folder read. One scan serves every header variant: a row looks its cells up by
name in the header of its own file. Only files in which a quoted cell spans lines are read again, to join these lines.

A quote opens a cell only where a cell starts; anywhere else it is text. What a line does to an open or a closed quote is known from
the line alone, so the state at every line follows from these effects put together block by block, and a record's first and last
line are known before any lines are joined. A quote that no line closes within MOST_LINES lines opens nothing: its line is a row
of its own, marked OPEN_QUOTE, and the lines after it are read as if it were not there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from measurekit.session import settled
from measurekit.sources.labels import label, roots_of

# Stands for a comma outside quotes while a line is cut. Unicode keeps this code point out of text.
_CUT = "\uffff"
# Lines of a joined file numbered in one task.
_BLOCK = 100_000
# Lines a record may span.
MOST_LINES = 1_000

# Where a reader stands in a line.
_START, _INSIDE, _QUOTED, _ENDED = 0, 1, 2, 3        # at a cell's start, inside a bare cell, inside quotes, at a quote inside quotes


# Pieces of a line that are put together at once.
_CHUNK = 256


def _over(at: Column, piece: Column) -> Column:
    """The state after a piece of text without a quote."""
    bare = F.when(F.endswith(piece, F.lit(",")), _START).otherwise(_INSIDE)
    return F.when((at == _QUOTED) | (piece == ""), at).otherwise(bare)


def _quote(at: Column) -> Column:
    """The state after a quote: one at a cell's start or in a pair stands inside quotes, one inside a bare cell changes nothing."""
    return F.when(at == _INSIDE, _INSIDE).when(at == _QUOTED, _ENDED).otherwise(_QUOTED)


def _text(at: Column, piece: Column, quote: bool) -> Column:
    """What a piece entered in a state adds to the cells, and the quote after it: bare commas become cuts; quotes around a cell go."""
    text = F.when(at == _QUOTED, piece).otherwise(F.replace(piece, F.lit(","), F.lit(_CUT)))
    after = _over(at, piece)
    return F.concat(text, F.when((after == _INSIDE) | (after == _ENDED), '"').otherwise("")) if quote else text


def cells_of(record: Column) -> Column:
    """All cells of one record; the quotes around a cell are removed and doubled quotes in it halved.

    The record is cut at its quotes; the state goes from piece to piece. Pieces are put together chunk by chunk, so a record of many quotes
    takes time in proportion to its length.
    """
    pieces = F.split(record, '"', -1)
    chunks = F.sequence(F.lit(0), F.floor((F.size(pieces) - 2) / _CHUNK).cast("int"))
    none = F.array().cast("array<string>")

    def step(acc: Column, piece: Column) -> Column:
        return F.struct(_quote(_over(acc["state"], piece)).alias("state"), F.concat(acc["parts"], F.array(_text(acc["state"], piece, True))).alias("parts"))

    def chunk(acc: Column, k: Column) -> Column:
        part = F.slice(acc["pieces"], k * _CHUNK + 1, F.least(F.lit(_CHUNK), F.size(acc["pieces"]) - 1 - k * _CHUNK))
        return F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("parts")), step, lambda done: F.struct(
            done["state"].alias("state"), F.concat(acc["parts"], F.array(F.array_join(done["parts"], ""))).alias("parts"), acc["pieces"].alias("pieces")))

    start = F.struct(F.lit(_START).alias("state"), none.alias("parts"), pieces.alias("pieces"))
    whole = F.aggregate(chunks, start, chunk, lambda acc: F.concat(F.array_join(acc["parts"], ""), _text(acc["state"], F.element_at(acc["pieces"], -1), False)))
    return F.when(F.contains(record, F.lit('"')), F.split(whole, _CUT, -1)).otherwise(F.split(record, ",", -1))


def ends_open(line: Column, inside: bool) -> Column:
    """Whether a quote is open after the line, entered inside an open quote or not."""
    pieces = F.split(line, '"', -1)
    body = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    # the text after the last quote closes nothing
    end = F.aggregate(body, F.lit(_QUOTED if inside else _START), lambda at, piece: _quote(_over(at, piece)))
    return F.when(F.contains(line, F.lit('"')), end == _QUOTED).otherwise(F.lit(inside))


def _scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines as they are, with their file, the place of the read split in it, and an id that grows along the split."""
    text = F.regexp_replace(F.regexp_replace("value", "\r$", ""), "^\ufeff", "")
    path = F.col("_metadata.file_path")
    return (spark.read.text(paths)
            .select(path.alias("source_path"), label(path, roots_of(spark, paths)).alias("source_file"), F.col("_metadata.file_block_start").alias("split_start"), F.col("value"))
            .withColumn("line", F.when(F.is_valid_utf8("value"), text).otherwise(
                F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("source_file"))))))


def _not_blank(cells: Column) -> Column:
    return F.exists(cells, lambda x: F.trim(x) != "")


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines that are not blank, with their cells and an id that grows by one along the split."""
    return _scan(spark, paths).withColumn("cells", cells_of(F.col("line"))).where(_not_blank(F.col("cells"))).withColumn("mark", F.monotonically_increasing_id())


def running_sum(df: DataFrame, keys: list[str], block: str, order: str, value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over the rows before each row, by (block, order) within the keys. Blocks are summed first, so a
    window holds one block or one row per block."""
    v = f"_{name}"
    df = df.withColumn(v, value.cast("bigint"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    base = (df.groupBy(*keys, block).agg(F.sum(v).alias("_sum"))
            .withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum"))
    inside = Window.partitionBy(*keys, block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(base, [*keys, block]).withColumn(name, F.col("_base") + F.coalesce(F.sum(v).over(inside), F.lit(0))).drop("_base", v)


def quote_spans(lines: DataFrame, most_lines: int = MOST_LINES) -> DataFrame:
    """(source_path, first, last, open_quote) of lines (source_path, line_no, line): the records of more lines than one, and the lines whose quote is left open.

    A line sends an open or closed quote to an open or closed one; put together such effects are again one of four (stay, change,
    open, close). The state before a line is that of the last line which opens or closes whatever came, changed as often as lines
    after it change it. Each is taken inside blocks of lines first and carried over blocks by one row per block. Lines without a quote change
    nothing and take no part.
    """
    c = F.col
    quoted = lines.where(F.contains("line", F.lit('"'))).select("source_path", "line_no", F.floor(c("line_no") / _BLOCK).alias("block"),
                                                                ends_open(c("line"), False).alias("opens"), ends_open(c("line"), True).alias("stays"))
    quoted = settled(quoted)
    blocks = Window.partitionBy("source_path").orderBy("block")
    inside = Window.partitionBy("source_path", "block").orderBy("line_no")
    back = Window.partitionBy("source_path", "block").orderBy(c("line_no").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # the next line that closes a quote: in the block, else in the blocks after it
    closes = F.when(~c("stays"), c("line_no"))
    later = quoted.groupBy("source_path", "block").agg(F.min(closes).alias("closer")).withColumn(
        "later", F.min("closer").over(Window.partitionBy("source_path").orderBy(c("block").desc()).rowsBetween(Window.unboundedPreceding, -1))).drop("closer")
    quoted = quoted.join(later, ["source_path", "block"]).withColumn("next", F.coalesce(F.min(closes).over(back), "later"))
    quoted = quoted.withColumn("left_open", c("opens") & F.coalesce(c("next") - c("line_no") >= most_lines, F.lit(True)))
    quoted = settled(quoted.withColumn("opens", c("opens") & ~c("left_open")))
    quoted = running_sum(quoted, ["source_path"], "block", "line_no", (c("opens") & ~c("stays")).cast("bigint"), "changes")
    # a line after which the state is known whatever came: the state, less the changes up to it
    known = F.when(c("opens") == c("stays"), (c("stays").cast("bigint") + c("changes")) % 2)
    quoted = settled(quoted.withColumn("known", known))
    carried = quoted.groupBy("source_path", "block").agg(F.max_by("known", F.when(c("known").isNotNull(), c("line_no"))).alias("at_end")).withColumn(
        "carried", F.last("at_end", True).over(blocks.rowsBetween(Window.unboundedPreceding, -1))).drop("at_end")
    before = F.coalesce(F.last("known", True).over(inside.rowsBetween(Window.unboundedPreceding, -1)), "carried", F.lit(0))
    quoted = quoted.join(carried, ["source_path", "block"]).withColumn("before", (before + c("changes")) % 2)
    return quoted.where((c("before") == 0) & (c("opens") | c("left_open"))).select(
        "source_path", c("line_no").alias("first"), F.when(c("left_open"), c("line_no")).otherwise(c("next")).alias("last"), c("left_open").alias("open_quote"))


def joined_records(lines: DataFrame, most_lines: int = MOST_LINES) -> DataFrame:
    """Numbered records of lines (source_path, source_file, line_no, line); line_no grows by one along a file. Only lines of one record meet."""
    lines = settled(lines)
    spans = settled(quote_spans(lines, most_lines))
    member = spans.select("source_path", "first", "open_quote", F.explode(F.sequence("first", "last")).alias("line_no"))
    placed = lines.join(member, ["source_path", "line_no"], "left")
    keys = ["source_path", "source_file", F.coalesce("first", "line_no").alias("record"), F.coalesce("open_quote", F.lit(False)).alias("open_quote")]
    alone = F.col("first").isNull() | F.col("open_quote")
    whole = placed.where(~alone).groupBy("source_path", "source_file", "first").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("parts"))
    whole = whole.select("source_path", "source_file", F.col("first").alias("record"), F.lit(False).alias("open_quote"), F.array_join("parts.line", "\n").alias("line"))
    record = placed.where(alone).select(*keys, "line").unionByName(whole).withColumn("cells", cells_of(F.col("line"))).where(_not_blank(F.col("cells")))
    record = settled(record.withColumn("block", F.floor(F.col("record") / _BLOCK)))
    return running_sum(record, ["source_path"], "block", "record", F.lit(1), "source_row_number").select(*_RECORD)


_RECORD = ("source_path", "source_file", "cells", "open_quote", "source_row_number")


def records(spark: SparkSession, paths: list[str], most_lines: int = MOST_LINES) -> DataFrame:
    """(source_path, source_file, cells, open_quote, source_row_number) of every record that is not blank; number 0 is the header."""
    lines = _lines(spark, paths)
    broken = lines.where(ends_open(F.col("line"), False)).select("source_path").distinct()
    plain = with_row_numbers(lines).join(broken, "source_path", "left_anti").withColumn("open_quote", F.lit(False)).select(*_RECORD)
    if broken.isEmpty():
        return plain
    again = _scan(spark, paths).withColumn("mark", F.monotonically_increasing_id())
    again = with_row_numbers(again).withColumnRenamed("source_row_number", "line_no").join(broken, "source_path", "left_semi")
    return plain.unionByName(joined_records(again.select("source_path", "source_file", "line_no", "line"), most_lines))


def headers_of(rows: DataFrame) -> DataFrame:
    return rows.where("source_row_number = 0").select("source_path", "source_file", F.col("cells").alias("header"))


def file_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_path, source_file, header cells): the first record of each file that is not blank."""
    return headers_of(records(spark, [paths] if isinstance(paths, str) else paths))


def classify_headers(headers: DataFrame, variants: dict[str, list[str]], required: list[str]) -> DataFrame:
    """Per file: fingerprint, KNOWN_VARIANT / DRIFT / MISSING_REQUIRED, missing and unexpected names.

    `variants` names the exact headers that are known, blank cells included.
    """
    c = F.col
    fingerprint = F.sha2(F.array_join("header", chr(31)), 256)
    names = F.filter("header", lambda x: F.trim(x) != "")
    known = F.array(*[F.lit(n) for n in sorted({n for v in variants.values() for n in v if n.strip()})])
    variant = F.lit(None).cast("string")
    for name, header in variants.items():
        variant = F.when(F.array_join("header", chr(31)) == chr(31).join(header), F.lit(name)).otherwise(variant)
    missing = F.array_except(F.array(*[F.lit(r) for r in required]), names)
    return headers.select(
        "source_file", fingerprint.alias("fingerprint"), variant.alias("variant"), F.array_sort(missing).alias("missing"),
        F.array_sort(F.array_except(names, known)).alias("unexpected"),
        (F.size("header") - F.size(names)).alias("blank_columns")).withColumn(
        "header_status", F.when(F.size(c("missing")) > 0, "MISSING_REQUIRED").when(c("variant").isNotNull(), "KNOWN_VARIANT").otherwise("DRIFT"))


def _refuse(headers: DataFrame, required: tuple[str, ...]) -> None:
    twice = headers.groupBy("source_file").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['source_file']}: several files go by this name; read the folder above them")
    names = F.filter("header", lambda x: F.trim(x) != "")
    missing = F.array_except(F.array(*[F.lit(r) for r in required]), names)
    bad = headers.where((F.size(names) != F.size(F.array_distinct(names))) | (F.size(missing) > 0)).select(
        "source_file", missing.alias("missing")).limit(1).collect()
    if bad:
        what = f"required columns missing: {bad[0]['missing']}" if bad[0]["missing"] else "duplicate column name"
        raise ValueError(f"{bad[0]['source_file']}: {what}")


def with_row_numbers(lines: DataFrame) -> DataFrame:
    """Row number inside each file, 0 for the header, without sorting a file.

    A file may be read in several splits. The rows of each split are counted, the counts of the splits before are added up (one
    row per split), and the running id gives the place inside the split. The counts come from a scan of their own; should it cut
    the files differently from the scan of the rows, the job stops.
    """
    per_split = lines.groupBy("source_path", "split_start").agg(F.count("*").alias("n"), F.min("mark").alias("first_mark"), F.max("mark").alias("last_mark"))
    before = Window.partitionBy("source_path").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_split.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.col("mark") - F.col("first_mark")
    known = F.coalesce((place >= 0) & (F.col("mark") <= F.col("last_mark")), F.lit(False))
    return lines.join(offsets, ["source_path", "split_start"], "left").withColumn(
        "source_row_number", F.when(known, F.col("offset") + place).otherwise(F.raise_error(F.concat(F.lit("files were cut differently by two scans: "), F.col("source_file")))).cast("bigint")
    ).drop("offset", "first_mark", "last_mark")


def read_events(spark: SparkSession, paths: list[str] | str, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> DataFrame:
    """The rows of all files, as `rows_of` shows them."""
    return rows_of(records(spark, [paths] if isinstance(paths, str) else paths), required, optional)


def rows_of(every: DataFrame, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> DataFrame:
    """Rows of records: `required` and `optional` columns by name, `source_file`, `source_row_number`, `row_status`, `unmapped`
    and `row_sha256`.

    A required column that is missing, or a name used twice, refuses the files. Blank lines are skipped. `unmapped` is JSON of
    what has no declared column: `extra_columns`, `blank_header_columns`, `beyond_header`; NULL when there is nothing.
    """
    c = F.col
    headers = settled(headers_of(every))
    _refuse(headers, required)
    rows = every.where("source_row_number > 0").join(headers.drop("source_file"), "source_path")
    names = list(dict.fromkeys((*required, *optional)))

    def cell(name: str) -> Column:
        at = F.array_position("header", name)
        return F.when(at > 0, F.coalesce(F.get("cells", (at - 1).cast("int")), F.lit("")))

    width, n = F.size("header"), F.size("cells")
    declared = F.array(*[F.lit(x) for x in names])
    positions = F.sequence(F.lit(0), F.greatest(width, n) - 1)
    name_at = lambda i: F.coalesce(F.get("header", i), F.lit(""))
    value_at = lambda i: F.coalesce(F.get("cells", i), F.lit(""))
    extra = F.filter(positions, lambda i: (F.trim(name_at(i)) != "") & ~F.array_contains(declared, name_at(i)))
    blank = F.filter(positions, lambda i: (i < width) & (F.trim(name_at(i)) == "") & (F.trim(value_at(i)) != ""))
    some = lambda keys, make: F.when(F.size(keys) > 0, F.map_from_arrays(F.transform(keys, make), F.transform(keys, value_at)))
    unmapped = F.struct(
        F.when(n > width, F.slice("cells", width + 1, F.greatest(n - width, F.lit(0)))).alias("beyond_header"),
        some(blank, lambda i: i.cast("string")).alias("blank_header_columns"),
        some(extra, name_at).alias("extra_columns"))
    last_required = F.array_max(F.array(*[F.array_position("header", r) for r in required]))
    status = F.when(c("open_quote"), "OPEN_QUOTE").when(n < last_required, "SHORT_ROW").when((n > width) | (F.size(blank) > 0), "EXTRA_CELLS").otherwise("OK")
    return rows.select(
        "source_file", "source_row_number", *[cell(x).alias(x) for x in names], status.alias("row_status"),
        F.nullif(F.to_json(unmapped), F.lit("{}")).alias("unmapped"), F.sha2(F.array_join("cells", chr(31)), 256).alias("row_sha256"))
