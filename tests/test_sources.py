from __future__ import annotations

import csv
import datetime as dt
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measurekit.operators import rules_context as RC
from measurekit.operators.rules_events import event_findings
from measurekit.operators.staging import OPTIONAL, REQUIRED, stage_observations
from measurekit.plans.measurement import Measurement, TableStore
from measurekit.sources import canonical, delimited, inventory, observations
from measurekit.sources.calendar import hour_spine, week_spine, weekday_spine
from tests.builders import CFG, hits

HEADER = list(("session_id", "weighing_event_time", "weighting_type", "scale_identifier", "weight_of_a_component", "component_name", "tray_id", "user_identification_time")) + ["", ""]


def write(folder, name, text, encoding="utf-8"):
    (folder / name).write_bytes(text.encode(encoding))
    return str(folder)


@pytest.fixture()
def csv_dir(tmp_path):
    write(tmp_path, "registered_a.csv", "﻿" + ",".join(HEADER) + "\r\n"
          "s1,2020-10-06 11:00:00,line,koti2-vasen-salaatti3,120, Punakaali ,t1,2020-10-06 11:01:00,,\r\n"
          ",,,,,,,,,\r\n\r\n"
          's2,2020.10.06 11:00:00,line,vege2-lammin6,12.5,"a,""b""",t7,2020-10-06 11:01:00,,hidden\r\n'
          "s3,x\r\n"
          "s4,2020-10-06 11:00:00,line,a-b,3,c,t,2020-10-06 11:00:00,,,more,cells\r\n")
    # other order, an extra named column, no optional column
    return write(tmp_path, "non_registered_b.csv", "tray_id,note,session_id,weighing_event_time,scale_identifier,weight_of_a_component,component_name,user_identification_time\n"
                 "t1,hello,s1,2020-10-06 11:00:00,k-s,5,n,2020-10-06 11:00:00\n")


def test_rows_by_name_with_drift(spark, csv_dir):
    rows = {(r["source_file"], r["source_row_number"]): r for r in delimited.read_events(spark, csv_dir, REQUIRED, OPTIONAL).collect()}
    assert sorted(rows) == [("non_registered_b.csv", 1)] + [("registered_a.csv", n) for n in (1, 2, 3, 4)]
    first = rows[("registered_a.csv", 1)]
    assert (first["session_id"], first["component_name"], first["row_status"], first["unmapped"]) == ("s1", " Punakaali ", "OK", None)
    assert rows[("registered_a.csv", 2)]["component_name"] == 'a,"b"'
    assert [rows[("registered_a.csv", n)]["row_status"] for n in (2, 3, 4)] == ["EXTRA_CELLS", "SHORT_ROW", "EXTRA_CELLS"]
    assert rows[("registered_a.csv", 2)]["unmapped"] == '{"blank_header_columns":{"9":"hidden"}}'
    assert rows[("registered_a.csv", 4)]["unmapped"] == '{"beyond_header":["more","cells"]}'
    other = rows[("non_registered_b.csv", 1)]
    assert (other["tray_id"], other["weighting_type"], other["unmapped"]) == ("t1", None, '{"extra_columns":{"note":"hello"}}')
    cells = ["s1", "2020-10-06 11:00:00", "line", "koti2-vasen-salaatti3", "120", " Punakaali ", "t1", "2020-10-06 11:01:00", "", ""]
    assert first["row_sha256"] == hashlib.sha256("\x1f".join(cells).encode()).hexdigest()


def test_reader_feeds_the_measurement(spark, csv_dir):
    m = Measurement(delimited.read_events(spark, csv_dir, REQUIRED, OPTIONAL), None, CFG)
    f = event_findings(m.flagged, CFG).cache()
    assert hits(f, "S04") == ["registered_a.csv#2"]
    assert hits(f, "S08") == ["non_registered_b.csv#1", "registered_a.csv#2", "registered_a.csv#3", "registered_a.csv#4"]
    assert hits(f, "S06") == ["registered_a.csv#2", "registered_a.csv#3"]


def test_row_numbers_across_splits(spark, tmp_path):
    n = 3000
    write(tmp_path, "registered_a.csv", ",".join(HEADER[:8]) + "\n" + "".join(f"s{i},t,line,k,{i},c,t,t\n" + ("\n" if i % 7 == 0 else "") for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = delimited.read_events(spark, str(tmp_path), REQUIRED, OPTIONAL)
        got = df.agg(F.count("*"), F.count_if(F.col("source_row_number").cast("string") != F.col("weight_of_a_component")), F.max("source_row_number")).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tuple(got) == (n, 0, n)


@pytest.mark.parametrize("header, message", [("session_id,tray_id", "missing"), (",".join(HEADER[:8]) + ",tray_id", "duplicate")])
def test_bad_headers_are_refused(spark, tmp_path, header, message):
    write(tmp_path, "registered_a.csv", header + "\nx,y\n")
    with pytest.raises(ValueError, match=message):
        delimited.read_events(spark, str(tmp_path), REQUIRED, OPTIONAL)


def test_not_utf8_is_refused(spark, tmp_path):
    write(tmp_path, "registered_a.csv", ",".join(HEADER[:8]) + "\ns1,t,line,k,1,käse,t,t\n", "latin-1")
    with pytest.raises(Exception, match="not UTF-8"):
        delimited.read_events(spark, str(tmp_path), REQUIRED, OPTIONAL).collect()


def test_header_classes(spark, csv_dir, tmp_path):
    write(tmp_path, "registered_c.csv", "session_id,odd\n1,2\n")
    got = {r["source_file"]: r for r in delimited.classify_headers(delimited.file_headers(spark, [csv_dir]), {"V8": HEADER}, list(REQUIRED)).collect()}
    assert {k: r["header_status"] for k, r in got.items()} == {"registered_a.csv": "KNOWN_VARIANT", "non_registered_b.csv": "DRIFT", "registered_c.csv": "MISSING_REQUIRED"}
    assert got["non_registered_b.csv"]["unexpected"] == ["note"] and "tray_id" in got["registered_c.csv"]["missing"] and got["registered_a.csv"]["blank_columns"] == 2


XML = ('<wfs:Coll xmlns:wfs="w" xmlns:B="b" numberReturned="3">' + "".join(
    f"<wfs:member><B:El><B:Time>{t}</B:Time><B:ParameterName>{p}</B:ParameterName><B:ParameterValue>{v}</B:ParameterValue></B:El></wfs:member>"
    for t, p, v in (("2020-10-06T06:00:00Z", "t2m", "NaN"), ("2020-10-06T06:00:00Z", "r_1h", "1.50"), ("2020-10-06T07:00:00Z", "t2m", "x"))) + "</wfs:Coll>")


def test_xml_observations(spark, tmp_path):
    write(tmp_path, "w.xml", XML)
    raw = observations.read_observations(spark, str(tmp_path), "El", "100")
    staged = {(r["parameter"], r["time_raw"]): (r["value_raw"], r["value"], r["value_status"]) for r in stage_observations(raw).collect()}
    assert staged == {("t2m", "2020-10-06T06:00:00Z"): ("NaN", None, "NAN_SOURCE_NULL"), ("r_1h", "2020-10-06T06:00:00Z"): ("1.50", 1.5, "OK"),
                      ("t2m", "2020-10-06T07:00:00Z"): ("x", None, "UNPARSEABLE")}
    declared = observations.declared_counts(spark, str(tmp_path), "Coll")
    assert [tuple(r) for r in declared.collect()] == [("w.xml", 3)]
    assert RC.completeness(stage_observations(raw), declared, CFG).first()["status"] == "INCOMPLETE_GRID"
    assert RC.completeness(stage_observations(raw), declared.withColumn("declared_rows", F.lit(4)), CFG).first()["status"] == "DECLARED_COUNT"
    absent = declared.withColumn("source_file", F.lit("none.xml"))
    assert RC.completeness(stage_observations(raw), absent, CFG).first()["status"] == "MISSING"


def test_inventory_pins_and_changes(spark, tmp_path):
    write(tmp_path, "registered_a.csv", "one")
    write(tmp_path, "registered_b.csv", "two")
    write(tmp_path, "registered_c.csv", "three")
    inv = inventory.file_inventory(spark, str(tmp_path)).cache()
    sha = {r["source_file"]: r["sha256"] for r in inv.collect()}
    assert sha["registered_a.csv"] == hashlib.sha256(b"one").hexdigest() and {r["md5"] for r in inv.collect()} >= {hashlib.md5(b"two").hexdigest()}
    pins = spark.createDataFrame([("registered_a.csv", 3, sha["registered_a.csv"], 1), ("registered_b.csv", 3, "0" * 64, 1), ("gone.csv", 1, "1", 1)],
                                 "source_file string, pinned_size bigint, pinned_sha256 string, pinned_rows bigint")
    rows = spark.createDataFrame([("registered_a.csv", 2)], "source_file string, rows bigint")
    assert {r[0]: r[1] for r in inventory.compare_with_pins(pins, inv, rows).collect()} == {
        "registered_a.csv": "ROW_COUNT_MISMATCH", "registered_b.csv": "CHECKSUM_MISMATCH", "gone.csv": "MISSING", "registered_c.csv": "UNEXPECTED"}
    assert {r[0]: r[1] for r in inventory.compare_with_pins(pins, inv).collect()}["registered_a.csv"] == "NOT_CHECKED"
    smaller = pins.withColumn("pinned_size", F.lit(9).cast("bigint"))
    assert {r[0]: r[1] for r in inventory.compare_with_pins(smaller, inv).collect()}["registered_a.csv"] == "SIZE_MISMATCH"
    after = inv.where("source_file <> 'registered_a.csv'").withColumn("sha256", F.when(F.col("source_file") == "registered_b.csv", "x").otherwise(F.col("sha256")))
    new = after.unionByName(inv.limit(1).withColumn("source_file", F.lit("new.csv")))
    assert {r[0]: r[1] for r in inventory.inventory_changes(inv, new).collect()} == {"registered_a.csv": "disappeared", "registered_b.csv": "changed", "new.csv": "appeared"}
    kinds = inv.withColumn("kind", F.lit("events"))
    assert inventory.snapshot_id(kinds).first()[0] == inventory.snapshot_id(kinds.orderBy(F.desc("source_file"))).first()[0]
    a, b = (inventory.content_fingerprint(d, ["source_file", "size"]).first()[0] for d in (inv.repartition(3), inv.coalesce(1)))
    assert a == b != inventory.content_fingerprint(inv.limit(2), ["source_file", "size"]).first()[0]


def test_fingerprints_tell_cells_apart(spark):
    prints = lambda *rows: inventory.content_fingerprint(spark.createDataFrame(list(rows), "a string, b string"), ["a", "b"]).first()[0]
    assert len({prints(("a|b", "c")), prints(("a", "b|c")), prints((None, "x")), prints(("", "x")), prints(("-", "x")), prints(("x", None))}) == 6


def test_file_contract(spark, csv_dir):
    inv = inventory.file_inventory(spark, csv_dir)
    headers = delimited.classify_headers(delimited.file_headers(spark, [csv_dir]), {"V8": HEADER}, list(REQUIRED))
    rows = delimited.read_events(spark, csv_dir, REQUIRED, OPTIONAL).groupBy("source_file").agg(F.count("*").alias("rows"))
    got = {r["source_file"]: (r["population"], r["rows"], r["header_status"], r["tz_offset_hours"]) for r in inventory.file_contract(inv, headers, rows, CFG).collect()}
    assert got == {"registered_a.csv": ("primary", 4, "KNOWN_VARIANT", 0), "non_registered_b.csv": ("other", 1, "DRIFT", 0)}


def test_canonical_round_trip_and_refusals(spark, tmp_path):
    df = spark.createDataFrame([(2, None, True, ["b", "a"]), (1, "x", False, [])], "k bigint, s string, b boolean, l array<string>")
    path = str(tmp_path / "t")
    canonical.write_table(df, path, ["k"], 1)
    lines = next(p for p in (tmp_path / "t").iterdir() if p.name.endswith(".csv")).read_text().splitlines()
    assert lines == ["k,s,b,l", "1,x,false,", "2,,true,a;b"]
    schema = T.StructType.fromDDL("k bigint, s string, b boolean, l string")
    table = canonical.read_canonical(spark, path, schema)
    counted, check = canonical.with_row_contract(table, 2, "t")
    assert sorted(tuple(r) for r in counted.collect()) == [(1, "x", False, None), (2, None, True, "a;b")]
    check()
    counted, check = canonical.with_row_contract(table, 3, "t")
    counted.write.parquet(str(tmp_path / "copy"))
    with pytest.raises(ValueError, match="2 rows, 3 recorded"):
        check()
    assert scans(counted) == 1
    with pytest.raises(ValueError, match="declared"):
        canonical.read_canonical(spark, path, T.StructType.fromDDL("k bigint, z string, b boolean, l string"))
    canonical.write_summary(df.select("k", "s"), str(tmp_path / "j"))
    assert any('"s":null' in p.read_text() for p in (tmp_path / "j").iterdir() if p.name.endswith(".json"))


def scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_calendars(spark):
    assert hour_spine(spark, dt.datetime(2020, 10, 6, 6), dt.datetime(2020, 10, 7, 6)).count() == 25
    days = [str(r[0]) for r in weekday_spine(spark, dt.date(2020, 10, 9), dt.date(2020, 10, 13)).orderBy("day").collect()]
    assert days == ["2020-10-09", "2020-10-12", "2020-10-13"]
    assert sorted(str(r[0]) for r in week_spine(spark, dt.date(2020, 10, 9), dt.date(2020, 10, 13)).collect()) == ["2020-10-05", "2020-10-12"]


def test_table_store_writes_once(spark, tmp_path):
    store, calls = TableStore(spark, "src", str(tmp_path)), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert store.keep("t", build).count() == store.keep("t", build).count() == 3 and len(calls) == 1


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    for day in ("day=1", "day=2"):
        (tmp_path / day).mkdir()
        write(tmp_path / day, "registered_x.csv", ",".join(HEADER[:8]) + f"\ns{day[-1]},t,line,k,1,c,t,t\nr,t,line,k,1,c,t,t\n")
    rows = delimited.read_events(spark, str(tmp_path), REQUIRED, OPTIONAL).collect()
    assert sorted((r["source_file"], r["source_row_number"], r["session_id"]) for r in rows) == [
        ("day=1/registered_x.csv", 1, "s1"), ("day=1/registered_x.csv", 2, "r"), ("day=2/registered_x.csv", 1, "s2"), ("day=2/registered_x.csv", 2, "r")]
    assert {r["source_file"] for r in inventory.file_inventory(spark, str(tmp_path)).collect()} == {"day=1/registered_x.csv", "day=2/registered_x.csv"}
    with pytest.raises(ValueError, match="several files"):
        delimited.read_events(spark, [f"{tmp_path}/day=1/registered_x.csv", f"{tmp_path}/day=2/registered_x.csv"], REQUIRED, OPTIONAL)


def test_quoted_line_breaks(spark, tmp_path):
    body = "".join(f's{i},t,line,k,{i},"soup\nof, ""day""\n\n{i}",t,t\n' if i % 5 == 0 else f"s{i},t,line,k,{i},c,t,t\n\n" for i in range(1, 401))
    write(tmp_path, "registered_a.csv", ",".join(HEADER[:8]) + "\n" + body)
    write(tmp_path, "registered_b.csv", ",".join(HEADER[:8]) + "\nx,t,line,k,1,c,t,t\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = delimited.read_events(spark, str(tmp_path), REQUIRED, OPTIONAL).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {r["source_row_number"]: r for r in rows if r["source_file"] == "registered_a.csv"}
    assert sorted(got) == list(range(1, 401)) and len(rows) == 401
    assert all(r["weight_of_a_component"] == str(i) and r["row_status"] == "OK" for i, r in got.items())
    assert got[10]["component_name"] == 'soup\nof, "day"\n\n10' and got[11]["component_name"] == "c"


def csv_rows(text: str, most_lines: int) -> list[tuple[list[str], bool]]:
    """What Python's reader makes of a file, a quote that stays open for too many lines being no quote."""
    lines, out, k = text.split("\n"), [], 0
    while k < len(lines):
        for span in range(1, most_lines + 1):
            if k + span <= len(lines):
                rows = list(csv.reader(io.StringIO("\n".join(lines[k:k + span]) + "\nend,of,file")))
                if rows[-1] == ["end", "of", "file"]:
                    out.append((rows[0] or [""], False))
                    break
        else:
            out.append((next(csv.reader(io.StringIO(lines[k]))), True))
            span = 1
        k += span
    return [(cells, marked) for cells, marked in out if any(x.strip(" ") for x in cells)]


@pytest.mark.parametrize("seed", range(6))
def test_records_equal_a_sequential_reader(spark, seed, monkeypatch):
    rng, most = random.Random(seed), 4
    monkeypatch.setattr(delimited, "_BLOCK", 7)
    monkeypatch.setattr(delimited, "_CHUNK", 3)
    files = {}
    for name in "abc":
        cell = lambda: rng.choice(["x", "", " ", "y z", '"q"', '"a,b"', '"a""b"', '""', 'm"n', '"open', 'shut"', '"t"u', '"', "ü", '"""', 'p""q'])
        files[name] = "\n".join(",".join(cell() for _ in range(rng.randint(1, 4))) for _ in range(60))
    lines = spark.createDataFrame([(n, n, k, line) for n, text in files.items() for k, line in enumerate(text.split("\n"))],
                                  "source_path string, source_file string, line_no bigint, line string").repartition(5)
    got = sorted(delimited.joined_records(lines, most).collect(), key=lambda r: (r["source_file"], r["source_row_number"]))
    for name, text in files.items():
        mine = [r for r in got if r["source_file"] == name]
        assert [(r["cells"], r["open_quote"]) for r in mine] == csv_rows(text, most)
        assert [r["source_row_number"] for r in mine] == list(range(len(mine)))


def test_a_stray_quote_in_a_long_file_is_one_marked_row(spark, tmp_path):
    n = 200_000
    body = "".join(f's{i},t,line,k,{i},{chr(34) if i == 5 else ""}c,t,t\n' for i in range(1, n + 1))
    write(tmp_path, "registered_a.csv", ",".join(HEADER[:8]) + "\n" + body)
    df = delimited.read_events(spark, str(tmp_path), REQUIRED, OPTIONAL)
    marked = df.where("row_status = 'OPEN_QUOTE'").collect()
    assert [(r["source_row_number"], r["session_id"]) for r in marked] == [(5, "s5")]
    assert df.agg(F.count("*"), F.count_if(F.col("source_row_number").cast("string") != F.col("weight_of_a_component")), F.max(F.length("component_name"))).first()[:2] == (n, 0)


def test_broken_elements_are_rows_with_a_reason(spark, tmp_path):
    good = "<El><Time>2020-10-06T06:00:00Z</Time><ParameterName>t2m</ParameterName><ParameterValue>1</ParameterValue></El>"
    rows = [(1, good), (2, good[:60]), (3, "<El><ParameterName>t2m</ParameterName></El>"), (4, "<El><Time>x</Time><ParameterName> </ParameterName></El>"), (5, ""), (6, None),
            (7, good.replace("El>", "b:El xmlns:b='u'>", 1).replace("</El>", "</b:El>"))]
    got = {r["k"]: (r["reject_reason"], r["value_raw"]) for r in observations.parse_elements(spark.createDataFrame(rows, "k int, element string")).collect()}
    assert got == {1: (None, "1"), 2: ("MALFORMED", None), 3: ("NO_TIME", None), 4: ("NO_PARAMETER", None), 5: ("MALFORMED", None), 6: ("MALFORMED", None), 7: (None, "1")}
    body = f"{good}<El><Time>2020</Time></El>\n<m><El><Time>y</Time><ParameterName>a</Param></El></m>{good}<El><Time>never closed</Time>{good}<El at='1'><Time>z</Time><ParameterName>&amp;p</ParameterName></El>"
    write(tmp_path, "w.xml", f"<Coll>{body}{good}</Coll>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        kept = observations.read_observations(spark, str(tmp_path), "El", "100").collect()
        rejected = observations.rejected_observations(spark, str(tmp_path), "El").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r["parameter"], r["time_raw"], r["value_raw"]) for r in kept) == [("&p", "z", None)] + [("t2m", "2020-10-06T06:00:00Z", "1")] * 4
    assert sorted(r["reject_reason"] for r in rejected) == ["MALFORMED", "MALFORMED", "NO_PARAMETER"] and all(r["source_file"] == "w.xml" for r in rejected)


def test_a_line_of_many_quotes(spark, tmp_path):
    write(tmp_path, "registered_a.csv", ",".join(HEADER[:8]) + '\ns,t,line,k,1,"' + '""' * 100_000 + '",t,t\n')
    assert delimited.read_events(spark, str(tmp_path), REQUIRED, OPTIONAL).first()["component_name"] == '"' * 100_000


def test_stores_of_one_source_lie_side_by_side(spark, tmp_path):
    one, two = (TableStore(spark, "src", str(tmp_path)) for _ in range(2))
    a = one.keep("t", lambda: spark.range(3))
    b = two.keep("t", lambda: spark.range(5))
    assert (a.count(), b.count(), one.keep("t", lambda: spark.range(9)).count()) == (3, 5, 3)


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_facts_are_the_same_with_and_without_a_store(spark, tmp_path):
    from measurekit.plans import queries, roles
    sf_dir = "/root/testdata/sf0.001"
    build = lambda store: Measurement(roles.raw_events(spark, sf_dir), roles.raw_observations(spark, sf_dir), queries.CFG, store)
    lazy, kept = build(None), build(TableStore(spark, sf_dir, str(tmp_path))).prepare()
    for step in ("staged", "profiles", "sessions", "context", "facts", "facts_with_context", "volume"):
        a, b = getattr(lazy, step), getattr(kept, step)
        assert sorted(a.columns) == sorted(b.columns), step
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect())), step


def test_lines_of_records_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def line(k: int) -> str:
        made.add(1)
        return "a,b" if k == 0 else f'{k},"x' if k % 9 == 1 else 'y",z' if k % 9 == 2 else f"{k},v"

    lines = spark.range(90).select(F.lit("f.csv").alias("source_path"), F.lit("f.csv").alias("source_file"), F.col("id").alias("line_no"), F.udf(line, "string")("id").alias("line"))
    rows = delimited.rows_of(delimited.joined_records(lines), ("a",), ("b",)).collect()
    assert len(rows) == 79 and made.value == 90
