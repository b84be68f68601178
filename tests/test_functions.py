from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from measurekit.config import Threshold, rule_catalogue
from measurekit.functions import stats as S
from measurekit.functions import text as X
from measurekit.functions import times as T
from measurekit.operators.quantiles import ranked_percentiles
from measurekit.operators.scenarios import classify, relative_delta

ZONE = "Europe/Helsinki"


def values(df):
    return [tuple(r) for r in df.collect()]


def test_names(spark):
    df = spark.createDataFrame([(" Foo  BÄR\tStraße ",), ("  ",), (" x ",), ("a",)], "n string")
    assert values(df.select(X.norm_name(F.col("n")), X.has_edge_space(F.col("n")))) == [
        ("foo bär strasse", True), (None, True), ("x", True), ("a", False)]


def test_weights(spark):
    df = spark.createDataFrame([("120",), (" 007 ",), ("",), (" ",), ("12.5",), ("-3",), ("x",), ("9" * 25,)], "w string")
    assert values(df.select(X.weight_status(F.col("w")), X.weight_grams(F.col("w")))) == [
        ("OK", 120), ("OK", 7), ("EMPTY", None), ("EMPTY", None), ("NOT_INTEGER", None), ("NOT_INTEGER", None), ("NOT_INTEGER", None), ("NOT_INTEGER", None)]


def test_scale_parts(spark):
    df = spark.createDataFrame([("koti2-vasen-salaatti3",), ("vege2-lammin6",), ("a-b-c-d",), ("solo",), ("k-v-other9",), ("",)], "s string")
    parts = X.scale_parts(F.col("s"), ("salaatti", "lammin"))
    assert values(df.select(*[parts[k] for k in ("line", "side", "kind", "position")])) == [
        ("koti2", "vasen", "salaatti", 3), ("vege2", None, "lammin", 6), ("a", None, None, None), ("solo", None, None, None), ("k", "v", None, None), (None, None, None, None)]


def test_population_needs_exactly_one_rule(spark):
    rules = (("registered_", "primary"), ("non_registered_", "other"))
    df = spark.createDataFrame([("registered_x.csv",), ("non_registered_x.csv",)], "f string")
    assert [r[0] for r in df.select(X.population_of(F.col("f"), rules)).collect()] == ["primary", "other"]
    for bad, r in (("else.csv", rules), ("registered_x.csv", (*rules, ("reg", "third")))):
        with pytest.raises(Exception, match="no single population"):
            spark.createDataFrame([(bad,)], "f string").select(X.population_of(F.col("f"), r)).collect()


@pytest.mark.parametrize("raw, local, status, utc", [
    ("2020-10-25 02:59:59", "2020-10-25 02:59:59", "OK", "2020-10-24 23:59:59"),
    ("2020-10-25 03:30:00", "2020-10-25 03:30:00", "AMBIGUOUS", None),
    ("2020.10.25 04:00:00", "2020-10-25 04:00:00", "OK", "2020-10-25 02:00:00"),
    ("2020-03-29 03:30:00", "2020-03-29 03:30:00", "NONEXISTENT", None),
    (" 2020-10-6 1:02:03 ", "2020-10-06 01:02:03", "OK", "2020-10-05 22:02:03"),
    ("2020-10-06 11:00:00.5", None, "UNPARSEABLE", None), ("2020-10.06 11:00:00", None, "UNPARSEABLE", None),
    ("2020-13-01 00:00:00", None, "UNPARSEABLE", None), ("2020-10-06", None, "UNPARSEABLE", None), ("2020-10-06 11:00:00Z", None, "UNPARSEABLE", None)])
@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
def test_times(spark, raw, local, status, utc, session_zone):
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        t = T.parse_time(F.col("r"))
        got = values(spark.createDataFrame([(raw,)], "r string").select(T.iso_text(t), T.local_status(t, ZONE), T.iso_text(T.local_to_utc(t, ZONE))))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [(local, status, utc)]


def test_hours_and_days(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp_ntz'2020-10-06 11:00:00'), (timestamp_ntz'2020-10-06 11:00:01'), (timestamp_ntz'2020-10-06 23:30:00') AS t(x)")
    x = F.col("x")
    assert values(df.select(T.iso_text(T.ceil_hour(x)), T.iso_text(T.floor_hour(x)), F.round(T.hour_fraction(x), 6), T.weekday_name(x.cast("date")),
                            T.week_start(x.cast("date")).cast("string"), T.is_weekend(x.cast("date")))) == [
        ("2020-10-06 11:00:00", "2020-10-06 11:00:00", 11.0, "Tuesday", "2020-10-05", False),
        ("2020-10-06 12:00:00", "2020-10-06 11:00:00", 11.000278, "Tuesday", "2020-10-05", False),
        ("2020-10-07 00:00:00", "2020-10-06 23:00:00", 23.5, "Tuesday", "2020-10-05", False)]


@pytest.mark.parametrize("data, q, expected", [([10, 20], 0.9, 19.0), ([1, 2, 3, 4], 0.5, 2.5), ([7], 0.9, 7.0), ([], 0.5, None), (list(range(10)), 0.9, 8.1), ([5, None, 7], 0.5, 6.0)])
def test_percentile(spark, data, q, expected):
    df = spark.createDataFrame([(v,) for v in data], "v bigint")
    got = df.agg(S.exact_percentile(F.col("v"), q)).first()[0]
    assert got == expected or got == pytest.approx(expected)


def test_percentile_outside_range_is_refused(spark):
    with pytest.raises(ValueError):
        S.exact_percentile(None, 1.1)


def test_ranked_percentiles_match_numpy(spark):
    rng = random.Random(7)
    for size in (1, 2, 3, 50, 3000):
        data = [rng.choice([rng.uniform(0, 1e6), 5.0, float(rng.randrange(10))]) for _ in range(size)]
        qs = [0.0, 0.1, 0.5, 0.9, 0.995, 1.0]
        got = {r["q"]: r["value"] for r in ranked_percentiles(spark.createDataFrame([(v,) for v in data], "v double"), "v", qs).collect()}
        assert got == pytest.approx({q: float(np.quantile(data, q)) for q in qs})
        assert got[0.5] == pytest.approx(statistics.median(data))


def test_ranked_percentiles_by_group_with_one_hot_value(spark):
    rows = [("a", 3.0)] * 5000 + [("a", float(i)) for i in range(100)] + [("b", 1.0), ("b", 2.0), ("b", None)]
    got = {(r["k"], r["q"]): r["value"] for r in ranked_percentiles(spark.createDataFrame(rows, "k string, v double"), "v", [0.5, 0.99], ["k"]).collect()}
    a = [3.0] * 5000 + [float(i) for i in range(100)]
    assert got == pytest.approx({("a", 0.5): 3.0, ("a", 0.99): float(np.quantile(a, 0.99)), ("b", 0.5): 1.5, ("b", 0.99): 1.99})


def test_strict_sum_keeps_null_apart_from_zero(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", None), ("c", None)], "k string, v bigint")
    got = {r[0]: r[1] for r in df.groupBy("k").agg(S.strict_sum(F.col("v"))).collect()}
    assert got == {"a": 3, "b": None, "c": None}
    assert df.where("false").agg(S.strict_sum(F.col("v"))).first()[0] is None


def test_single_value(spark):
    df = spark.createDataFrame([("a", "x"), ("a", ""), ("b", "x"), ("b", "y"), ("c", "")], "k string, v string")
    assert {r[0]: r[1] for r in df.groupBy("k").agg(S.single_value(F.col("v"))).collect()} == {"a": "x", "b": None, "c": None}


def test_threshold_operators(spark):
    df = spark.createDataFrame([(3,), (4,)], "v bigint")
    for op, expected in ((">", [False, True]), (">=", [True, True]), ("<", [False, False]), ("<=", [True, False])):
        assert [r[0] for r in df.select(S.compare(F.col("v"), Threshold(op, 3))).collect()] == expected
    with pytest.raises(ValueError):
        S.compare(F.lit(1), Threshold("!", 3))


def test_catalogue_overrides():
    cat = rule_catalogue({"B02": ("ERROR", "QUARANTINE"), "nope": ("ERROR", "BLOCK")})
    assert (cat["B02"].severity, cat["B02"].handling) == ("ERROR", "QUARANTINE")
    assert len(cat) == 36 and "nope" not in cat


def test_classes_and_deltas(spark):
    rows = [("M1", 499.0, 508.9, "STABLE"), ("M1", 499.0, 509.0, "SENSITIVE"), ("M1", 499.0, 479.0, "CONDITIONAL"), ("M3", 1000.0, 1049.0, "STABLE"),
            ("M3", 1000.0, 800.0, "CONDITIONAL"), ("M2", None, 1.0, "BLOCKED")]
    df = spark.createDataFrame([r[:3] for r in rows], "m string, b double, v double")
    assert [r[0] for r in df.select(classify(F.col("m"), F.col("b"), F.col("v"))).collect()] == [r[3] for r in rows]
    assert spark.range(1).select(relative_delta(F.lit(5.0), F.lit(0.0))).first()[0] == 0.0
