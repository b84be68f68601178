"""Ordered work on hot keys, against plain windows and sorts."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from measurekit.functions import text as X
from measurekit.operators import profiling as PR
from measurekit.operators.quantiles import ranked_percentiles
from measurekit.operators.ranges import lagged, range_blocks
from measurekit.operators.rules_sessions import tray_overlaps


def hot_rows(spark, n: int, seed: int, instants: int):
    """One key with most rows, many of them at one instant, beside small ones and one of nulls."""
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), rng.choice([7, rng.randrange(instants)]), f"f{rng.randrange(3)}", k) for k in range(n)]
    return spark.createDataFrame(rows, "k string, t int, file string, row int")


@pytest.mark.parametrize("instants", [1, 5, 100_000])
def test_lag_over_blocks_equals_a_plain_lag(spark, instants):
    df = hot_rows(spark, 6000, instants, instants).repartition(6)
    blocked = range_blocks(df, ["k"], "t", 200, (F.col("file"), F.floor(F.col("row") / 200)))
    sizes = blocked.groupBy("k", "block").count().where("k = 'hot'").agg(F.count("*"), F.max("count")).first()
    assert sizes[0] > 12 and sizes[1] <= 450
    order = ["t", "file", "row"]
    got = lagged(blocked, ["k"], order, {"before": "row"}).where("k IS NOT NULL").select("k", "row", "before").collect()
    want = df.where("k IS NOT NULL").select("k", "row", F.lag("row").over(Window.partitionBy("k").orderBy(*order)).alias("before")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_gaps_of_one_hot_session(spark):
    n = 5000
    df = spark.range(n).select(
        F.lit("s").alias("session_key"), F.lit("p").alias("population"), F.concat(F.lit("sc"), F.col("id") % 3).alias("scale_id"), F.col("id").cast("string").alias("event_id"),
        F.when(F.col("id") % 5 == 0, None).otherwise(F.lit("dish")).alias("component"), F.col("id").alias("weight_g"), F.lit(False).alias("is_repeat"), F.lit("f").alias("source_file"),
        F.col("id").alias("source_row_number"), (F.lit("2024-01-01 12:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") * 7919 % n) / 2)).alias("event_local"))
    one = {r["event_id"]: r for r in PR.with_gaps(df).collect()}
    many = {r["event_id"]: r for r in PR.with_gaps(df, 100).collect()}
    assert one == many and sum(r["gap_s"] is None for r in many.values()) == 1 and sum(r["scale_gap_s"] is None for r in many.values()) == 3
    assert range_blocks(df, ["session_key"], "event_local", 100).select("block").distinct().count() > 50


def test_overlaps_of_a_busy_tray(spark):
    rng = random.Random(4)
    spans = [(a, a + rng.randrange(0, 40)) for a in (rng.randrange(2000) for _ in range(700))]
    start = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    at = lambda s: start + F.make_dt_interval(secs=F.col(s))
    df = spark.createDataFrame(spans, "a int, b int").select(F.lit("t").alias("tray_single"), at("a").alias("first_utc"), at("b").alias("last_utc"))
    want = sum(1 for k, (a, b) in enumerate(spans) for c, d in spans[k + 1:] if a <= d and c <= b)
    assert [tuple(r) for r in tray_overlaps(df, 20).collect()] == [tuple(r) for r in tray_overlaps(df).collect()] == [("t", 700, want)]


def test_ranks_of_many_distinct_values(spark):
    values = np.random.default_rng(3).normal(size=100_000)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    qs = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {r["q"]: r["value"] for r in ranked_percentiles(df, "v", qs, most=100).collect()}
    assert got == pytest.approx({q: float(np.quantile(values, q)) for q in qs})


def test_ranks_by_group_with_ties(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, rng.random()])) for _ in range(3000)] + [("c", 5.0), ("d", None)]
    got = {(r["k"], r["q"]): r["value"] for r in ranked_percentiles(spark.createDataFrame(rows, "k string, v double"), "v", [0.1, 0.6], ["k"], most=10).collect()}
    want = {(k, q): float(np.quantile([v for g, v in rows if g == k and v is not None], q)) for k in "abc" for q in (0.1, 0.6)}
    assert got == pytest.approx(want)


def test_average_ranks_in_small_ranges(spark):
    rng = random.Random(9)
    values = [rng.choice([0.5, rng.random()]) for _ in range(2000)]
    got = {r["v"]: r["rank"] for r in PR.average_ranks(spark.createDataFrame([(v,) for v in values], "v double"), "v", "rank", 10).collect()}
    assert got == pytest.approx(dict(zip(values, pd.Series(values).rank())))


def test_case_folding_of_every_character(spark):
    codes = [*range(1, 0xD800), *range(0xE000, 0x110000)]
    df = spark.createDataFrame(pd.DataFrame({"c": [chr(k) for k in codes]})).select("c", X.casefold(F.concat(F.lit("A"), "c", F.lit("ßB"))).alias("f"))
    wrong = [r["c"] for r in df.toPandas().to_dict("records") if r["f"] != f"A{r['c']}ßB".casefold()]
    assert wrong == []
    plain = spark.createDataFrame([("ABC xyz",), ("",), (None,)], "c string").select(X.casefold(F.col("c"))).collect()
    assert [r[0] for r in plain] == ["abc xyz", "", None]
