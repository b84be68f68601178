"""The pipeline against its stages worked out one by one in plain Python."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from measurekit.llm import mixing
from measurekit.llm.queries import QUERIES, SQL
from measurekit.llm.shared import tune
from tests.llm.test_near_dup import brute as near_groups
from tests.llm.test_suffix_dedup import brute as repeats
from tests.oracle_compare import connect, spark_rows, sql_rows

SF_DIR = "/root/testdata/sf0.001"


def docs() -> list[tuple[int | None, str | None, str | None, str | None, int]]:
    r = random.Random(8)
    syllables = {"aa": "ka to mi ru se no ha".split(), "bb": "str ung sch ein lich ver".split()}
    text = lambda lang: " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(5, 60)))
    passage = " ".join(text("aa") for _ in range(6))
    out = []
    for k in range(160):
        lang = r.choice(["aa", "bb"])
        body = text(lang)
        if k % 10 == 0:
            body = text("aa") + " " + text("aa") + " " + passage + " " + text("aa")
        out.append((k, body, lang, f"s{r.randrange(4)}", len(body)))
    out += [(300 + k, out[3][1], "aa", "s0", 1) for k in range(5)] + [(400, out[5][1] + " ka", "aa", None, 2), (401, None, "aa", "s1", 0), (402, "1234 ...", None, "s1", 0), (403, "xqzj wvxq " * 40, None, "s2", 0)]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipe"))
    tune(spark).createDataFrame(docs(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_in_turn(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    columns = table.columns
    rows = {r.doc_id: r.text for r in table.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "suffix_array_dedup", "source_mixing", "bpe_tokens"]

    known = stages["language_id"](spark, table, folder)
    assert known.columns == columns and {r.doc_id for r in known.collect()} == set(rows) - {401, 402, 403}

    single = stages["near_duplicates"](spark, known, folder)
    kept = {k for k, (_, c) in near_groups([(k, t) for k, t in rows.items() if k < 401]).items() if c == k}
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(kept)

    cut = stages["suffix_array_dedup"](spark, single, folder)
    ids = sorted(kept)
    left = dict(zip(ids, repeats([rows[k].encode() for k in ids])))
    assert cut.columns == columns and {r.doc_id: len(r.text.encode()) for r in cut.collect()} == {k: n - gone for k, (n, gone, _, _) in left.items()}
    assert any(gone for _, gone, _, _ in left.values())

    mix = stages["source_mixing"](spark, cut, folder)
    sizes, plan = mixing.plan_mix(cut)
    times = {r.doc_id: r.n for r in sizes.join(plan, "key").selectExpr("doc_id", "whole + cast(place <= cut as long) AS n").collect()}
    assert mix.columns == columns and Counter(r.doc_id for r in mix.collect()) == Counter({k: n for k, n in times.items() if n})

    out = stages["bpe_tokens"](spark, mix, folder).collect()
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert all(r.text == texts[r.doc_id] and len(r.token_ids) == 4 * r.n_tokens for r in out)


def test_run_is_the_stages_in_a_row(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    again = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "token_ids"]
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect())) and out.count() > 100


def test_clashing_columns_and_an_empty_table(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "doc_id AS size", "text AS spans", "'x' AS score", "1 AS `set`")
    out = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, folder)
        assert out.columns == table.columns
        out = out.checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else out
    empty = table.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
    assert empty.count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF_DIR)) == sql_rows(connect(SF_DIR), SQL[name])


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
