"""Mixing against its SQL and a plain water-filling."""

from __future__ import annotations

import random

import pytest

from measurekit.llm import mixing
from measurekit.llm.shared import tune
from tests.oracle_compare import connect, spark_rows, sql_rows

SCHEMA = "doc_id long, text string, source string"


def docs(seed: int) -> list[tuple[int | None, str | None, str | None]]:
    r = random.Random(seed)
    sources = ["a", "b", "B", "é", None, "hot", "hot", "hot", "hot"]
    out = [(k, " ".join("w" for _ in range(int(r.expovariate(1 / 30)))), r.choice(sources)) for k in range(600)]
    return out + [(1000, None, "null only"), (1001, "", "a"), (1002, "x " * 20_000, "hot"), (1, "w w", "a"), (1, "w w", "a"), (None, "w w w", None), (2000, "one\x0btwo\x0cthree four", "b")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("mix"))
    tune(spark).createDataFrame(docs(4), SCHEMA).coalesce(1).write.parquet(f"{path}/parts")
    import glob
    import shutil
    shutil.copy(glob.glob(f"{path}/parts/part-*.parquet")[0], f"{path}/documents.parquet")
    return path


def test_equals_sql(spark, folder):
    assert spark_rows(mixing.op3_source_mixing(spark, folder)) == sql_rows(connect(folder), mixing.SQL)


def test_targets_are_the_feasible_water_level(spark, folder):
    rows = mixing.op3_source_mixing(spark, folder).collect()
    targets = {r.source_size: r.target for r in rows}
    sizes: dict[str | None, int] = {}
    for _, text, source in docs(4):
        sizes[source] = sizes.get(source, 0) + len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")])
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    clamped: set[str | None] = set()
    while True:
        free = [s for s in sizes if s not in clamped]
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in clamped)) / sum(weight[s] for s in free)
        more = {s for s in free if 3 * sizes[s] < level * weight[s]}
        if not more:
            break
        clamped |= more
    for s in sizes:
        assert targets[sizes[s]] == pytest.approx(3 * sizes[s] if s in clamped else level * weight[s])
    assert sum({s: targets[sizes[s]] for s in sizes}.values()) == pytest.approx(sum(sizes.values()))


def test_taken_words_come_near_the_target(spark, folder):
    rows = mixing.op3_source_mixing(spark, folder).collect()
    again = mixing.op3_source_mixing(spark, folder).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.source_size, []).append(r)
    for group in by.values():
        assert all(r.taken <= 3 * r.size for r in group)
        assert abs(sum(r.taken for r in group) - group[0].target) <= max(r.size for r in group)


def test_rows_of_the_mix(spark):
    rows = tune(spark).createDataFrame([(k, "w " * 10, "s" if k % 2 else None, k) for k in range(40)], SCHEMA + ", mix_key long")
    out = mixing.mix_sources(rows)
    assert out.columns == rows.columns and 390 <= 10 * out.count() <= 410
    assert mixing.mix_sources(rows.limit(0)).count() == 0
