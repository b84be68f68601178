"""The manifest against a tree that is walked node by node, and what it says about altered rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from measurekit.llm import merkle
from measurekit.llm.shared import tune

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                     StructField("source", StringType()), StructField("n_chars", LongType())])


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row: tuple) -> str:
    doc_id, text, lang, source, n_chars = row
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(leaves: list[str], run: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The top, and each leaf's proof as (left, right) by level."""
    proofs: list[list[tuple[str, str]]] = [[] for _ in leaves]
    under, level = [[k] for k in range(len(leaves))], leaves
    while len(level) > 1:
        for k, members in enumerate(under):
            start = k - k % run
            sides = "".join(level[start:k]), "".join(level[k + 1:start + run])
            for m in members:
                proofs[m].append(sides)
        under = [sum(under[k:k + run], []) for k in range(0, len(level), run)]
        level = [h("".join(level[k:k + run])) for k in range(0, len(level), run)]
    return level[0], proofs


def expected(rows: list[tuple], run: int = 2) -> list[tuple]:
    groups: dict = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = members, *tree([leaf_of(r) for r in members], run)
    root, uppers = tree([trees[g][1] for g in order], run)
    out = []
    for g, upper in zip(order, uppers):
        members, subroot, proofs = trees[g]
        for row, proof in zip(members, proofs):
            proof = proof + upper
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[4] is not None:
                changed = (*row[:4], row[4] + 1)
            folded = leaf_of(changed)
            for left, right in proof:
                folded = h(left + folded + right)
            out.append((row[0], leaf_of(row), subroot, root, h("".join(a + b for a, b in proof)), folded, folded == root))
    return out


def query(spark, rows: list[tuple], tmp_path, parts: int = 3) -> list[tuple]:
    tune(spark)
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()]


def key(row: tuple) -> tuple:
    return tuple((v is not None, v) if v is not None else (False, 0) for v in row)


def made_rows(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(["en"] * 6 + ["de", "fr", None, "ü", ""])
        rows.append((k * 3 - 50, rng.choice(["", None, "tëxt " * rng.randint(1, 4), "a:1-"]), lang, rng.choice(["s1", None, "-"]), rng.choice([None, k, 7])))
    return rows


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 129, 700])
def test_query_equals_a_walked_tree(spark, tmp_path, n):
    rows = made_rows(n, n)
    assert sorted(query(spark, rows, tmp_path), key=key) == sorted(expected(rows), key=key)


def test_ties_nulls_and_repeated_rows(spark, tmp_path):
    rows = [(None, "a", "en", "s", 1)] * 3 + [(7, "b", "en", "s", 1)] * 70 + [(7, "c", "en", "s", 1)] * 2 + [(None, None, None, None, None)] * 5
    rows += [(9, "x" * 200_000, "de", "s", 200_000)]
    assert sorted(query(spark, rows, tmp_path), key=key) == sorted(expected(rows), key=key)


def test_every_row_its_own_group(spark, tmp_path):
    rows = [(k, "t", f"g{k:04d}", "s", k) for k in range(150)]
    assert sorted(query(spark, rows, tmp_path), key=key) == sorted(expected(rows), key=key)


def test_empty_table(spark, tmp_path):
    assert query(spark, [], tmp_path) == []


@pytest.mark.parametrize("run,levels", [(2, 1), (2, 3), (3, 2), (5, 1)])
def test_other_runs_and_bucket_heights(spark, run, levels):
    tune(spark)
    rows = made_rows(90, run)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("Tree", F.lit(1)).withColumn("merkle_root", F.lit("mine"))
    docs = docs.withColumn("leaf", merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]))
    out = merkle.manifest(docs, leaf="leaf", group="lang", order="doc_id", run=run, levels=levels)
    assert out.columns == [*docs.columns, "merkle_subroot", "merkle_root_", "merkle_proof"]
    got = out.select("doc_id", merkle.hex_text(F.col("merkle_subroot")), merkle.hex_text(F.col("merkle_root_")),
                     F.sha2(merkle.proof_text(F.col("merkle_proof")).cast("binary"), 256), merkle.fold(F.col("leaf"), F.col("merkle_proof"))).collect()
    want = [(r[0], r[2], r[3], r[4], r[3]) for r in expected(rows, run)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_an_altered_row_is_found(spark, tmp_path):
    rows = [(k, "t", "en", "s", k) for k in range(200)]
    got = query(spark, rows, tmp_path)
    assert {r[0] for r in got if not r[6]} == {k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 0}
