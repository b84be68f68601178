"""Quality ranking: held-out accuracy, the loss it is fitted by, and rows it must not trip over."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from measurekit.llm import quality
from measurekit.llm.shared import tune

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
LABELS = StructType([StructField("doc_id", LongType()), StructField("quality", IntegerType()), StructField("toxic", IntegerType())])
SF_DIR = "/root/testdata/sf0.01"


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice("aeionrstldm") for _ in range(rng.randint(1, 9))) for _ in range(n)]
    return ". ".join(" ".join(words[k:k + 9]).capitalize() for k in range(0, n, 9)) + "."


def junk(rng: random.Random, n: int) -> str:
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w + rng.choice(["###", "%%", "$$"]) for w in prose(rng, n).split())
    if kind == 1:
        return (prose(rng, 6) + "\n") * max(n // 6, 3)
    return " | ".join(prose(rng, n).upper().split())


def corpus(n: int, seed: int) -> tuple[list, list]:
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        good = rng.random() < 0.7
        docs.append((k, (prose if good else junk)(rng, rng.randint(10, 200))))
        labels.append((k, int(good), rng.randrange(2)))
    return docs, labels


def run(spark, docs, labels, tmp_path) -> dict:
    tune(spark)
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return [tuple(r) for r in quality.op12_quality_classifier(spark, str(tmp_path)).collect()]


def auc(score: np.ndarray, label: np.ndarray) -> float:
    good, bad = score[label == 1], score[label == 0]
    return float(np.mean((good[:, None] > bad) + 0.5 * (good[:, None] == bad)))


def test_held_out_accuracy(spark, tmp_path):
    docs, labels = corpus(400, 1)
    # labels of held-out rows are wrong on purpose: nothing may be learned from them
    told = [(k, 1 - q if held_out(k) else q, t) for k, q, t in labels]
    got = {r[0]: r for r in run(spark, docs, told, tmp_path)}
    assert all(got[k][1] == held_out(k) and 0 <= got[k][2] <= 1 and got[k][3] == (got[k][2] >= 0.7) for k, _, _ in labels)
    score, label = np.array([got[k][2] for k, _, _ in labels]), np.array([q for _, q, _ in labels])
    held = np.array([held_out(k) for k, _, _ in labels])
    assert auc(score[held], label[held]) > 0.99
    assert np.mean((score[held] >= 0.7) == label[held]) > 0.95


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_held_out_accuracy_on_the_given_tables(spark):
    tune(spark)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = quality.op12_quality_classifier(spark, SF_DIR).collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    score, label = np.array([r["score"] for r in held]), np.array([labels[r["doc_id"]] for r in held])
    assert auc(score, label) > 0.97
    assert np.mean([r["predicted"] for r in held if labels[r["doc_id"]]]) > 0.97


def test_nulls_ties_conflicts_and_long_texts(spark, tmp_path):
    docs, labels = corpus(120, 2)
    docs += [(None, "a b"), (500, None), (501, ""), (502, " \n"), (503, "x" * 300_000), (504, "w " * 200_000), (0, docs[0][1]), (0, docs[0][1])]
    labels += [(None, 1, 0), (1, None, 0), (2, 7, 0), (3, 1 - labels[3][1], 0), (9999, 1, 1), (4, labels[4][1], 0)]
    got = run(spark, docs, labels, tmp_path)
    assert sorted(str(r[0]) for r in got) == sorted(str(d[0]) for d in docs)
    by_id = {}
    for r in got:
        assert 0 <= r[2] <= 1 and r[3] in (0, 1)
        by_id.setdefault(r[0], set()).add(r[1:])
    assert all(len(v) == 1 for v in by_id.values())
    assert by_id[500] and {v[1] for v in by_id[500]} == {v[1] for v in by_id[501]}
    assert next(iter(by_id[None]))[0] is False


@pytest.mark.parametrize("labels", [[], [(k, 1, 0) for k in range(20)]])
def test_without_both_labels_all_are_alike(spark, tmp_path, labels):
    docs = corpus(20, 3)[0]
    assert {r[2:] for r in run(spark, docs, labels, tmp_path)} == {(0.5, 0)}


def test_empty_tables(spark, tmp_path):
    assert run(spark, [], [], tmp_path) == []


def test_weights_are_where_the_slope_of_the_loss_is_zero():
    docs, labels = corpus(60, 4)
    x, y = np.array([quality.measure(t) for _, t in docs]), np.array([q for _, q, _ in labels])
    model = quality.fit(x, y)
    rows, rng = model.basis(x), np.random.default_rng(11)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    winners = np.concatenate([np.repeat(good, quality.RIVALS), rng.choice(good, len(bad) * quality.RIVALS)])
    losers = np.concatenate([rng.choice(bad, len(good) * quality.RIVALS), np.repeat(bad, quality.RIVALS)])

    def loss(w):
        return np.log1p(np.exp(-(rows[winners] - rows[losers]) @ w)).mean() + quality.PENALTY / 2 * w @ w

    best = loss(model.weights)
    for _ in range(30):
        assert loss(model.weights + rng.normal(size=len(model.weights)) * 1e-2) >= best - 1e-9
    # the threshold is the quantile of the share of label 0
    assert abs(np.mean(rows @ model.weights < model.threshold) - np.mean(y == 0)) < 0.02


def test_all_labelled_documents_are_learned_from(spark):
    """Many blocks, a rare label and ties: knots, threshold and weights are those of all documents, and no label is left out."""
    tune(spark)
    docs, labels = corpus(900, 6)
    told = [(k, 1 if k % 9 else 0, t) for k, _, t in labels]
    x = np.array([quality.measure(t) for _, t in docs])
    kept = [k for k, _, _ in told if not held_out(k)]
    model = quality.learn(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(told, LABELS), block=100)
    y = np.array([told[k][1] for k in kept])
    assert np.allclose(model.knots, np.quantile(x[kept], quality.KNOTS, axis=0).T, rtol=1e-12, atol=1e-15)
    assert np.allclose(model.spread, np.maximum(x[kept].std(0), 1e-6), rtol=1e-6, atol=1e-9)
    utility = (model.basis(x[kept]) * model.weights).sum(1)
    ranked, bad = np.sort(utility), int((y == 0).sum())
    assert abs(model.threshold - (ranked[bad - 1] + ranked[bad]) / 2) < 1e-9
    assert abs(model.scale - max((np.median(utility[y == 1]) - np.median(utility[y == 0])) / 8, 1e-6)) < 1e-9
    again = quality.learn(spark.createDataFrame(docs, DOCS).repartition(2), spark.createDataFrame(told, LABELS), block=100)
    assert np.array_equal(again.weights, model.weights) and again.threshold == model.threshold


def test_order_statistics_are_exact(spark):
    rng = np.random.default_rng(2)
    v = np.r_[rng.normal(size=300), np.zeros(50), -0.0, 1e300, -1e-300]
    rows = tune(spark).createDataFrame([(float(a),) for a in v], "v double").repartition(3)
    found = quality.order_statistics(rows, lambda b: np.array(b.column("v"), np.float64).reshape(-1, 1), [(0, k) for k in range(len(v))])
    assert found == np.sort(v).tolist()


def test_other_columns_stay(spark):
    tune(spark)
    docs = spark.createDataFrame([(1, "a b", 0.5)], "Quality_Score long, text string, score double")
    out = quality.rank_documents(docs, quality.fit(np.zeros((0, len(quality.MEASURES))), np.zeros(0)))
    assert out.columns == ["Quality_Score", "text", "score", "quality_score_"] and tuple(out.first()) == (1, "a b", 0.5, 0.5)
