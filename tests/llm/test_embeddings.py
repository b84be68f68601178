"""Links between embeddings and nearest neighbours against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from measurekit.llm import ann, embedding_dedup
from measurekit.llm.shared import tune

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed: int, n: int = 500, d: int = 16) -> list[tuple[int | None, list | None, int | None]]:
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, d))
    for k in range(0, n, 3):                                 # near copies around the threshold, chains, exact copies
        base[k] = base[r.integers(n)] + r.normal(size=d) * r.choice([0.0, 0.05, 0.15, 0.2])
    base[::50] = base[7]
    out: list[tuple[int | None, list | None, int | None]] = [(int(k), [float(np.float32(v)) for v in row], int(r.integers(3))) for k, row in enumerate(base)]
    same = [1.0] + [0.0] * (d - 1)
    odd = [None, [], [0.0] * d, [math.nan] + [1.0] * (d - 1), [math.inf] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), same, same, [2 * v for v in same], [1.0, 2.0], [1.0, 2.001], [3.0]]
    return out + [(1000 + 20 * k, v, 1) for k, v in enumerate(odd)] + [(2000, same, None), (2001, same, None), (1120, same, 1), (None, same, 1)]


def usable(v) -> bool:
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute_links(rows) -> list[tuple]:
    ok = [usable(v) and label is not None for _, v, label in rows]
    root = list(range(len(rows)))
    n = [0] * len(rows)

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, v, label) in enumerate(rows):
        for j in range(i):
            w = rows[j][1]
            if ok[i] and ok[j] and label == rows[j][2] and len(v) == len(w):
                a, b = np.array(v, np.float64), np.array(w, np.float64)
                if (a * b).sum() / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum())) >= 0.98:
                    n[i], n[j] = n[i] + 1, n[j] + 1
                    root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, n[i], least.get(find(i)), k == least.get(find(i))) for i, (k, _, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("hosts,guests", [(1024, 4096), (3, 5)])
def test_links_equal_all_pairs(spark, monkeypatch, hosts, guests):
    monkeypatch.setattr(embedding_dedup, "HOSTS", hosts)
    monkeypatch.setattr(embedding_dedup, "GUESTS", guests)
    rows = vectors(1)
    found = embedding_dedup.link_embeddings(tune(spark).createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, found), key=str) == brute_links(rows)


def test_no_vector_within_the_radius_is_left_out():
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 12))
    books = embedding_dedup.Codebooks(list(x), 6)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + r.normal(size=x.shape) * 0.05
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    radius2 = float(((x - y) ** 2).sum(1).max())
    both = np.concatenate([x, y])
    row, home, cell = books.visits(both, radius2)
    own = dict(zip(row.tolist(), home.tolist()))
    seen = set(zip(row.tolist(), cell.tolist()))
    for k in range(len(x)):
        assert (k, own[k + len(x)]) in seen or (k + len(x), own[k]) in seen


def test_empty_tables(spark):
    empty = tune(spark).createDataFrame([], SCHEMA)
    assert embedding_dedup.link_embeddings(empty).count() == 0
    assert ann.nearest_neighbours(empty, F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0], 1), (3, None, 2)], SCHEMA)
    assert embedding_dedup.link_embeddings(one).count() == 2 and ann.nearest_neighbours(one, F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("chunk", [8192, 50])
def test_neighbours(spark, monkeypatch, chunk):
    monkeypatch.setattr(ann, "ROWS", chunk)
    monkeypatch.setattr(ann, "QUERIES", chunk)
    rows = vectors(2)
    found = ann.nearest_neighbours(tune(spark).createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 20).collect()
    good = [(k, np.array(v, np.float64)) for k, v, _ in rows if usable(v) and k is not None]
    of: dict[int, list] = {}
    for r in found:
        of.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = asked = 0
    for i, (k, v) in enumerate(good):
        if k % 20 or k == 1120:                              # 1120 is the id of two rows
            continue
        want = sorted((-(v * w).sum(), j) for m, (j, w) in enumerate(good) if m != i and len(w) == len(v))[:20]
        got = sorted(of.get(k, []))
        assert [r for r, _, _ in got] == list(range(1, len(want) + 1))
        assert [(-s, j) for _, j, s in got] == sorted((-s, j) for _, j, s in got)
        hit += len({j for _, j in want} & {j for _, j, _ in got})
        asked += len(want)
    assert hit >= 0.9 * asked


def test_parts_are_balanced_and_equal_vectors_stay_together():
    x = np.random.default_rng(4).normal(size=(600, 8))
    part = ann.balanced_parts(x, ann.neighbour_graph(x, 5), 8)
    assert np.bincount(part, minlength=8).max() <= math.ceil(1.1 * 600 / 8) and part.min() >= 0
    router = ann.Router(x, part, 8)
    order = router.order(np.repeat(x[:5], 300, axis=0))
    assert all((order[300 * k:300 * (k + 1)] == order[300 * k]).all() for k in range(5))
    assert (router.order(x)[:, 0] == part).mean() > 0.5


def test_queries_whose_parts_hold_too_few_rows_get_all(spark, monkeypatch):
    """Most rows in one part, the others in parts of a handful: a query there finds fewer than 20 at first."""
    r = np.random.default_rng(5)
    rows = [(k, [float(r.random()) * (1.0 if k % 5 == 0 else 0.5), float(r.random()), 1.0], 0) for k in range(400)]
    vectors = np.array([v for _, v, _ in rows])
    part = np.where(vectors[:, 0] > 0.5, 1 + (vectors[:, 1] * 30).astype(np.int64), 0)
    router = ann.Router(vectors, part, 32, epochs=80)
    filed = router.order(vectors)[:, 0]
    assert min(np.bincount(filed)[filed[::20]]) < 20
    monkeypatch.setattr(ann, "fit", lambda rows, n: router)
    found = ann.nearest_neighbours(tune(spark).createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 20, recall=0.01).collect()
    of: dict[int, list] = {}
    for x in found:
        of.setdefault(x.query_id, []).append((x["rank"], x.vec_id))
    assert set(of) == set(range(0, 400, 20)) and all([a for a, _ in sorted(v)] == list(range(1, 21)) for v in of.values())
    x = {k: np.array(v) for k, v, _ in rows}
    for k in of:
        if (filed == filed[k]).sum() <= 20:
            assert [j for _, j in sorted(of[k])] == [j for j in sorted((j for j in x if j != k), key=lambda j: (-(x[k] * x[j]).sum(), j))[:20]]
