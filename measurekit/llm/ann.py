"""Approximate nearest neighbours by learned partitions.

On a bounded sample the neighbour graph is built and cut into balanced parts that keep neighbours together; a small network
learns to tell the parts apart by the vector alone. It files every row in its most probable part and sends a query to the several
most probable ones, whose rows are ranked exactly. How many parts a query visits is measured: some queries are answered against
all rows, and the smallest number is taken that finds the wanted share of their true neighbours.

Parts are cut into chunks, queries too, so no part has to fit a task; each chunk returns its nearest, which one window by query merges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from measurekit.llm.shared import Scratch
from measurekit.llm.vectors import kmeans, matrix, sample, sorted_groups, usable

SAMPLE = 6_144          # vectors the graph and the network are fitted on
NEIGHBOURS = 10
ROWS_A_PART = 8_192     # as the table grows, so does the number of parts
PARTS = (16, 512)
RECALL = 0.97           # measured on PROBES queries against all rows; the least asked for is 0.9
PROBES = 256
ROWS, QUERIES = 8_192, 2_048


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows with the largest inner product to each row, itself left out."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for s in range(0, len(x), 1024):
        score = x[s:s + 1024] @ x.T
        score[np.arange(len(score)), np.arange(s, s + len(score))] = -np.inf
        out[s:s + 1024] = np.argpartition(-score, out.shape[1] - 1, axis=1)[:, :out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """A part for each row, none above 1.1 times its share: from nearest centres, rows move to the part most of their neighbours
    are in while it has room, those with most to gain first."""
    n = len(x)
    room = int(np.ceil(1.1 * n / parts))
    centres = kmeans(x, parts)
    score = x @ centres.T - (centres ** 2).sum(1) / 2
    part = np.full(n, -1)
    size = np.zeros(parts, np.int64)
    for i in np.argsort(-score.max(1), kind="stable"):
        for p in np.argsort(-score[i], kind="stable"):
            if size[p] < room:
                break
        else:
            p = int(size.argmin())
        part[i], size[p] = p, size[p] + 1
    both = np.concatenate([np.c_[np.repeat(np.arange(n), graph.shape[1]), graph.ravel()], np.c_[graph.ravel(), np.repeat(np.arange(n), graph.shape[1])]])
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (both[:, 0], part[both[:, 1]]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable")[:int((gain > 0).sum())]:
            if size[best[i]] < room:
                size[part[i]] -= 1
                part[i] = best[i]
                size[best[i]] += 1
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A network of one hidden layer over scaled vectors: logits of the parts."""

    def __init__(self, x: np.ndarray, part: np.ndarray, parts: int, hidden: int = 128, epochs: int = 25, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.d, self.parts = x.shape[1], parts
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        w = [rng.normal(0, self.d ** -0.5, (self.d, hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, (hidden, parts)), np.zeros(parts)]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        z = (x - self.mean) / self.scale
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for s in range(0, len(z), 128):
                b = order[s:s + 128]
                h = np.maximum(z[b] @ w[0] + w[1], 0)
                logits = h @ w[2] + w[3]
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(b)), part[b]] -= 1
                p /= len(b)
                dh = (p @ w[2].T) * (h > 0)
                grads = [z[b].T @ dh + 1e-4 * w[0], dh.sum(0), h.T @ p + 1e-4 * w[2], p.sum(0)]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] -= 3e-3 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        self.w = w

    def order(self, x: np.ndarray) -> np.ndarray:
        """The parts of each row, most probable first; vectors of another length than those learned from all go to part 0.

        Products are summed in a fixed order, so equal vectors get equal parts wherever they lie."""
        if x.shape[1] != self.d:
            return np.zeros((len(x), 1), np.int64)
        h = np.maximum(np.einsum("nd,dh->nh", (x - self.mean) / self.scale, self.w[0]) + self.w[1], 0)
        return np.argsort(-np.round(np.einsum("nh,hp->np", h, self.w[2]) + self.w[3], 9), axis=1, kind="stable")


def fit(vectors: DataFrame, rows: int) -> Router | None:
    """The router of vectors(key, embedding), from a sample of one length (the most frequent in it)."""
    found = [np.array(r.embedding, np.float64) for r in sample(vectors, "key", SAMPLE, rows).select("embedding").collect()]
    if not found:
        return None
    lengths = [len(v) for v in found]
    d = max(sorted(set(lengths)), key=lengths.count)
    x = np.stack([v for v in found if len(v) == d])
    parts = 1 << int(np.ceil(np.log2(max(PARTS[0], min(PARTS[1], rows / ROWS_A_PART)))))
    parts = max(1, min(parts, len(x) // 16))
    part = balanced_parts(x, neighbour_graph(x, NEIGHBOURS), parts) if parts > 1 else np.zeros(len(x), np.int64)
    return Router(x, part, parts)


def _nearest(k: int):
    def work(table: pa.Table) -> pa.RecordBatch | None:
        query = table.column("query").to_numpy(zero_copy_only=False)
        qs, rows = np.flatnonzero(query), np.flatnonzero(~query)
        if not len(qs) or not len(rows):
            return None
        x, vec, key, part = matrix(table.column("embedding")), table.column("vec_id").to_numpy(), table.column("key").to_numpy(), table.column("part").to_numpy()
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        for s in range(0, len(qs), 256):
            q = qs[s:s + 256]
            rough = x[q] @ x[rows].T
            rough[key[q][:, None] == key[rows][None]] = -np.inf
            least = np.partition(rough, -k, axis=1)[:, -k] if len(rows) > k else np.full(len(q), -np.inf)
            i, j = np.nonzero((rough >= least[:, None] - 1e-9 * (1 + np.abs(least[:, None]))) & (rough > -np.inf))
            score = (x[q[i]] * x[rows[j]]).sum(1)
            order = np.lexsort((vec[rows[j]], -score, i))
            i, j, score = i[order], j[order], score[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            keep = rank < k
            for column, values in zip(out, (key[q[i]], vec[q[i]], vec[rows[j]], score, part[rows[j]])):
                column.append(values[keep])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_key", "query_id", "vec_id", "score", "part"])
    return work


def search(filed: DataFrame, sent: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """The k nearest of filed(key, vec_id, embedding, d, part) for each of sent (same columns, a row for each part to visit)."""
    sizes = filed.groupBy("d", "part").agg(F.count("*").alias("rows")).join(sent.groupBy("d", "part").agg(F.count("*").alias("queries")), ["d", "part"])
    sizes = sizes.select("d", "part", F.ceil(F.col("rows") / ROWS).alias("rp"), F.ceil(F.col("queries") / QUERIES).alias("qp"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = filed.join(sizes, ["d", "part"]).withColumn("r", F.pmod(F.xxhash64("key"), "rp")).withColumn("q", every("qp")).withColumn("query", F.lit(False))
    queries = sent.join(sizes, ["d", "part"]).withColumn("q", F.pmod(F.xxhash64("key"), "qp")).withColumn("r", every("rp")).withColumn("query", F.lit(True))
    met = rows.unionByName(queries).select(F.xxhash64("d", "part", "r", "q").alias("group"), "key", "vec_id", "embedding", "part", "query")
    near = sorted_groups(met, _nearest(k), "query_key long, query_id long, vec_id long, score double, part long")
    best = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 20, *, recall: float = RECALL, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row that the condition picks, by inner product, best first.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null id; only vectors of one
    length are compared. Equal vectors tie by smaller vec_id. Rows with one vec_id count as different rows. A query whose parts hold
    fewer than k other rows is answered from all parts, so it gets k, or as many as there are. An empty table has no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "parts")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = scratch.keep(rows.withColumn("key", F.monotonically_increasing_id()).withColumn("d", F.size("embedding").cast("long")), "rows")
    n = rows.count()
    router = fit(rows, n)
    shared = spark.sparkContext.broadcast(router)

    def route(visits: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("embedding")
                size = lists.value_lengths().to_numpy(zero_copy_only=False)
                for d in np.unique(size):
                    of = np.flatnonzero(size == d)
                    order = shared.value.order(matrix(lists.take(pa.array(of))))
                    order = order[:, :visits] if visits else order
                    row = np.repeat(of, order.shape[1])
                    taken = batch.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(order.ravel()), pa.array(np.tile(np.arange(1, order.shape[1] + 1), len(of)))], [*taken.schema.names, "part", "turn"])
        return run

    columns, kind = ["key", "vec_id", "embedding", "d"], rows.select("key", "vec_id", "embedding", "d", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("turn")).schema
    filed = scratch.keep(rows.select(*columns).mapInArrow(route(1), kind).drop("turn"), "filed")
    asks = rows.filter("asks").select(*columns)
    few = sample(asks, "key", PROBES, asks.count())
    all_turns = few.mapInArrow(route(None), kind)
    hits = search(filed, all_turns.drop("turn"), k, scratch).join(all_turns.select(F.col("key").alias("query_key"), "part", "turn"), ["query_key", "part"])
    turns = {r.turn: r.n for r in hits.groupBy("turn").agg(F.count("*").alias("n")).collect()}
    visits, got = 1, turns.get(1, 0)
    while got < recall * sum(turns.values()):
        visits += 1
        got += turns.get(visits, 0)
    found = scratch.keep(search(filed, asks.mapInArrow(route(visits), kind).drop("turn"), k, scratch), "found")
    # queries whose parts hold too few other rows go to all parts
    others = filed.groupBy("d").agg((F.count("*") - 1).alias("others"))
    got = found.groupBy(F.col("query_key").alias("key")).agg(F.count("*").alias("got"))
    short = asks.join(others, "d").join(got, "key", "left").filter(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.col("others"))).select(*columns)
    short = scratch.keep(short, "short")
    if not short.isEmpty():
        rest = search(filed, short.mapInArrow(route(None), kind).drop("turn"), k, scratch)
        found = found.join(short.select(F.col("key").alias("query_key")), "query_key", "left_anti").unionByName(rest)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_ann_search(spark, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
