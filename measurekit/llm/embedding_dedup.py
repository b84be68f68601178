"""Near-duplicate embeddings by an inverted multi-index.

Vectors are scaled to length one and cut into halves; each half has its own codebook, and the pairs of codewords are the cells of a
product grid. A vector is filed in one cell and visits others in the order of how near they can come to it: half by half, a cell
lies at least as far away as the planes between its codeword and the others, so sums of the two squared distances in rising
order are the multi-sequence traversal. Two vectors with the wanted cosine are no further apart than the radius it stands for,
so the visits stop there, and the target recall is 1: no pair is missed. Pairs that meet are verified in double precision.

Equal vectors are one node with a multiplicity. A pair of cells is visited from one side only. Cells and their visitors are cut into
parts, so a dense cell is many tasks; from each part come the link counts of its vectors and a spanning forest of its links,
never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measurekit.llm.shared import Scratch, forest, linked_groups
from measurekit.llm.vectors import by_dimension, kmeans, matrix, sample, sorted_groups, usable

COSINE = 0.98
SAMPLE = 16_384         # vectors the codebooks are fitted on
WORDS = 256             # most codewords of a half
HOSTS, GUESTS = 1024, 4096


class Codebooks:
    """For each length of vectors, centres of both halves and the distances between centres."""

    def __init__(self, vectors: list[np.ndarray], words: int):
        self.halves: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for d, rows in by_dimension(vectors).items():
            x = np.stack([vectors[k] for k in rows])
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            centres = [kmeans(h, words) for h in (x[:, :d // 2], x[:, d // 2:])]
            self.halves[d] = [(c, np.linalg.norm(c[:, None] - c[None], axis=2)) for c in centres]

    def reach(self, half: np.ndarray, d: int, which: int) -> tuple[np.ndarray, np.ndarray]:
        """The codeword of each row, and for every codeword the square of how far its cell is away at least."""
        centres, apart = self.halves[d][which]
        far = (half ** 2).sum(1)[:, None] + (centres ** 2).sum(1)[None] - 2 * half @ centres.T
        # the plane between codewords i and j is (far_i - far_j) / (2 * distance of i and j) away
        gap = np.zeros_like(far)
        for j in range(len(centres)):
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (far - far[:, j:j + 1]) / (2 * apart[j])[None]
            plane[:, j] = 0
            np.maximum(gap, plane, out=gap)
        return far.argmin(1), gap ** 2

    def visits(self, x: np.ndarray, radius2: float) -> tuple[np.ndarray, ...]:
        """(row, cell of the row, visited cell): the row's own cell and all later ones within the radius, nearest first."""
        d = x.shape[1]
        if d not in self.halves:                                        # a length the sample lacks: one cell
            rows = np.arange(len(x))
            return rows, np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        (w1, g1), (w2, g2) = self.reach(x[:, :d // 2], d, 0), self.reach(x[:, d // 2:], d, 1)
        m = g2.shape[1]
        home = w1 * m + w2
        order1, order2 = np.argsort(g1, axis=1, kind="stable"), np.argsort(g2, axis=1, kind="stable")
        s1, s2 = np.take_along_axis(g1, order1, 1), np.take_along_axis(g2, order2, 1)
        rows, cells = [], []
        slack = radius2 * (1 + 1e-9) + 1e-12
        for a in range(s1.shape[1]):
            left = slack - s1[:, a]
            if (left < 0).all():
                break
            r, b = np.nonzero(s2 <= left[:, None])
            cell = order1[r, a] * m + order2[r, b]
            later = cell >= home[r]
            rows.append(r[later])
            cells.append(cell[later])
        rows, cells = np.concatenate(rows), np.concatenate(cells)
        return rows, home[rows], cells


def _links(cosine: float):
    def work(table: pa.Table) -> pa.RecordBatch | None:
        host = table.column("host").to_numpy(zero_copy_only=False)
        hosts, guests = np.flatnonzero(host), np.flatnonzero(~host)
        if not len(hosts) or not len(guests):
            return None
        key, many = table.column("key").to_numpy(), table.column("many").to_numpy()
        label, home = table.column("label").to_numpy(), table.column("home").to_numpy(zero_copy_only=False)
        x = matrix(table.column("embedding"))
        norm = np.sqrt((x * x).sum(1))
        unit = x / norm[:, None]
        a, b = [], []
        for s in range(0, len(guests), 512):
            g = guests[s:s + 512]
            c = unit[g] @ unit[hosts].T
            i, j = np.nonzero(c >= cosine - 1e-9)
            i, j = g[i], hosts[j]
            # two vectors of one cell meet twice: once counts
            fine = (label[i] == label[j]) & (~home[i] | (key[i] < key[j]))
            i, j = i[fine], j[fine]
            near = (x[i] * x[j]).sum(1) / (norm[i] * norm[j]) >= cosine
            a.append(i[near])
            b.append(j[near])
        a, b = np.concatenate(a), np.concatenate(b)
        if not len(a):
            return None
        n = np.zeros(len(key), np.int64)
        np.add.at(n, a, many[b])
        np.add.at(n, b, many[a])
        some = np.flatnonzero(n)
        keep = forest(key[a], key[b])
        links = np.unique(np.stack([np.minimum(key[a[keep]], key[b[keep]]), np.maximum(key[a[keep]], key[b[keep]])]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.r_[np.zeros(links.shape[1], bool), np.ones(len(some), bool)]), pa.array(np.r_[links[0], key[some]]), pa.array(np.r_[links[1], n[some]])],
                                          ["counts", "a", "b"])
    return work


def link_embeddings(vectors: DataFrame, cosine: float = COSINE, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors.

    Vectors that are null, zero or hold null or non-finite components, and those with a null label, link with nothing and are their
    own component. Only vectors of one length are compared. Rows with an equal vector and label are linked, repeated rows too; the
    smallest vec_id of a component ignores null ids. Equal vectors are known by a 64-bit hash of label and vector.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "multi-index")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    rows = rows.withColumn("key", F.when(usable(F.col("embedding")) & F.col("label").isNotNull(), F.xxhash64("label", "embedding")))
    nodes = scratch.keep(rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"), F.min("label").alias("label"), F.min("embedding").alias("embedding")), "nodes")
    total, largest = nodes.groupBy("label").count().agg(F.sum("count"), F.max("count")).first()
    total, largest = total or 0, largest or 0
    words = int(min(WORDS, max(2, round(largest ** 0.25))))
    books = Codebooks([np.array(r.embedding, np.float64) for r in sample(nodes, "key", SAMPLE, total).select("embedding").collect()], words)
    shared, radius2 = spark.sparkContext.broadcast(books), 2 * (1 - cosine)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, label, lists = batch.column("key").to_numpy(), batch.column("label").to_numpy(), batch.column("embedding")
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(size):
                of = np.flatnonzero(size == d)
                x = matrix(lists.take(pa.array(of)))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                row, home, cell = shared.value.visits(x, radius2)
                yield pa.RecordBatch.from_arrays([pa.array(key[of[row]]), pa.array(label[of[row]]), pa.array(np.full(len(row), d, np.int64)), pa.array(cell), pa.array(cell == home)], ["key", "label", "d", "cell", "home"])

    visits = nodes.select("key", F.col("label").cast("long").alias("label"), "embedding").mapInArrow(visit, "key long, label long, d long, cell long, home boolean")
    visits = scratch.keep(visits, "visits")
    cells = visits.groupBy("label", "d", "cell").agg(F.count("*").alias("guests"), F.sum(F.col("home").cast("long")).alias("hosts")).filter("hosts > 0")
    cells = cells.select("label", "d", "cell", F.ceil(F.col("hosts") / HOSTS).alias("hp"), F.ceil(F.col("guests") / GUESTS).alias("gp"))
    seated = visits.join(cells, ["label", "d", "cell"])
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    hosts = seated.filter("home").withColumn("h", F.pmod(F.xxhash64("key"), "hp")).withColumn("g", every("gp")).withColumn("host", F.lit(True))
    guests = seated.withColumn("g", F.pmod(F.xxhash64("key"), "gp")).withColumn("h", every("hp")).withColumn("host", F.lit(False))
    met = hosts.unionByName(guests).select(F.xxhash64("label", "d", "cell", "h", "g").alias("group"), "key", "label", "home", "host")
    met = met.join(nodes.select("key", "many", "embedding"), "key")
    found = scratch.keep(sorted_groups(met, _links(cosine), "counts boolean, a long, b long"), "found")
    groups = linked_groups(scratch, found.filter("NOT counts").select("a", "b"), "groups")
    counts = found.filter("counts").groupBy(F.col("a").alias("key")).agg(F.sum("b").alias("others"))
    named = nodes.select("key", "least", "many").join(groups.withColumnRenamed("id", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")).join(counts, "key", "left")
    named = scratch.keep(named, "named")
    scratch.drop_others("named")
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "component_id", (F.coalesce("others", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    out = rows.select("vec_id", "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op5_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    return link_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


# All pairs of one label, for small tables with unique ids.
SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (
  SELECT vec_id AS id, vec_id AS other FROM embeddings
  UNION SELECT r.id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.x = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) c ON c.id = e.vec_id
"""
