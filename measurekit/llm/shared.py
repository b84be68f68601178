"""Helpers of the training-data operators: shared scratch tables, fresh column names, linked groups, text batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one Arrow batch. Texts can be long, so batches are kept short; operators cut them further by bytes.
BATCH_ROWS = "512"


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the operators are written for."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS,
    }.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Only a local session without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="llm-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Tables written between the steps of one operator run. They cut lineage: a lost executor costs a re-read, not a re-run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.names.discard(name)

    def drop_others(self, *kept: str) -> None:
        """Delete all tables but those the result still reads."""
        self.drop(*sorted(self.names - set(kept)))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column end to end, and where each value starts (one more entry than values); null: empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `limit` bytes of the column, or one row."""
    for batch in batches:
        _, at = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, which gives memory it no longer uses back when a task ends: workers live on, and several share an executor."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links a[i]-b[i], in this order, join two groups that no earlier link joined."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    keep = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(ends[:len(a)].tolist(), ends[len(a):].tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep[k] = True
    return keep


def linked_groups(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(id, root): for each id in links (a, b), the smallest id it is linked to over any number of links.

    Rounds of hooking to the smallest neighbour and halving paths, each written to the shared folder. A round takes minima by
    key with partial sums before the shuffle, and joins that adaptive execution splits, so a hub is no hot group.
    """
    links = scratch.keep(links.filter("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), f"{name}-links")
    done = links.selectExpr("a AS id").union(links.selectExpr("b AS id")).distinct().withColumn("root", F.col("id"))
    done = scratch.keep(done, f"{name}-0")
    k = 0
    while True:
        # links between the roots as they are now; none left: done
        ends = (links.join(done.selectExpr("id AS a", "root AS ra"), "a").join(done.selectExpr("id AS b", "root AS rb"), "b")
                .filter("ra <> rb").selectExpr("least(ra, rb) AS lo", "greatest(ra, rb) AS hi").distinct())
        links = scratch.keep(ends.selectExpr("lo AS a", "hi AS b"), f"{name}-links-{k + 1}")
        if links.isEmpty():
            return done
        hook = links.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("up"))
        # follow hooks twice: a chain of roots shrinks to a quarter per round
        hook2 = hook.join(hook.selectExpr("root AS up", "up AS up2"), "up", "left").selectExpr("root", "coalesce(up2, up) AS up")
        moved = done.join(hook2, "root", "left").selectExpr("id", "coalesce(up, root) AS root")
        done, k = scratch.keep(moved, f"{name}-{k + 1}"), k + 1
        scratch.drop(f"{name}-{k - 1}")
