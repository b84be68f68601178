"""What the operators on embeddings share: which vectors count, bounded samples, vectors as arrays, rows sorted by group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Not null, not zero, and no component null, NaN or infinite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def sample(vectors: DataFrame, key: str, most: int, rows: int) -> DataFrame:
    """About `most` of `rows` vectors, chosen by a hash of their key: the bounded sample that models are fitted on."""
    return vectors.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int(min(1.0, most / max(rows, 1)) * (1 << 30))))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def by_dimension(vectors: list[np.ndarray | list]) -> dict[int, np.ndarray]:
    out: dict[int, list[int]] = {}
    for k, v in enumerate(vectors):
        out.setdefault(len(v), []).append(k)
    return {d: np.array(rows) for d, rows in out.items()}


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k centres of the rows of x, fewer if there are fewer distinct rows."""
    x = np.asarray(x, np.float64)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k or x.shape[1] == 0:
        return distinct[:max(1, min(k, len(distinct)))]
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = ((centres ** 2).sum(1) - 2 * x @ centres.T).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def sorted_groups(rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch | None], schema: str, by: str = "group") -> DataFrame:
    """`work` on the rows of each value of a column. Groups hold a bounded number of rows; their keys are dealt over tasks by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            key = table.column(by).to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
            for s, e in zip(cuts[:-1], cuts[1:]):
                out = work(table.slice(s, e - s).combine_chunks())
                if out is not None:
                    yield out
            rest = table.slice(cuts[-1])
        if rest is not None:
            out = work(rest.combine_chunks())
            if out is not None:
                yield out

    return rows.repartition(by).sortWithinPartitions(by).mapInArrow(run, schema)
