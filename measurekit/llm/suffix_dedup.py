"""Exact substring dedup: the bytes covered by a string of LENGTH bytes that also starts somewhere else.

Prefix doubling: the name of the 2h bytes from a position is made of the pair of names of its h bytes and of the h bytes at
offset h. Names up to the threshold are doubled where a document lies, because both halves are in it; Spark sorts and counts them
across documents in three rounds of growing length, and after each only positions whose name is not unique go on:

1. GRAM bytes, at the positions that are the smallest name of some window of LENGTH bytes. Two equal windows choose the same
   position, so about one position in LENGTH / 3 stands for all; a window can only be repeated if its position's name is.
2. The union of all windows that chose a position. If it occurs again, all of them are repeated, whatever their number.
3. LENGTH bytes, where equal positions lie in different surroundings (the ends of a repeated passage): one member of each kind
   of surroundings is compared with the others. Kinds are few in most groups, which then fit one task; beyond GROUP kinds
   the windows are named one by one and counted by Spark, so that no group has to fit a task.

Names have 64 bits; a name of round 2 or 3 is compared only among positions whose name of round 1 is equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measurekit.llm.shared import Scratch, by_bytes, fresh, lean, mix64, text_bytes

LENGTH = 200
GRAM = 48
WINDOWS = LENGTH - GRAM + 1          # positions a window chooses from; offsets are packed into a byte
PAIRS = 64
GROUP = 1 << 15
SEGMENT = 1 << 20                    # bytes of one document named at a time
_U = np.uint64
_POSITION = _U((1 << 24) - 1)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    x = a * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(32)
    x += b
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    return x


def doubled(data: np.ndarray, top: int) -> dict[int, np.ndarray]:
    """The names of 1, 2, 4 ... top bytes from every position that has so many behind it."""
    names = {1: _BYTE[data]}
    h = 1
    while h < top:
        a = names[h]
        names[2 * h] = pair(a[:-h], a[h:]) if len(a) > h else a[:0]
        h *= 2
    return names


def long_names(names: np.ndarray, h: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of data[start:end], between h and 3h bytes, from those of h bytes."""
    return pair(pair(names[start], names[start + (end - start - h) // 2]), names[end - h]) + (end - start).astype(np.uint64)


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[:len(x) - (width - n)], x[width - n:]) if n < width else x


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Chosen positions of documents data[at[i]:at[i + 1]], in all under 16 MB: document, position's name, name of the union of
    the windows that chose it, first and last of these windows, position."""
    lens = np.diff(at)
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH or lens.max(initial=0) < LENGTH:
        return empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    names = doubled(data, 128)
    gram = pair(names[32][:-(GRAM - 32)], names[32][GRAM - 32:])
    choice = window_min((gram & ~_POSITION) | np.arange(len(gram), dtype=np.uint64), WINDOWS)
    doc = np.repeat(np.arange(len(lens)), lens)[:len(choice)]
    whole = np.arange(len(choice)) + LENGTH <= at[1:][doc]
    chosen = np.where(whole, (choice & _POSITION).astype(np.int64), -1)
    first = np.ones(len(chosen), bool)
    first[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    lo = np.flatnonzero(first)
    hi = np.append(lo[1:], len(chosen)) - 1
    lo, hi = lo[chosen[lo] >= 0], hi[chosen[lo] >= 0]
    a = chosen[lo]
    union = long_names(names[128], 128, lo, hi + LENGTH) + (a - lo).astype(np.uint64) * _U(0x9E3779B97F4A7C15)
    return doc[lo], gram[a], union, lo, hi, a


def packed(lo: np.ndarray, hi: np.ndarray, a: np.ndarray) -> np.ndarray:
    return lo << 16 | (a - lo) << 8 | (hi - lo)


def _name_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "data"):
        data, at = text_bytes(batch.column("data"))
        keys = batch.column("doc").to_numpy()
        parts = [(data, at, 0)] if len(data) <= 2 * SEGMENT else [
            (data[s:s + SEGMENT + LENGTH - 1], np.array([0, min(SEGMENT + LENGTH - 1, len(data) - s)]), s) for s in range(0, len(data), SEGMENT)]
        for piece, ends, base in parts:
            doc, name, union, lo, hi, a = anchors(piece, ends)
            lo, hi, a = (x - ends[doc] + base for x in (lo, hi, a))
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(union.view(np.int64)), pa.array(keys[doc]), pa.array(packed(lo, hi, a))], ["name", "surround", "doc", "at"])


def _cut_surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, n, kinds, doc, at) of a document with its bytes to rows with the bytes of all windows of the position."""
    for batch in by_bytes(batches, "data"):
        data, ends = text_bytes(batch.column("data"))
        out: list[list] = [[] for _ in range(6)]
        size = 0
        for i, (doc, rows) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("rows").to_pylist())):
            for row in rows:
                lo, span = row["at"] >> 16, row["at"] & 255
                cut = data[ends[i] + lo:ends[i] + lo + span + LENGTH].tobytes()
                size += len(cut)
                for column, value in zip(out, (row["name"], row["n"], row["kinds"], doc, row["at"], cut)):
                    column.append(value)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([*map(pa.array, out[:5]), pa.array(out[5], pa.binary())], ["name", "n", "kinds", "doc", "at", "around"])
                out, size = [[] for _ in range(6)], 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([*map(pa.array, out[:5]), pa.array(out[5], pa.binary())], ["name", "n", "kinds", "doc", "at", "around"])


def compare_group(at: np.ndarray, around: list[bytes], n: np.ndarray) -> list[tuple[int, int, int]]:
    """(member, first, last window) repeated by another member, for members that occur once."""
    back = (at >> 8) & 255
    m, left = len(at), WINDOWS - 1
    table = np.empty((m, left + LENGTH), np.int16)
    table[:] = -1 - np.arange(m, dtype=np.int16)[:, None]
    for i, text in enumerate(around):
        start = left - back[i]
        text = np.frombuffer(text, np.uint8)[:left + LENGTH - start]
        table[i, start:start + len(text)] = text
    found = []
    for i in np.flatnonzero(n == 1):
        same = table == table[i]
        same[i] = False
        to_left = np.argmin(np.c_[same[:, left - 1::-1], np.zeros((m, 1), bool)], axis=1)
        to_right = np.argmin(np.c_[same[:, left:], np.zeros((m, 1), bool)], axis=1)
        hits = np.flatnonzero((to_right >= GRAM) & (to_left + to_right >= LENGTH))
        a = int(at[i] >> 16) + int(back[i])
        found += {(int(i), a - int(to_left[k]), a + int(to_right[k]) - LENGTH) for k in hits}
    return found


def window_names(around: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The names of all windows of LENGTH bytes of each text: which text, which window of it, name."""
    ends = np.cumsum([0, *map(len, around)])
    names = doubled(np.frombuffer(b"".join(around), np.uint8), 128)[128]
    count = np.diff(ends) - LENGTH + 1
    row = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = ends[row] + k
    return row, k, long_names(names, 128, start, start + LENGTH)


def count_group(at: np.ndarray, around: list[bytes], n: np.ndarray) -> list[tuple[int, int, int]]:
    """As compare_group, by counting names."""
    row, k, name = window_names(around)
    back = ((at >> 8) & 255)[row] - k
    _, kind = np.unique(np.stack([name, back.astype(np.uint64)]), axis=1, return_inverse=True)
    hit = np.flatnonzero((np.bincount(kind.ravel(), n[row])[kind.ravel()] > 1) & (n[row] == 1))
    if not len(hit):
        return []
    first = np.r_[True, (np.diff(hit) > 1) | (np.diff(row[hit]) > 0)]
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(hit)) - 1
    base = (at >> 16)[row[hit]] + k[hit]
    return list(zip(row[hit][start].tolist(), base[start].tolist(), base[end].tolist()))


def _compare_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by name to (doc, at) of repeated windows."""
    rest: pa.Table | None = None

    def groups(table: pa.Table) -> pa.RecordBatch:
        names, at, n, doc = (table.column(c).to_numpy() for c in ("name", "at", "n", "doc"))
        around = table.column("around").to_pylist()
        cuts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else np.zeros(0, int)
        docs, spans = [], []
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(names)]):
            for i, lo, hi in (compare_group if e - s <= PAIRS else count_group)(at[s:e], around[s:e], n[s:e]):
                docs.append(doc[s + i])
                spans.append(lo << 16 | (hi - lo))
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(spans, pa.int64())], ["doc", "at"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        names = table.column("name").to_numpy()
        if not len(names):
            continue
        cut = int(np.flatnonzero(names != names[-1])[-1]) + 1 if (names != names[-1]).any() else 0
        if cut:
            yield groups(table.slice(0, cut))
        rest = table.slice(cut)
    if rest is not None:
        yield groups(rest)


def _name_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a position by itself: (name, back, window, n, doc, at)."""
    for batch in by_bytes(batches, "around", 1 << 17):
        if not batch.num_rows:
            continue
        row, k, window = window_names(batch.column("around").to_pylist())
        name, n, doc, at = (batch.column(c).to_numpy()[row] for c in ("name", "n", "doc", "at"))
        yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(((at >> 8) & 255) - k), pa.array(window.view(np.int64)), pa.array(n), pa.array(doc), pa.array(((at >> 16) + k) << 16)],
                                         ["name", "back", "window", "n", "doc", "at"])


def _remove(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "data"):
            data, ends = text_bytes(batch.column("data"))
            spans = batch.column("spans").to_pylist()
            removed, runs, digests, left = [], [], [], []
            for i, span in enumerate(spans):
                text = data[ends[i]:ends[i + 1]]
                gone = runs_n = 0
                if span:
                    lo = np.array(span) >> 16
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, lo + (np.array(span) & 255) + LENGTH, -1)
                    out = np.cumsum(edge[:-1]) > 0
                    gone, runs_n = int(out.sum()), int((out[1:] & ~out[:-1]).sum() + out[0])
                    text = text[~out]
                text = text.tobytes()
                removed.append(gone)
                runs.append(runs_n)
                digests.append(hashlib.sha256(text).hexdigest())
                left.append(text.decode("utf-8", "ignore") if keep_text else None)
            fixed = [batch.column(i) for i in range(batch.num_columns - 2)]
            more = [pa.array(np.diff(ends)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*fixed, *more, *([pa.array(left, pa.string())] if keep_text else [])],
                                             [*batch.schema.names[:-2], "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])])
    return run


def repeated_windows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, spans) of docs(doc, data): per document with repeats, the runs of repeated windows, packed as first << 16 | last - first."""
    named = scratch.keep(docs.mapInArrow(lean(_name_positions), "name long, surround long, doc long, at long"), "named")
    again = named.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name")
    named = scratch.keep(named.join(again, "name"), "again")
    scratch.drop("named")
    kinds = named.groupBy("name", "surround").agg(F.count("*").alias("n"), F.min(F.struct("doc", "at")).alias("one"))
    kinds = scratch.keep(kinds, "kinds")
    whole = named.join(kinds.filter("n > 1").select("name", "surround"), ["name", "surround"]).select("doc", "at")
    many = kinds.groupBy("name").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    edge = kinds.join(many, "name").select("name", F.least("n", F.lit(2)).alias("n"), "kinds", "one.*")
    rows = edge.groupBy("doc").agg(F.collect_list(F.struct("name", "n", "kinds", "at")).alias("rows"))
    around = rows.join(docs, "doc").select("doc", "rows", "data").mapInArrow(lean(_cut_surroundings), "name long, n long, kinds long, doc long, at long, around binary")
    around = scratch.keep(around, "around")
    small = around.filter(F.col("kinds") <= GROUP).repartition("name").sortWithinPartitions("name").mapInArrow(lean(_compare_groups), "doc long, at long")
    large = scratch.keep(around.filter(F.col("kinds") > GROUP).mapInArrow(lean(_name_windows), "name long, back long, window long, n long, doc long, at long"), "windows")
    twice = large.groupBy("name", "back", "window").agg(F.sum("n").alias("all")).filter("`all` > 1").drop("all")
    large = large.filter("n = 1").join(twice, ["name", "back", "window"]).select("doc", "at")
    spans = whole.union(small).union(large).groupBy("doc").agg(F.collect_set("at").alias("spans"))
    spans = scratch.keep(spans, "spans")
    scratch.drop_others("spans")
    return spans


def remove_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans, kept_sha256 and (with keep_text) kept, under names no column of docs has, to its rows.

    A null text is empty; a text shorter than LENGTH loses nothing. Rows that are equal in id and text repeat each other. `kept`
    is the remaining text; a character cut in the middle goes as a whole from it, while the digest is of the remaining bytes.
    A document is known by a 64-bit hash of id and text.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    key = F.xxhash64(F.col(doc_id), F.col(text))
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    spans = repeated_windows(docs.select(key.alias("doc"), data.alias("data")), scratch)
    names = fresh(docs, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")[:4 + keep_text]
    row, doc = fresh(docs, "whole_row", "row_key")
    others = [c for c in docs.columns if c != text] if keep_text else [doc_id]
    rows = docs.select(F.struct(*others).alias(row), key.alias(doc), data.alias("data")).join(spans.withColumnRenamed("doc", doc), doc, "left").select(row, "data", "spans")
    kinds = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text
    out = rows.mapInArrow(lean(_remove(keep_text)), f"`{row}` {rows.schema[row].dataType.simpleString()}, {kinds}")
    given = [(F.col("kept") if keep_text and c == text else F.col(f"{row}.`{c}`")).alias(c) for c in docs.columns if keep_text or c == doc_id]
    return out.select(*given, *[F.col(k).alias(n) for k, n in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), names)])


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their repeated passages cut out of the text, all other columns as they came. A null text stays null."""
    out = remove_repeats(docs)
    return out.select(*docs.columns)


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False)
