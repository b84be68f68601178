"""Quality of documents by Bradley-Terry pairwise ranking.

A document is described by measures of its whole text: kinds of characters, shapes and repetition of words, lines and sentences. Every labelled
document of quality 1 is preferred to some of quality 0, drawn by a fixed seed; the model is the linear score whose differences fit these
preferences best under logistic loss. The score at the quantile that the labels' share of quality 0 marks is the threshold.

The model is fitted on all labelled documents outside the held-out fold: these are dealt into blocks by a hash of their id, rivals are
drawn in a block, and every Newton step adds up slopes and curvatures of all blocks. Knots, threshold and scale come from exact ranks over
all of them. Every document is measured once and scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from measurekit.llm.shared import Scratch, by_bytes, fresh

BLOCK = 8192                        # labelled documents of a block, about
BLOCK_SEED = 29
RARE = 32                           # documents of the rarer label in a block, about; where there are fewer, they are in several blocks
RIVALS = 4                          # preference pairs a document is drawn into
KNOTS = (0.1, 0.5, 0.9)             # quantiles of a measure at which its effect may bend
PENALTY = 1e-3                      # ridge of the logistic loss
STEPS = 25                          # Newton steps, at most
ACCEPT = 0.7                        # the score of the threshold
FOLDS, HELD_OUT = 4, 2

MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SENTENCE = re.compile(r"[.!?。]+")
MEASURES = (
    "log_chars", "log_words", "letters", "capitals", "digits", "spaces", "marks", "other_signs", "word_length", "word_length_spread",
    "marked_words", "capital_words", "wordless", "distinct_words", "top_word", "top_three_words", "word_entropy", "same_as_before", "distinct_pairs", "top_pair",
    "distinct_triples", "repeated_lines", "distinct_lines", "log_line_words", "ended_lines", "repeated_sentences", "distinct_sentences", "log_sentence_words",
    *(f"mark_{ord(c)}" for c in MARKS),
)


def _repetition(items: list) -> tuple[float, float]:
    """(share of distinct items, share of items that are a copy of an earlier one by their length)."""
    if not items:
        return 1.0, 0.0
    counts = Counter(items)
    size = sum(len(k) * n for k, n in counts.items())
    return len(counts) / len(items), (size - sum(map(len, counts))) / max(size, 1)


def measure(text: str | None) -> list[float]:
    """MEASURES of a whole text; a null text is an empty one."""
    text = text or ""
    n = max(len(text), 1)
    words = text.split()
    m = max(len(words), 1)
    letters = sum(map(len, _LETTERS.findall(text)))
    capitals = len(text) - len(_CAPITAL.sub("", text))
    marks = [text.count(c) for c in MARKS]
    digits, spaces = len(_DIGIT.findall(text)), len(_SPACE.findall(text))
    counts = Counter(words)
    common = [c for _, c in counts.most_common(3)] or [0]
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    shares = np.fromiter(counts.values(), np.float64, len(counts)) / m
    entropy = float(-(shares * np.log(shares)).sum()) / np.log(m) if len(words) > 1 else 1.0
    pairs = Counter(zip(words, words[1:]))
    triples = len(set(zip(words, words[1:], words[2:])))
    plain = sum(c for w, c in counts.items() if w.rstrip(".,;:!?").isalpha())
    shouted = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    wordless = sum(c for w, c in counts.items() if not _LETTERS.search(w))
    lines = [s for s in text.split("\n") if s.strip()]
    sentences = [s.strip() for s in SENTENCE.split(text) if s.strip()]
    distinct_lines, repeated_lines = _repetition(lines)
    distinct_sentences, repeated_sentences = _repetition(sentences)
    return [
        np.log1p(len(text)), np.log1p(len(words)), letters / n, capitals / max(letters, 1), digits / n, spaces / n, sum(marks) / n,
        max(len(text) - letters - digits - spaces - sum(marks), 0) / n, float(lengths.mean()), float(lengths.std()),
        1 - plain / m, shouted / m, wordless / m, len(counts) / m, common[0] / m, sum(common) / m, entropy,
        sum(a == b for a, b in zip(words, words[1:])) / m, len(pairs) / max(len(words) - 1, 1), max(pairs.values(), default=0) / m,
        triples / max(len(words) - 2, 1), repeated_lines, distinct_lines, np.log1p(len(words) / max(len(lines), 1)),
        sum(s.rstrip()[-1] in ".!?:\"'。" for s in lines) / max(len(lines), 1), repeated_sentences, distinct_sentences, np.log1p(len(words) / max(len(sentences), 1)),
        *(c / m for c in marks),
    ]


_LETTERS, _CAPITAL, _DIGIT, _SPACE = re.compile(r"[^\W\d_]+"), re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile(r"\d"), re.compile(r"\s")


@dataclass
class Ranker:
    """score = 1 / (1 + exp(-(utility - threshold) / scale - logit(ACCEPT))): ACCEPT at the threshold."""

    knots: np.ndarray               # measures x knots
    spread: np.ndarray              # of each measure
    weights: np.ndarray
    threshold: float
    scale: float

    def basis(self, x: np.ndarray) -> np.ndarray:
        """Each measure from its median, and how far it is above each knot: a line that may bend there."""
        over = np.maximum(x[:, :, None] - self.knots[None], 0) / self.spread[None, :, None]
        return np.concatenate([(x - self.knots[:, 1]) / self.spread, over.reshape(len(x), -1)], 1).clip(-8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):                           # nothing was preferred to anything
            return np.full(len(x), 0.5)
        # summed row by row, so that a text's score does not depend on the batch it is in
        z = ((self.basis(x) * self.weights).sum(1) - self.threshold) / self.scale + np.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-z.clip(-500, 500)))


def preferences(label: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(winners, losers): each document in RIVALS pairs of its own, with documents of the other label; both labels must be there."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    rng = np.random.default_rng(seed)
    winners = np.concatenate([np.repeat(good, RIVALS), rng.choice(good, len(bad) * RIVALS)])
    return winners, np.concatenate([rng.choice(bad, len(good) * RIVALS), np.repeat(bad, RIVALS)])


def slope_and_curve(rows: np.ndarray, winners: np.ndarray, losers: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of the logistic loss of differences, summed over the pairs."""
    slope, curve = np.zeros(len(w)), np.zeros((len(w), len(w)))
    for k in range(0, len(winners), 4096):
        d = rows[winners[k:k + 4096]] - rows[losers[k:k + 4096]]
        p = 1 / (1 + np.exp((d @ w).clip(-500, 500)))       # how likely the preference is missed
        slope -= d.T @ p
        curve += (d * (p * (1 - p))[:, None]).T @ d
    return slope, curve


def newton(w: np.ndarray, slope: np.ndarray, curve: np.ndarray, pairs: int) -> tuple[np.ndarray, float]:
    """The weights after a Newton step on the mean loss with its ridge, and the length of the step."""
    step = np.linalg.solve(curve / pairs + PENALTY * np.eye(len(w)), slope / pairs + PENALTY * w)
    return w - step, float(np.abs(step).max())


def fit(x: np.ndarray, label: np.ndarray, seed: int = 11) -> Ranker:
    """The ranker of measures x (rows in any fixed order) with labels 0 and 1. Without both labels it says 0.5 of everything."""
    x = np.asarray(x, np.float64).reshape(len(label), len(MEASURES))
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros((len(MEASURES), len(KNOTS))), np.ones(len(MEASURES)), np.zeros(0), 0.0, 1.0)
    model = Ranker(np.quantile(x, KNOTS, axis=0).T, np.maximum(x.std(0), 1e-6), np.zeros(0), 0.0, 1.0)
    rows = model.basis(x)
    winners, losers = preferences(label, seed)
    w = np.zeros(rows.shape[1])
    for _ in range(STEPS):
        w, step = newton(w, *slope_and_curve(rows, winners, losers, w), len(winners))
        if step < 1e-6:
            break
    utility = np.sort(rows @ w)
    # the quantile of the share of label 0: half way between the two scores it falls between
    k = min(max(len(bad), 1), len(utility) - 1)
    model.weights, model.threshold = w, float(utility[k - 1] + utility[k]) / 2
    gap = np.median(rows[good] @ w) - np.median(rows[bad] @ w)
    model.scale = max(float(gap) / 8, 1e-6)
    return model


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def order_statistics(rows: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray], wanted: list[tuple[int, int]]) -> list[float]:
    """The exact values at the wanted (column, rank) among all rows; ranks count from 0 and NaN is left out.

    `values` gives the columns of a batch. A rank is narrowed down by 16 bits of the sortable form of its value at a time.
    """
    prefix, rank = [0] * len(wanted), [k for _, k in wanted]
    for shift in (48, 32, 16, 0):
        targets = sorted(set(zip([c for c, _ in wanted], prefix)))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = values(batch) + 0.0                     # -0.0 is 0.0
                bits = x.view(np.uint64)
                bits = np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))
                at, digit, n = [], [], []
                for t, (column, head) in enumerate(targets):
                    v = bits[~np.isnan(x[:, column]), column] >> np.uint64(shift)
                    d, times = np.unique(v[v >> np.uint64(16) == np.uint64(head)] & np.uint64(0xFFFF), return_counts=True)
                    at.append(np.full(len(d), t))
                    digit.append(d)
                    n.append(times)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p).astype(np.int64)) for p in (at, digit, n)], ["target", "digit", "n"])

        counts = rows.mapInArrow(count, "target long, digit long, n long").groupBy("target", "digit").agg(F.sum("n").alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("target").orderBy("digit")))
        at = {t: k for k, t in enumerate(targets)}
        ranks = rows.sparkSession.createDataFrame([(k, at[c, prefix[k]], rank[k]) for k, (c, _) in enumerate(wanted)], "k long, target long, rank long")
        hits = upto.join(F.broadcast(ranks), "target").filter("rank >= upto - n AND rank < upto").selectExpr("k", "digit", "upto - n AS before").collect()
        for hit in hits:
            prefix[hit["k"]] = prefix[hit["k"]] << 16 | hit["digit"]
            rank[hit["k"]] -= hit["before"]
    bits = np.array(prefix, np.uint64)
    return np.where(bits >> np.uint64(63) == 1, bits & np.uint64((1 << 63) - 1), ~bits).view(np.float64).tolist()


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.array(table.column("measures").to_pylist(), np.float64).reshape(table.num_rows, len(MEASURES))


def _moments(table: pa.Table) -> pa.Table:
    """Of a block: how many documents it counts, and sums of their measures and of the squares."""
    x = _matrix(table.filter(table.column("first")))
    return pa.table({"block": table.column("block")[:1], "n": pa.array([len(x)], pa.int64()), "total": [x.sum(0).tolist()], "square": [(x * x).sum(0).tolist()]})


def _step(model: Ranker, w: np.ndarray, seed: int) -> Callable[[pa.Table], pa.Table]:
    """Of a block: pairs, slope and curvature, a row a weight."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        label, block = np.array(table.column("label")), table.column("block")[0].as_py()
        if label.min() == label.max():
            return pa.table({k: pa.array([], t) for k, t in (("at", pa.int64()), ("block", pa.int64()), ("sums", pa.list_(pa.float64())))})
        winners, losers = preferences(label, seed + block)
        slope, curve = slope_and_curve(model.basis(_matrix(table)), winners, losers, w)
        sums = np.c_[np.full(len(w), len(winners)), slope, curve]
        return pa.table({"at": np.arange(len(w)), "block": np.full(len(w), block), "sums": pa.array(list(sums), pa.list_(pa.float64()))})

    return run


def _added(table: pa.Table) -> pa.Table:
    """The sums of all blocks, in the order of the blocks, so that runs agree."""
    sums = np.array(table.sort_by("block").column("sums").to_pylist()).sum(0)
    return pa.table({"at": table.column("at")[:1], "sums": pa.array([sums], pa.list_(pa.float64()))})


def fit_blocks(known: DataFrame, good: int, bad: int, start: Ranker, seed: int = 11) -> Ranker:
    """The ranker of all of known(id, label, measures, block, first), from the weights of `start` on; `first` marks a document's own block."""
    def at(q: float, n: int) -> tuple[int, int, float]:
        k = int(q * (n - 1))
        return k, min(k + 1, n - 1), q * (n - 1) - k

    n, own = good + bad, known.filter("first").select("label", "measures")
    cuts = [at(q, n) for q in KNOTS]
    found = np.array(order_statistics(own, _matrix, [(m, k) for m in range(len(MEASURES)) for lo, hi, _ in cuts for k in (lo, hi)])).reshape(-1, len(KNOTS), 2)
    knots = found[:, :, 0] + np.array([f for *_, f in cuts]) * (found[:, :, 1] - found[:, :, 0])
    sums = sorted(known.groupBy("block").applyInArrow(_moments, "block long, n long, total array<double>, square array<double>").collect(), key=lambda r: r["block"])
    mean, square = (np.sum([r[c] for r in sums], 0) / n for c in ("total", "square"))
    model = Ranker(knots, np.maximum(np.sqrt(np.maximum(square - mean * mean, 0)), 1e-6), np.zeros(0), 0.0, 1.0)
    w = start.weights if len(start.weights) else np.zeros(len(MEASURES) * (1 + len(KNOTS)))
    for _ in range(STEPS):
        parts = known.groupBy("block").applyInArrow(_step(model, w, seed), "at long, block long, sums array<double>")
        rows = sorted(parts.groupBy("at").applyInArrow(_added, "at long, sums array<double>").collect(), key=lambda r: r["at"])
        sums = np.array([r["sums"] for r in rows])
        w, step = newton(w, sums[:, 1], sums[:, 2:], int(sums[0, 0]))
        if step < 1e-6:
            break
    model.weights = w

    def utilities(batch: pa.RecordBatch) -> np.ndarray:
        u, label = (model.basis(_matrix(batch)) * w).sum(1), np.array(batch.column("label"))
        return np.c_[u, np.where(label == 1, u, np.nan), np.where(label == 0, u, np.nan)]

    k = min(max(bad, 1), n - 1)
    ranks = [(0, k - 1), (0, k), (1, (good - 1) // 2), (1, good // 2), (2, (bad - 1) // 2), (2, bad // 2)]
    below, above, g1, g2, b1, b2 = order_statistics(own, utilities, ranks)
    model.threshold, model.scale = (below + above) / 2, max((g1 + g2 - b1 - b2) / 2 / 8, 1e-6)
    return model


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", measures: str | None = None, block: int = BLOCK) -> Ranker:
    """The ranker of labels 0 and 1 of all documents outside the held-out fold.

    labels names documents by the same id; ids that are null, labels that are null or neither, and ids with both labels say nothing. Of rows that share an id
    one counts, chosen by its measures. `measures` names a column that already holds the measures of the texts.
    """
    scratch = Scratch(docs.sparkSession, "quality-fit")
    judged = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    judged = judged.filter(_fold(F.col("id")) != HELD_OUT).groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{measures or text}`").alias("measures" if measures else "text")).join(judged, "id")
    if not measures:
        rows = rows.mapInArrow(_measured("text", ["id", "label"]), "id long, label int, measures array<double>")
    known = scratch.keep(rows.groupBy("id", "label").agg(F.min("measures").alias("measures")), "known")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    blocks = -(-(good + bad) // block) if good and bad else 1
    home = F.xxhash64("id", F.lit(BLOCK_SEED))
    copies = min(blocks, -(-RARE * blocks // max(min(good, bad), 1)))
    rare = F.col("label") == (1 if good < bad else 0)
    known = known.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(rare, F.lit(copies - 1)).otherwise(F.lit(0)))))
    known = known.withColumn("block", F.pmod(F.pmod(home, F.lit(blocks)) + F.col("copy"), F.lit(blocks)).cast("long")).withColumn("first", F.col("copy") == 0)
    # one block is all there is; of several, one is where the steps begin
    one = known.filter("block = 0").orderBy("id").select("label", "measures").collect() if good and bad else []
    start = fit(np.array([r["measures"] for r in one]), np.array([r["label"] for r in one]))
    if blocks > 1:
        start = fit_blocks(scratch.keep(known.drop("copy"), "blocks"), good, bad, start)
    scratch.drop_others()
    return start


def _measured(text: str, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text):
            rows = [measure(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(rows, pa.list_(pa.float64()))], [*kept, "measures"])

    return run


def measure_documents(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of docs with quality_measures, under a name no column has, in place of the text; no shuffle."""
    name = fresh(docs, "quality_measures")[0]
    kept = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _measured(text, [f.name for f in kept])(batches):
            yield batch.rename_columns([*(f.name for f in kept), name])

    return docs.mapInArrow(run, StructType([*kept, StructField(name, ArrayType(DoubleType()))]))


def rank_documents(docs: DataFrame, ranker: Ranker, *, text: str = "text", measures: str | None = None) -> DataFrame:
    """Adds quality_score (0 to 1) to the rows of docs, under a name no column has; no shuffle.

    A null text is scored as an empty one, and both like any other by the measures of no words at all. Equal texts have equal scores; a text of any length is measured whole.
    An empty table stays empty. `measures` names a column that already holds the measures of the texts.
    """
    name = fresh(docs, "quality_score")[0]
    model = docs.sparkSession.sparkContext.broadcast(ranker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if measures else by_bytes(batches, text):
            x = batch.column(measures).to_pylist() if measures else [measure(t) for t in batch.column(text).to_pylist()]
            score = model.value.score(np.array(x, np.float64).reshape(-1, len(MEASURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def op12_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    measured = Scratch(spark, "quality").keep(measure_documents(docs), "measured")
    ranker = learn(measured, spark.read.parquet(f"{sf_dir}/labels.parquet"), measures="quality_measures")
    out = rank_documents(measured, ranker, measures="quality_measures")
    held_out = F.coalesce(_fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= ACCEPT).cast("int").alias("predicted"))
