"""Language ID with interpolated Kneser-Ney models over characters.

Training counts the 4-grams of all labelled texts outside the held-out fold: each task sums its own texts, Spark sums the tasks. The
lower orders count in how many ways a gram is continued to the left, and every probability is worked out by joins of these
tables. A model is then folded into 2^22 hash slots an order, so that what goes to the executors has a bound whatever the
alphabet: sorted arrays of occupied slots with one row of log probabilities for all languages. A text gets the language
with the lowest cross-entropy per character.

Calibration runs on one fold of the labelled texts that the counts leave out: the temperature that makes the scores
probabilities, and each language's usual cross-entropy, beyond which a text is rejected as no text of any language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measurekit.llm.shared import Scratch, by_bytes, fresh, lean, mix64

ORDER = 4
SLOT_BITS = 22
SPACE = 32
# A text is rejected if its cross-entropy lies so many standard deviations above the mean of its language's labelled texts, and
# beyond what chance allows a text of n characters: REJECT_SHORT / sqrt(n) nats.
REJECT_SD = 8.0
REJECT_SHORT = 6.0
TEMPERATURES = [2.0 ** (k / 2) for k in range(-4, 17)]
FOLDS = 5
# Characters of one text looked at at a time; longer texts are read whole, piece by piece.
PIECE = 1 << 19

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point the 16-bit code of its character if it is a letter, else the code of a space."""
    if not _LETTER:
        table = np.full(0x110000, SPACE, np.uint16)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] == "L":
                table[c] = c if c < 0x10000 else 0xE000 + c % 6400
        _LETTER.append(table)
    return _LETTER[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 4-grams that end at each character, packed into 64 bits, and how many each text has; and whether a text has a letter.

    Lower case; characters that are no letters count as a space, runs of them as one; three spaces stand before each text.
    """
    lowered = [t.lower() if t else "" for t in texts]
    lens = np.array([len(t) for t in lowered], np.int64)
    code = letters()[np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)]
    doc = np.repeat(np.arange(len(lens)), lens)
    blank = code == SPACE
    first = np.zeros(len(code), bool)
    starts = np.cumsum(lens) - lens
    first[starts[lens > 0]] = True
    before = np.empty(len(code), bool)
    before[:1] = True
    before[1:] = blank[:-1]
    keep = ~(blank & (before | first))
    code, doc, blank = code[keep], doc[keep], blank[keep]
    n = np.bincount(doc, minlength=len(lens))
    has_letter = np.bincount(doc[~blank], minlength=len(lens)) > 0
    padded = np.full(len(code) + 3 * len(lens), SPACE, np.uint64)
    at = np.arange(len(code)) + 3 * (doc + 1)
    padded[at] = code
    gram = padded.copy()
    for k in (1, 2, 3):
        gram[3:] |= padded[3 - k:-k] << np.uint64(16 * k)
    return gram[at], n, has_letter


def pieces(text: str | None) -> list[str | None]:
    return [text] if not text or len(text) <= PIECE else [text[s:s + PIECE] for s in range(0, len(text), PIECE)]


def slots(gram: np.ndarray) -> np.ndarray:
    return (mix64(gram) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of docs(text, lang): one row for each task and gram, to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        rows = 0

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k for k, _ in held[lang]]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([n for _, n in held[lang]]), len(keys)).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in held:
                keys, n = merged(lang)
                for s in range(0, len(keys), 100_000):
                    part = slice(s, s + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys[part])), pa.array(keys[part].view(np.int64)), pa.array(n[part])], ["lang", "gram", "n"])
            held.clear()

        for batch in by_bytes(batches, "text", 1 << 19):
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            rounds = [(texts, langs)] if len(texts) > 1 else [([p], langs) for p in pieces(texts[0])]
            for part, of_part in rounds:
                gram, n, _ = grams(part)
                names, which = np.unique(np.array(of_part, object).astype(str), return_inverse=True)
                of = np.repeat(which, n)
                for k, lang in enumerate(names.tolist()):
                    keys, count = np.unique(gram[of == k], return_counts=True)
                    held.setdefault(lang, []).append((keys, count))
                    rows += len(keys)
            if rows > 2_000_000:
                for lang in held:
                    held[lang] = [merged(lang)]
                rows = sum(len(x[0][0]) for x in held.values())
                if rows > 1_000_000:
                    yield from flush()
                    rows = 0
        yield from flush()

    return docs.select("text", "lang").mapInArrow(lean(run), "lang string, gram long, n long")


class Model:
    """Sorted hash arrays of all orders: for each order the occupied slots, and a row of log probabilities by language; for each
    context the log weights of the shorter one."""

    def __init__(self, langs: list[str], probs: dict[int, tuple[np.ndarray, np.ndarray]], weights: dict[int, tuple[np.ndarray, np.ndarray]], floor: float):
        self.langs, self.probs, self.weights, self.floor = langs, probs, weights, floor
        self.temperature, self.usual = 1.0, np.full((len(langs), 2), np.inf)
        self.jump: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"jump": None}

    def _find(self, kind: str, order: int, gram: np.ndarray) -> np.ndarray:
        """Rows of the slots of grams, -1 where a slot is empty. The longest grams, which every character asks for, are found by a
        table over all slots, made on first use; all others, which few ask for, by search in the sorted slots."""
        held, slot = (self.probs if kind == "p" else self.weights)[order][0], slots(gram)
        if kind == "p" and order == ORDER:
            if self.jump is None:
                self.jump = np.full(1 << SLOT_BITS, -1, np.int32)
                self.jump[held] = np.arange(len(held))
            return self.jump[slot]
        if not len(held):
            return np.full(len(slot), -1)
        row = np.minimum(np.searchsorted(held, slot), len(held) - 1)
        return np.where(held[row] == slot, row, -1)

    def log_probs(self, gram: np.ndarray, order: int = ORDER) -> np.ndarray:
        """A row of log probabilities by language for each gram of the order."""
        if order == 0:
            return np.full((len(gram), len(self.langs)), self.floor, np.float32)
        row = self._find("p", order, gram)
        out = self.probs[order][1][row]
        gone = np.flatnonzero(row < 0)
        if len(gone):
            lost = gram[gone]
            out[gone] = self.log_probs(lost & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
            if order > 1:
                ctx = self._find("w", order, lost >> np.uint64(16))
                seen = ctx >= 0
                out[gone[seen]] += self.weights[order][1][ctx[seen]]
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text by language, whether the text has a letter, and its number of characters."""
        if len(texts) == 1 and len(parts := pieces(texts[0])) > 1:
            each = [self.entropies([p]) for p in parts]
            n = np.concatenate([x[2] for x in each])
            return (np.concatenate([x[0] for x in each]) * n[:, None]).sum(0, keepdims=True) / max(n.sum(), 1), np.array([any(x[1][0] for x in each)]), n.sum(keepdims=True)
        gram, n, has_letter = grams(texts)
        out = np.zeros((len(texts), len(self.langs)))
        some = np.flatnonzero(n)
        if len(gram) and self.langs:
            starts = (np.cumsum(n) - n)[some]
            out[some] = -np.add.reduceat(self.log_probs(gram), starts, axis=0, dtype=np.float64) / n[some, None]
        return out, has_letter, n

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[bool]]:
        """Language, score and whether the text is rejected. `und` with score 0 if it has no letter, or nothing was learned."""
        entropy, known, n = self.entropies(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), [True] * len(texts)
        best = entropy.argmin(1)
        lowest = entropy[np.arange(len(best)), best]
        score = 1 / np.exp(-(entropy - lowest[:, None]) * self.temperature).sum(1)
        far = lowest > self.usual[best, 0] + REJECT_SD * self.usual[best, 1] + REJECT_SHORT / np.sqrt(np.maximum(n, 1))
        return [self.langs[b] if k else "und" for b, k in zip(best, known)], np.where(known, score, 0.0), (far | ~known).tolist()


def _folded(df: DataFrame, by: str, value: str) -> DataFrame:
    """df(order, lang, gram, value) by hash slot of the gram: (order, slot, lang, gram, value), at most 2^22 slots an order."""
    slot = F.pandas_udf(lambda g: pd.Series(slots(g.to_numpy(np.int64).view(np.uint64))), "long")
    return df.withColumn("slot", slot(by)).groupBy("order", "slot", "lang").agg(F.min(by).alias("gram"), F.max(value).alias(value))


def train(labelled: DataFrame) -> Model:
    """A model of labelled(text, lang); lang is not null. Calibrate it before use."""
    scratch = Scratch(labelled.sparkSession, "langid")
    table = scratch.keep(count_grams(labelled).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams-4")
    orders = {ORDER: table}
    for k in range(ORDER - 1, 0, -1):
        shorter = orders[k + 1].withColumn("gram", F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1)))
        orders[k] = shorter.groupBy("lang", "gram").agg(F.count("*").alias("n"))
    below, probs, weights = None, [], []
    for k in range(1, ORDER + 1):
        t = orders[k].withColumn("ctx", F.shiftrightunsigned("gram", 16))
        ones = t.groupBy("lang").agg(F.sum((F.col("n") == 1).cast("double")).alias("n1"), F.sum((F.col("n") == 2).cast("double")).alias("n2"))
        discount = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
        discount = F.least(F.lit(0.95), F.greatest(F.lit(0.05), discount))
        ctx = (t.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
               .join(ones.select("lang", discount.alias("d")), "lang").withColumn("w", F.col("d") * F.col("kinds") / F.col("total")))
        full = t.join(ctx, ["lang", "ctx"]).withColumn("p", (F.col("n") - F.col("d")) / F.col("total"))
        if below is None:
            full = full.withColumn("p", F.col("p") + F.col("w") / 65536)
        else:
            full = full.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1)))
            full = full.join(below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q")), ["lang", "suffix"]).withColumn("p", F.col("p") + F.col("w") * F.col("q"))
        below = scratch.keep(full.select("lang", "gram", "p"), f"p{k}")
        probs.append(below.select(F.lit(k).alias("order"), "lang", "gram", "p"))
        weights.append(ctx.select(F.lit(k).alias("order"), "lang", F.col("ctx").alias("gram"), "w"))
    p, w = (_folded(reduce(DataFrame.unionByName, tables), "gram", value).toArrow() for tables, value in ((probs, "p"), (weights, "w")))
    scratch.drop_others()
    return _assemble(p, w)


def _assemble(p: pa.Table, w: pa.Table) -> Model:
    """Arrays from the folded tables. A language that has not seen a gram gets its backed-off probability."""
    langs = sorted(set(p.column("lang").to_pylist()))
    floor = float(np.log(1 / 65536 / 65536))
    model = Model(langs, {}, {}, floor)

    def columns(t: pa.Table, value: str) -> tuple[np.ndarray, ...]:
        lang = np.searchsorted(langs, t.column("lang").to_numpy().astype(str))
        return t.column("order").to_numpy(), t.column("slot").to_numpy(), lang, t.column("gram").to_numpy().view(np.uint64), np.log(t.column(value).to_numpy()).astype(np.float32)

    if not langs:
        empty = np.zeros(0, np.int64), np.zeros((0, 0), np.float32)
        return Model([], {k: empty for k in range(1, ORDER + 1)}, {k: empty for k in range(1, ORDER + 1)}, floor)
    order, slot, lang, gram, value = columns(w, "w")
    for k in range(1, ORDER + 1):
        on = order == k
        held, row = np.unique(slot[on], return_inverse=True)
        rows = np.zeros((len(held), len(langs)), np.float32)            # a context not seen passes on all weight
        rows[row, lang[on]] = value[on]
        model.weights[k] = held, rows
    order, slot, lang, gram, value = columns(p, "p")
    for k in range(1, ORDER + 1):
        on = order == k
        held, where, row = np.unique(slot[on], return_index=True, return_inverse=True)
        rows = np.full((len(held), len(langs)), np.nan, np.float32)
        rows[row, lang[on]] = value[on]
        some = gram[on][where]
        short = model.log_probs(some & np.uint64((1 << 16 * (k - 1)) - 1), k - 1)
        if k > 1:
            ctx = model._find("w", k, some >> np.uint64(16))
            short[ctx >= 0] += model.weights[k][1][ctx[ctx >= 0]]
        model.probs[k] = held, np.where(np.isnan(rows), short, rows)
    return model


def calibrate(model: Model, labelled: DataFrame) -> Model:
    """Temperature and usual cross-entropies from labelled(text, lang) that were not counted. Sums by task, then over tasks."""
    if not model.langs:
        return model
    shared, langs = labelled.sparkSession.sparkContext.broadcast(model), model.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sums = shared.value, {}
        for batch in by_bytes(batches, "text"):
            entropy, known, _ = model.entropies(batch.column("text").to_pylist())
            names = batch.column("lang").to_pylist()
            rows = [i for i, (k, name) in enumerate(zip(known, names)) if k and name in langs]
            for i in rows:
                true = langs.index(names[i])
                gap = entropy[i] - entropy[i].min()
                for t in TEMPERATURES:
                    loss = float(np.log(np.exp(-gap * t).sum()) + gap[true] * t)
                    sums["t", t] = sums.get(("t", t), 0.0) + loss
                for j, x in enumerate((1.0, entropy[i, true], entropy[i, true] ** 2)):
                    sums[names[i], float(j)] = sums.get((names[i], float(j)), 0.0) + float(x)
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.float64()), pa.array([sums[k] for k in keys], pa.float64())], ["what", "at", "x"])

    rows = {(r.what, r["at"]): r.x for r in labelled.select("text", "lang").mapInArrow(lean(run), "what string, at double, x double").groupBy("what", "at").agg(F.sum("x").alias("x")).collect()}
    if any(k[0] == "t" for k in rows):
        model.temperature = min(TEMPERATURES, key=lambda t: (rows.get(("t", t), np.inf), t))
    for k, lang in enumerate(langs):
        if rows.get((lang, 0.0), 0) >= 2:
            n, s, q = (rows[lang, float(j)] for j in range(3))
            model.usual[k] = s / n, np.sqrt(max(q / n - (s / n) ** 2, 1e-6))
    return model


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """A calibrated model of the labelled documents outside the held-out fold: fold 1 calibrates, the other three are counted."""
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), fold.alias("fold")).filter("text IS NOT NULL AND lang IS NOT NULL")
    return calibrate(train(rows.filter("fold > 1").select("text", "lang")), rows.filter("fold = 1").select("text", "lang"))


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and rejected, under names no column of docs has, to its rows. No shuffle.

    A null text and a text without a letter: `und`, score 0, rejected. Repeated rows get equal answers. The model learns nothing
    from a table without labelled texts; then all is `und`. A null doc_id is in no fold and not learned from.
    """
    names = fresh(docs, "lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in by_bytes(batches, batch_column):
            lang, score, rejected = model.judge(batch.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*batch.schema.names, *names])

    batch_column = docs.columns[column]
    schema = docs.select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(True).alias(names[2])).schema
    return docs.mapInArrow(lean(run), schema)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is known, with their columns as they came."""
    out = identify(docs, learn(docs))
    return out.filter(~F.col(out.columns[-1])).select(*docs.columns)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), learn(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
