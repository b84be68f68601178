"""Alignment of the tokens that two tokenizers give for one text.

Both tokenizers' tokens are byte strings that end to end give the text, so the places where a token of each ends cut the text into the
smallest groups of tokens that cover the same bytes. The groups of a whole batch are found in lockstep: one state vector holds a
pointer into the A ends and one into the B ends for every lane, a step advances all pointers whose token ends first (both where the
ends are equal, which is a cut), and lanes that are done are taken out. A lane is a strip of LANE tokens of one document: where a
strip starts, the B pointer follows from the byte offset alone, so a long document is many lanes and takes no more steps than others.

Every pair of an A and a B token in one group is a link. A document's links are kept as distinct id pairs with the times they occur;
how many documents hold a pair is counted over the whole table, and each document reads the counts of its pairs: the commonest
pairs, at most COMMON of them, from a broadcast table, all others through a join by pair. Rare pairs are no hot keys.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from measurekit.llm.bpe import PRINTABLE, SPLIT, ByteBpe, read_vocabulary
from measurekit.llm.shared import Scratch, by_bytes, fresh

LANE = 256                          # A tokens of a lane
COMMON = 1 << 20                    # pairs whose counts are broadcast: 16 bytes each before the JVM's own
PIECE = 1 << 16                     # characters a tokenizer is given at once, where the text can be cut without changing its tokens
EXPANDED = 1 << 21                  # links held one by one while a batch is counted
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE_SPACE = "\u2581"


class ByteLevel:
    """A byte-level BPE file of the tokenizers library: ids of space + text, and the bytes of each id."""

    # no word of this kind reaches from another character to white space after it
    _border = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")

    def __init__(self, data: str):
        self.model = tokenizers.Tokenizer.from_str(data)
        self.model.no_truncation()
        self.model.no_padding()
        self.model.encode_special_tokens = True
        chars = {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(PRINTABLE))}
        special = {t["content"] for t in json.loads(data)["added_tokens"]}
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            self.bytes[i] = s.encode() if s in special else bytes(chars[c] for c in s)
        self.ranks = self._by_rank(json.loads(data), {self.bytes[i]: i for s, i in vocab.items() if s not in special})

    @staticmethod
    def _by_rank(model: dict, ids: dict[bytes, int]) -> tiktoken.Encoding | None:
        """The same encoder in a library that merges by rank of the merged text, four times as fast, where that is the same.

        It is if texts are split in the standard way and nothing else is done to them, ids grow along the merge list, and every token's own text
        is encoded as that token: then two tokens whose text together is a token are always a pair of the merge list.
        """
        plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        merges = model["model"]["merges"]
        if model["normalizer"] or model["pre_tokenizer"] != plain or any(model["model"].get(k) for k in ("dropout", "ignore_merges", "byte_fallback")):
            return None
        made = ByteBpe(json.dumps(model)).automaton
        vocab = model["model"]["vocab"]
        order = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        if order != sorted(order) or any(bytes((b,)) not in ids for b in range(256)) or not all(map(made._alone, made.made)) or len(made.made) + 256 != len(ids):
            return None
        return tiktoken.Encoding("by-rank", pat_str=SPLIT, mergeable_ranks=ids, special_tokens={})

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in _parts(" " + text, self._border):
            ids += self.ranks.encode_ordinary(part) if self.ranks else self.model.encode(part, add_special_tokens=False).ids
        return ids


class Pieces:
    """A sentencepiece model: ids of a text, to which it adds a space in front, and the bytes of each id."""

    _border = re.compile("(?<=[^ ])(?= [^ ])")

    def __init__(self, data: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = [self.model.IdToPiece(i) for i in range(self.model.vocab_size())]
        self.bytes = [bytes((int(s[3:5], 16),)) if self.model.IsByte(i) else s.replace(_PIECE_SPACE, " ").encode() for i, s in enumerate(names)]
        # where no piece holds a space after another character, none reaches over the border of two words
        self.words = not any(_PIECE_SPACE in s.lstrip(_PIECE_SPACE) for s in names) and self.model.encode("a", out_type=str)[0][0] == _PIECE_SPACE

    def encode(self, text: str) -> list[int]:
        if len(text) <= PIECE or not self.words:
            return self.model.encode(text, num_threads=1)
        ids: list[int] = []
        for k, part in enumerate(_parts(text, self._border)):
            ids += self.model.encode(part[1:] if k else part, num_threads=1)     # the space in front is the one that is added
        return ids


def _parts(text: str, border: re.Pattern) -> Iterator[str]:
    """The text in parts of about PIECE characters, cut at borders only."""
    start = 0
    while len(text) - start > PIECE and (m := border.search(text, start + PIECE)):
        yield text[start:m.start()]
        start = m.start()
    yield text[start:]


_LOADED: dict[str, ByteLevel | Pieces] = {}


def _load(kind: type, data: str | bytes) -> ByteLevel | Pieces:
    key = kind.__name__ + hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = kind(data)
    return _LOADED[key]


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, lane: int = LANE) -> np.ndarray:
    """For each A token the B token that ends where it ends, or -1.

    Ends are byte offsets that grow through the whole batch; first_a says where each document's A tokens start, and the number of all.
    """
    partner = np.full(len(ends_a), -1, np.int64)
    sizes = np.diff(first_a)
    lanes = -(-sizes // lane)
    a = np.repeat(first_a[:-1], lanes) + (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * lane
    stop = np.minimum(a + lane, np.repeat(first_a[1:], lanes))
    b = np.searchsorted(ends_b, np.where(a > 0, ends_a[a - 1], 0), "right")
    while len(a):
        end_a, end_b = ends_a[a], ends_b[b]
        cut = end_a == end_b
        partner[a[cut]] = b[cut]
        a = a + (end_a <= end_b)
        b = b + (end_b <= end_a)
        live = a < stop
        if not live.all():
            a, b, stop = a[live], b[live], stop[live]
    return partner


class _Links:
    """Distinct (document, A id, B id) of a batch with the times they occur."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a, self.n_b = n_a, n_b
        self.keys, self.times, self.held = [], [], 0

    def add(self, doc: np.ndarray, a: np.ndarray, b: np.ndarray, times: np.ndarray) -> None:
        self.keys.append((doc * self.n_a + a) * self.n_b + b)
        self.times.append(times)
        self.held += len(a)
        if self.held > EXPANDED:
            self._merge()

    def _merge(self) -> None:
        keys, at = np.unique(np.concatenate([np.zeros(0, np.int64), *self.keys]), return_inverse=True)
        times = np.zeros(len(keys), np.int64)
        np.add.at(times, at, np.concatenate([np.zeros(0, np.int64), *self.times]))
        self.keys, self.times, self.held = [keys], [times], 0

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        self._merge()
        rest, b = np.divmod(self.keys[0], self.n_b)
        doc, a = np.divmod(rest, self.n_a)
        return doc, a, b, self.times[0]


def _links(ids_a: np.ndarray, ids_b: np.ndarray, doc: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray,
           n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of each group [a0, a1) x [b0, b1), as distinct id pairs by document."""
    found = _Links(n_a, n_b)
    size = (a1 - a0) * (b1 - b0)
    for g in np.flatnonzero(size > EXPANDED // 16):          # long groups: distinct ids first
        ua, ca = np.unique(ids_a[a0[g]:a1[g]], return_counts=True)
        ub, cb = np.unique(ids_b[b0[g]:b1[g]], return_counts=True)
        for part in range(0, len(ua), step := max(1, EXPANDED // 16 // len(ub))):
            pa_, pc = ua[part:part + step], ca[part:part + step]
            found.add(np.full(len(pa_) * len(ub), doc[g]), np.repeat(pa_, len(ub)), np.tile(ub, len(pa_)), np.outer(pc, cb).ravel())
    short = np.flatnonzero(size <= EXPANDED // 16)
    upto = np.cumsum(size[short])
    start = 0
    while start < len(short):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + EXPANDED // 2, "right")))
        g = short[start:end]
        of = np.repeat(g, size[g])
        k = np.arange(len(of)) - np.repeat(np.cumsum(size[g]) - size[g], size[g])
        wide = b1[of] - b0[of]
        found.add(doc[of], ids_a[a0[of] + k // wide], ids_b[b0[of] + k % wide], np.ones(len(of), np.int64))
        start = end
    return found.all()


class Aligner:
    def __init__(self, a: str, b: bytes):
        self.a, self.b = _load(ByteLevel, a), _load(Pieces, b)
        self.size_a = np.array([len(s) for s in self.a.bytes], np.int64)
        self.size_b = np.array([len(s) for s in self.b.bytes], np.int64)
        most = max(len(self.size_a), len(self.size_b))
        self.shown = [f"{i}{mark}" for i in range(most) for mark in ",|;"]

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """The ids of both, or none where a side's bytes are not a space and the text."""
        if not text:
            return [], []
        whole = b" " + text.encode()
        a = self.a.encode(text)
        if b"".join(map(self.a.bytes.__getitem__, a)) != whole:
            return [], []
        b = self.b.encode(text)
        return (a, b) if b"".join(map(self.b.bytes.__getitem__, b)) == whole else ([], [])

    def batch(self, texts: list[str | None]) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links, groups, link_a, link_b, link_times of each text."""
        tokens = [self.tokens(t) for t in texts]
        n_a, n_b = (np.array([len(t[k]) for t in tokens], np.int64) for k in (0, 1))
        ids_a, ids_b = (np.array([i for t in tokens for i in t[k]], np.int64) for k in (0, 1))
        first_a, first_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        partner = lockstep(np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b]), first_a)
        a1 = np.flatnonzero(partner >= 0) + 1
        b1 = partner[a1 - 1] + 1
        a0, b0 = (np.concatenate([[0], x[:-1]])[:len(x)] for x in (a1, b1))
        doc = np.repeat(np.arange(len(texts)), n_a)[a0]
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        links = np.concatenate([[0], np.cumsum((a1 - a0) * (b1 - b0))])
        of, link_a, link_b, times = _links(ids_a, ids_b, doc, a0, a1, b0, b1, len(self.size_a), len(self.size_b))
        at = pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(v, t)) for v, t in ((link_a, pa.int32()), (link_b, pa.int32()), (times, pa.int64()))]
        counts = [n_a, n_b, np.diff(bounds), np.diff(links[bounds])]
        return [*(pa.array(c, pa.int64()) for c in counts), self._groups(ids_a, ids_b, a0, a1, b0, b1, first_a + first_b), *lists]

    def _groups(self, ids_a: np.ndarray, ids_b: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, first: np.ndarray) -> pa.Array:
        """`a1,a2|b1;a3|b2,b3`: each token is written at its place among all tokens of the batch, group by group."""
        mark_a, mark_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        mark_a[a1 - 1], mark_b[b1 - 1] = 1, 2
        code = np.empty(len(ids_a) + len(ids_b), np.int64)
        code[np.arange(len(ids_a)) + np.repeat(b0, a1 - a0)] = ids_a * 3 + mark_a
        code[np.arange(len(ids_b)) + np.repeat(a1, b1 - b0)] = ids_b * 3 + mark_b
        shown = list(map(self.shown.__getitem__, code.tolist()))
        return pa.array(["".join(shown[s:e])[:-1] for s, e in zip(first[:-1], first[1:])], pa.string())


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups", "link_a", "link_b", "link_times")
_TYPES = (*[LongType()] * 4, StringType(), ArrayType(IntegerType()), ArrayType(IntegerType()), ArrayType(LongType()))


def align_documents(docs: DataFrame, a: str, b: bytes, *, text: str = "text") -> DataFrame:
    """Adds COLUMNS to the rows of docs, under names no column has; no shuffle.

    a is the text of a byte-level BPE file of the tokenizers library, b the bytes of a sentencepiece model with a space in front and byte
    fallback. groups is `a1,a2|b1;a3|b2,b3` (ids in order); link_a, link_b and link_times are the distinct linked id pairs.

    A null or empty text, and one whose bytes a tokenizer does not give back (say, because it changes characters), has no tokens: zeros, an
    empty groups text and empty lists. Equal texts give equal values in each row. A text of any length is aligned whole; it is
    handed to the tokenizers in parts where they can be cut between words. An empty table stays empty.
    """
    names = fresh(docs, *COLUMNS)
    spark = docs.sparkSession
    models = spark.sparkContext.broadcast((a, b))
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*models.value)
        for batch in by_bytes(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, *aligner.batch(batch.column(column).to_pylist())], [*batch.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *[StructField(n, t) for n, t in zip(names, _TYPES)]]))


def link_counts(links: DataFrame) -> DataFrame:
    """(pair, docs, best) of links (row, pair, times): how many rows hold a pair, and whether no pair of its A id is held by more.

    pair is the A id times 2^32 plus the B id. Counts are summed in part before the shuffle; an A id has at most the B vocabulary's pairs.
    """
    counts = links.groupBy("pair").agg(F.count("*").alias("docs"))
    best = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.select("pair", "docs", (F.col("docs") == best).alias("best"))


def link_scores(aligned: DataFrame, row: str, scratch: Scratch, common: int = COMMON) -> DataFrame:
    """(row, n_best, count_sum) of the rows with links; aligned holds a row number and link_a, link_b, link_times.

    A row is a document of its own, copies included. At most `common` pairs are broadcast, the commonest by powers of 2^(1/4) of their count.
    """
    zipped = F.explode(F.arrays_zip("link_a", "link_b", "link_times")).alias("l")
    pair = F.shiftleft(F.col("l.link_a").cast("long"), 32).bitwiseOR(F.col("l.link_b").cast("long"))
    links = aligned.select(F.col(row).alias("row"), zipped).select("row", pair.alias("pair"), F.col("l.link_times").alias("times"))
    level = F.floor(F.log2("docs") * 4).cast("int")
    pairs = scratch.keep(link_counts(links).withColumn("level", level), "pairs")
    # at most some 250 rows: how many pairs are this common
    levels = sorted(pairs.groupBy("level").count().collect(), reverse=True)
    lowest, held = None, 0
    for k, n in levels:
        held += n
        if held > common:
            break
        lowest = k
    found = []
    if lowest is not None:
        near = pairs.filter(F.col("level") >= lowest).drop("level")
        found.append(links.join(F.broadcast(near), "pair", "left" if held > common else "inner"))
    if held > common:
        rest = found[0].filter("docs IS NULL").select("pair", "row", "times") if found else links
        far = pairs if lowest is None else pairs.filter(F.col("level") < lowest)
        found = [f.filter("docs IS NOT NULL") for f in found] + [rest.join(far.drop("level").hint("shuffle_merge"), "pair")]
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("docs") * F.col("times")).alias("count_sum")]
    if not found:
        return links.select("row", F.col("times").alias("n_best"), F.col("times").alias("count_sum"))
    out = found[0].groupBy("row").agg(*sums)
    for more in found[1:]:
        out = out.unionByName(more.groupBy("row").agg(*sums)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out


def default_models() -> tuple[str, bytes]:
    """The public files the registered query uses."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")), f.read()


def op13_token_alignment(spark, sf_dir: str, common: int = COMMON) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scratch = Scratch(spark, "align")
    aligned = align_documents(docs, *default_models()).drop("text")
    shown = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    aligned = aligned.withColumn("groups_sha256", shown).drop("groups").withColumn("row", F.monotonically_increasing_id())
    aligned = scratch.keep(aligned, "aligned")
    scores = link_scores(aligned, "row", scratch, common)
    out = aligned.drop("link_a", "link_b", "link_times").join(scores, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
                      F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
