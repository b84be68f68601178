"""BPE encoding and decoding with a tokenization automaton.

`MergeAutomaton` compiles the merge list in order. At first the 256 byte tokens follow each other freely. The gadget of merge
(a, b) -> c takes the arc a -> b away and adds the token c, which may be entered wherever a still could be and left wherever b
could be at that moment. So whether u may follow t is settled by unfolding the younger of the two into the part it took its arcs
from, as of its merge. For each text there is exactly one path through the automaton.

So at each byte of a word exactly one token ends that may follow the one before it. Read byte by byte, a trie of the tokens with the
longest suffixes as fall-backs names the tokens that end there, longest first, and the arcs tell which one it is; the ids are the arcs
of the path from the end back. The new words of a batch are read together, one byte of all of them at a time, and arcs are settled for
all of them at once. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from measurekit.llm.shared import by_bytes, fresh, lean

# Fixed values of byte-level BPE: how words are split, and which characters stand for bytes in a vocabulary file.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

START = UNKNOWN = -1
NEVER = 1 << 60

# No word reaches from a character that is no white space to white space after it, so a text may be cut there first.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")

# Steps, arcs and chunks kept in a worker; beyond that the memory is emptied, which costs time and changes no result.
KEPT_STATES = 1 << 17
KEPT_CHUNKS = 1 << 17
SLOTS = 20                          # two to this power is the number of arcs, and of steps, kept for words that are read together

WORDS = 1 << 14                     # words that are read together
SHORT = 64                          # characters of a chunk that is kept; longer ones are encoded on their own
PLAIN = re.compile(" ?[A-Za-z]+")   # chunks that are one word

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Slots:
    """The last value met of each slot of a fixed number: a key has one slot, and a later key takes it over."""

    def __init__(self, kind: type):
        self.key, self.value = np.full(1 << SLOTS, -1), np.zeros(1 << SLOTS, kind)

    def find(self, keys: np.ndarray, made: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The values of keys, those not kept being made."""
        at = (keys.view(np.uint64) * _SPREAD >> np.uint64(64 - SLOTS)).view(np.int64)
        out = self.value[at]
        new = np.flatnonzero(self.key[at] != keys)
        if len(new):
            out[new] = made(keys[new])
            # one slot may get several keys: what is written last has to be of the same key
            slot, last = np.unique(at[new][::-1], return_index=True)
            last = new[len(new) - 1 - last]
            self.key[slot], self.value[slot] = keys[last], out[last]
        return out


class MergeAutomaton:
    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.label = labels
        self.made: dict[int, int] = {}                      # token: the merge that made it; bytes: -1
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.gone: dict[tuple[int, int], int] = {}          # arc: the merge that took it away
        for k, (a, b, c) in enumerate(merges):
            self.gone.setdefault((a, b), k)
            if c not in self.made:                          # a second way to a token's text is never taken
                self.made[c], self.left[c], self.right[c] = k, a, b
        self.token = {s: t for t, s in labels.items() if len(s) == 1 or t in self.made}
        self.prefixes = [b"", *sorted({s[:k] for s in self.token for k in range(1, len(s) + 1)})]
        self.node = {s: k for k, s in enumerate(self.prefixes)}
        # the same in flat arrays
        self.width, self.made_at, self.left_of, self.right_of, self.shorter = (np.full(max(labels) + 1, fill, np.int64) for fill in (0, -1, 0, 0, -1))
        for t, s in labels.items():
            self.width[t] = len(s)
        for t, k in self.made.items():
            self.made_at[t], self.left_of[t], self.right_of[t] = k, self.left[t], self.right[t]
        for s, t in self.token.items():
            self.shorter[t] = self._longest(s[1:])
        arcs = np.array([a << 32 | b for a, b in self.gone] or [0], np.int64)
        order = np.argsort(arcs)
        self.arcs, self.gone_at = arcs[order], np.array([*self.gone.values()] or [NEVER], np.int64)[order]
        self.longest = np.full(len(self.prefixes), UNKNOWN)
        self.alone = np.full(max(labels) + 1, UNKNOWN, np.int8)
        self.kept_steps, self.kept_arcs = Slots(np.int64), Slots(bool)
        self._empty()

    def _empty(self) -> None:
        self.table: dict[tuple[int, int], bool] = {}
        self.step: dict[int, int] = {}                      # 256 * node + byte: the node it leads to

    def _longest(self, s: bytes) -> int:
        """The longest token that s ends with; none: -1."""
        return next((u for k in range(len(s)) if (u := self.token.get(s[k:])) is not None), -1)

    def follows(self, t: int, u: int) -> bool:
        """Whether the automaton has the arc t -> u."""
        known = self.table.get((t, u))
        if known is None:
            known = self.table[t, u] = self._arc(t, u)
        return known

    def _arc(self, t: int, u: int, until: int = NEVER) -> bool:
        made = self.made
        while True:
            if self.gone.get((t, u), until) < until:
                return False
            mt, mu = made.get(t, -1), made.get(u, -1)
            if mt < 0 and mu < 0:
                return True
            if mt > mu:                                     # t is the younger: its arcs are those its right part had
                until, t = mt, self.right[t]
            else:                                           # u is the younger: it is entered where its left part still was
                until, u = mu + 1, self.left[u]

    def _arcs(self, keys: np.ndarray) -> np.ndarray:
        """`_arc` for many t << 32 | u."""
        out = np.zeros(len(keys), bool)
        rows, t, u, until = np.arange(len(keys)), keys >> 32, keys & 0xFFFFFFFF, np.full(len(keys), NEVER)
        while len(rows):
            key = t << 32 | u
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            mt, mu = self.made_at[t], self.made_at[u]
            there = (self.arcs[at] != key) | (self.gone_at[at] >= until)
            end = (mt < 0) & (mu < 0)
            out[rows[there & end]] = True
            on = np.flatnonzero(there & ~end)
            rows, t, u, mt, mu = rows[on], t[on], u[on], mt[on], mu[on]
            younger = mt > mu
            until = np.where(younger, mt, mu + 1)
            t, u = np.where(younger, self.right_of[t], t), np.where(younger, u, self.left_of[u])
        return out

    def _next(self, key: int) -> int:
        """The node of the longest suffix that a token begins with, after the byte of 256 * node + byte."""
        to = self.step.get(key)
        if to is None:
            part = self.prefixes[key >> 8] + bytes((key & 255,))
            to = self.step[key] = next(self.node[part[k:]] for k in range(len(part) + 1) if part[k:] in self.node)
            if self.longest[to] == UNKNOWN:
                self.longest[to] = self._longest(self.prefixes[to])
        return to

    def _steps(self, keys: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self._next, keys.tolist()), np.int64, len(keys))

    def encode_word(self, word: bytes) -> list[int]:
        node, path, width = 0, [START], self.width
        for byte in word:
            if len(self.step) + len(self.table) > KEPT_STATES:
                self._empty()
            node = self._next(node << 8 | byte)
            u = int(self.longest[node])
            while not (self._alone(u) if (t := path[-int(width[u])]) == START else self.follows(t, u)):
                u = int(self.shorter[u])
            path.append(u)
        out, n = [], len(word)
        while n:
            u = path[n]
            out.append(u)
            n -= int(width[u])
        return out[::-1]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words without an empty one, end to end, and how many each has: `encode_word` for all at once."""
        if len(self.step) > KEPT_STATES:
            self._empty()
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        data, at, n = np.frombuffer(b"".join(words), np.uint8), (np.cumsum(size) - size)[order], size[order]
        path = np.full((int(n[0]) + 1, len(words)), START, np.int32)
        node = np.zeros(len(words), np.int64)
        for k in range(len(path) - 1):                      # longest words first, so those that go on are the first ones
            more = int(np.searchsorted(-n, -k))
            node = self.kept_steps.find(node[:more] << 8 | data[at[:more] + k], self._steps)
            rows, u = np.arange(more), self.longest[node]
            while len(rows):
                t = path[k + 1 - self.width[u], rows].astype(np.int64)
                first = t == START
                may = np.zeros(len(rows), bool)
                may[first] = self._all_alone(u[first])
                may[~first] = self.kept_arcs.find(t[~first] << 32 | u[~first], self._arcs)
                path[k + 1, rows[may]] = u[may]
                rows, u = rows[~may], self.shorter[u[~may]]
        ids, count = np.zeros((len(words), len(path) - 1), np.uint32), np.zeros(len(words), np.int64)
        rows, left = np.arange(len(words)), n.copy()
        while len(rows):                                    # filled from the right, as paths are read from the end back
            u = path[left[rows], rows]
            count[order[rows]] += 1
            ids[order[rows], ids.shape[1] - count[order[rows]]] = u
            left[rows] -= self.width[u]
            rows = rows[left[rows] > 0]
        return ids[np.arange(ids.shape[1]) >= (ids.shape[1] - count)[:, None]], count

    def _all_alone(self, tokens: np.ndarray) -> np.ndarray:
        for u in set(tokens[self.alone[tokens] == UNKNOWN].tolist()):
            self._alone(u)
        return self.alone[tokens] == 1

    def _alone(self, u: int) -> bool:
        """Whether the token's own text is encoded as this token: its two parts could stand side by side when it was made."""
        if self.alone[u] == UNKNOWN:
            k = self.made.get(u, -1)
            self.alone[u] = k < 0 or (self._alone(self.left[u]) and self._alone(self.right[u]) and self._arc(self.left[u], self.right[u], k))
        return bool(self.alone[u])


class ByteBpe:
    """A byte-level BPE vocabulary file with its automaton."""

    def __init__(self, data: str):
        model = json.loads(data)
        chars = {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(PRINTABLE))}
        vocab = model["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        labels = {i: bytes(chars[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.automaton = MergeAutomaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.arc = [b""] * (max([*labels, *self.special.values()]) + 1)
        for i, s in labels.items():
            self.arc[i] = s
        for s, i in self.special.items():
            self.arc[i] = s.encode()
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.kept: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """`encode` for texts that are encoded together."""
        parts = [[text] if self.cut is None or not any(s in text for s in self.special) else self.cut.split(text) for text in texts]
        chunks = [[part] if part in self.special else CHUNK.findall(part) for some in parts for part in some]
        known = [list(map(self.kept.get, some)) for some in chunks]
        new = self._new(list({chunk for some, found in zip(chunks, known) if None in found for chunk, ids in zip(some, found) if ids is None}))
        done = iter([b"".join(map(new.get, some, found) if None in found else found) for some, found in zip(chunks, known)])
        return [b"".join([next(done) for _ in some]) for some in parts]

    def _new(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of chunks not kept yet; short ones are kept from now on."""
        new = {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}
        short = [chunk for chunk in chunks if len(chunk) <= SHORT and chunk not in new]
        for chunk in chunks:
            if len(chunk) > SHORT and chunk not in new:
                new[chunk] = np.array([i for word in self.split.findall(chunk) for i in self.automaton.encode_word(word.encode())], "<u4").tobytes()
        for s in range(0, len(short), WORDS):
            some = short[s:s + WORDS]
            split = [[chunk] if PLAIN.fullmatch(chunk) else self.split.findall(chunk) for chunk in some]
            ids, count = self.automaton.encode_words([word.encode() for words in split for word in words])
            data, at = ids.astype("<u4").tobytes(), (4 * np.r_[0, np.cumsum(count)])[np.cumsum([0, *map(len, split)])].tolist()
            found = {chunk: data[a:b] for chunk, a, b in zip(some, at, at[1:])}
            new |= found
            if len(self.kept) + len(found) > KEPT_CHUNKS:
                self.kept.clear()
            self.kept |= found
        return new

    def decode(self, ids: bytes) -> str:
        """The labels of the ids' arcs end to end; bytes that are no UTF-8 become U+FFFD."""
        arc = self.arc
        return b"".join([arc[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def _load(data: str) -> ByteBpe:
    key = hashlib.sha256(data.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(data)
    return _LOADED[key]


def read_vocabulary(path: str) -> str:
    """The vocabulary file as text. It is part of the job's code, not of its data: some 1.5 MB that go to the executors by broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, vocabulary: str, *, text: str = "text") -> DataFrame:
    """Adds ids (binary, little-endian unsigned 32-bit) and decoded (string) to the rows of docs, under names no column has.

    A null or empty text gives no ids and an empty decoded text. Rows keep their other columns; no shuffle.
    """
    names = fresh(docs, "bpe_ids", "bpe_decoded")
    model = docs.sparkSession.sparkContext.broadcast(vocabulary)
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(model.value)
        for batch in by_bytes(batches, text, 1 << 20):
            ids = bpe.encode_all([t or "" for t in batch.column(column).to_pylist()])
            arrays = [*batch.columns, pa.array(ids, pa.binary()), pa.array([bpe.decode(i) for i in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *names])

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField(names[0], BinaryType()), StructField(names[1], StringType())]))


def default_vocabulary() -> str:
    """The public vocabulary the registered queries use."""
    import public_tokenizers

    return read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def op9_bpe_codec(spark, sf_dir: str) -> DataFrame:
    out = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_vocabulary())
    return out.select("doc_id", (F.length("bpe_ids") / 4).cast("long").alias("n_tokens"), F.sha2("bpe_ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("bpe_decoded").cast("binary"), 256).alias("decoded_sha256"))
