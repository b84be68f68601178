"""The automaton against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from measurekit.llm import bpe
from measurekit.llm.shared import tune

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def codec():
    return bpe.ByteBpe(bpe.default_vocabulary())


def texts() -> list[str]:
    r = random.Random(1)
    pool = "abcdefghij ABC  \n\t'’é中́🙂0123<|endoftext|> ... ---  \x1c\x1d\x85​ ßſK"
    out = ["".join(r.choice(pool) for _ in range(r.randrange(60))) for _ in range(4000)]
    return out + ["", " ", "<|endoftext|>", "a<|endoftext|> b", "x" * 5000, " " * 3000, "aaaa" * 999, "don't I'LL we've 'Sx 's", "hello world " * 2000]


def test_ids_and_text_equal_the_library(library, codec):
    for text, want in zip(texts(), library.encode_batch(texts(), add_special_tokens=False)):
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text[:50]
        assert codec.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_forgetting_compiled_states_changes_nothing(codec, monkeypatch):
    before = [codec.encode(t) for t in texts()[:500]]
    monkeypatch.setattr(bpe, "KEPT_STATES", 50)
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", 5)
    assert [bpe.ByteBpe(bpe.default_vocabulary()).encode(t) for t in texts()[:50]] == before[:50]


def test_every_pair_of_tokens_of_a_small_vocabulary():
    # merges in order: aa, aab, ba; greedy merging by rank is the definition
    labels = {0: b"a", 1: b"b", 2: b"aa", 3: b"aab", 4: b"ba"}
    merges = [(0, 0, 2), (2, 1, 3), (1, 0, 4)]
    automaton = bpe.MergeAutomaton(labels, merges)

    def merged(word: bytes) -> list[int]:
        ids = [0 if c == ord("a") else 1 for c in word]
        for a, b, c in merges:
            k = 0
            while k + 1 < len(ids):
                if (ids[k], ids[k + 1]) == (a, b):
                    ids[k:k + 2] = [c]
                k += 1
        return ids

    for n in range(1, 9):
        for k in range(1 << n):
            word = bytes(b"ab"[k >> i & 1] for i in range(n))
            assert automaton.encode_word(word) == merged(word)


def test_words_read_together_are_words_read_alone(codec, monkeypatch):
    r = random.Random(3)
    words = [bytes(r.choice(b" aehnrst\xc3\xa4") for _ in range(r.randrange(1, 40))) for _ in range(1000)] + [b"x" * 300]
    alone = [codec.automaton.encode_word(w) for w in words]
    for slots in (20, 3):                                   # also where nearly every slot is taken over by another key
        monkeypatch.setattr(bpe, "SLOTS", slots)
        ids, count = bpe.ByteBpe(bpe.default_vocabulary()).automaton.encode_words(words)
        assert ids.tolist() == [i for w in alone for i in w] and count.tolist() == list(map(len, alone))


def test_what_a_worker_keeps_does_not_grow_with_the_words(monkeypatch):
    # states were a token path each, so words of many letters made many and their tables grew with them
    made = bpe.ByteBpe(bpe.default_vocabulary()).automaton
    r = random.Random(4)
    words = ["".join(r.choice("aeinorstdhl") for _ in range(12)).encode() for _ in range(20000)]
    made.encode_words(words[:10000])
    before = len(made.step)
    made.encode_words(words[10000:])
    assert len(made.step) < 1.5 * before and not made.table


def test_rows_keep_their_columns(spark, library):
    docs = tune(spark).createDataFrame([(1, "Hello <|endoftext|> world", 5), (2, None, None), (3, "", 6), (3, "", 6)], "doc_id long, text string, bpe_ids long")
    out = bpe.encode_documents(docs, bpe.default_vocabulary())
    assert out.columns == ["doc_id", "text", "bpe_ids", "bpe_ids_", "bpe_decoded"]
    rows = {r.doc_id: r for r in out.collect()}
    assert np.frombuffer(rows[1]["bpe_ids_"], "<u4").tolist() == library.encode("Hello <|endoftext|> world", add_special_tokens=False).ids
    assert rows[1].bpe_decoded == "Hello <|endoftext|> world" and rows[2].bpe_decoded == "" and rows[1].bpe_ids == 5
    assert bpe.encode_documents(docs.limit(0), bpe.default_vocabulary()).count() == 0


def test_query_digests(spark, library, tmp_path):
    tune(spark).createDataFrame([(1, "Ä text."), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in bpe.op9_bpe_codec(spark, str(tmp_path)).collect()}
    ids = library.encode("Ä text.", add_special_tokens=False).ids
    assert (rows[1].n_tokens, rows[1].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert rows[1].decoded_sha256 == hashlib.sha256("Ä text.".encode()).hexdigest() and rows[2].n_tokens == 0
