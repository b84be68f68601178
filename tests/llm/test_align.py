"""Alignment against one that walks token by token, and counts against a dictionary."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from measurekit.llm import align
from measurekit.llm.shared import tune

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def models():
    return align.default_models()


@pytest.fixture(scope="module")
def libraries(models):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))


def plain(text, a, b) -> list[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """Groups of (id, bytes) of both, found by walking; no groups where the bytes differ."""
    if not text:
        return []
    char = {c: k for k, c in _byte_chars().items()}
    ta = [(i, bytes(char[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>") for i in a.encode(" " + text, add_special_tokens=False).ids]
    tb = [(i, bytes([int(b.IdToPiece(i)[3:5], 16)]) if b.IsByte(i) else b.IdToPiece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = b" " + text.encode()
    if b"".join(s for _, s in ta) != whole or b"".join(s for _, s in tb) != whole:
        return []
    groups, ga, gb, at_a, at_b = [], [], [], 0, 0
    tb = tb[::-1]
    for i, s in ta:
        ga.append(i)
        at_a += len(s)
        while tb and at_b < at_a:
            j, t = tb.pop()
            gb.append(j)
            at_b += len(t)
        if at_a == at_b:
            groups.append((ga, gb))
            ga, gb = [], []
    return groups


def _byte_chars() -> dict[int, str]:
    shown = [b for b in range(256) if 0x21 <= b < 0x7F or 0xA1 <= b < 0xAD or b >= 0xAE]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


def expected(rows, a, b) -> list[tuple]:
    docs = [plain(t, a, b) for _, t in rows]
    links = [Counter((x, y) for ga, gb in groups for x in ga for y in gb) for groups in docs]
    held = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, _), groups, c in zip(rows, docs, links):
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(c.values()),
                    sum(m for p, m in c.items() if held[p] == best[p[0]]), sum(m * held[p] for p, m in c.items()),
                    hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return out


def texts(seed: int, n: int) -> list[str | None]:
    rng = random.Random(seed)
    words = ["the", "Straße", "naïve", "日本語", "👩‍👩‍👧", "a", "\n\n", "   ", "x" * 40, "<s>", "<|endoftext|>", "<0x41>", "don't", "12345", "́", "\x00", "\t", "\r\n", "￿", "ﬁ", "\x1c", " "]
    out = [rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return out + [None, "", " ", "a▁b", "▁", "=" * 1000 + " " * 777 + "\n" * 333]


def query(spark, rows, tmp_path, common):
    tune(spark)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in align.op13_token_alignment(spark, str(tmp_path), common).collect()]


def key(row):
    return (row[0] is not None, row[0] or 0, *row[1:])


@pytest.mark.parametrize("common", [0, 40, 1 << 20])
def test_query_equals_a_walk(spark, tmp_path, libraries, common):
    rows = list(enumerate(texts(3, 60)))
    rows += [(None, "the the"), (5, rows[5][1]), (5, rows[5][1])]
    assert sorted(query(spark, rows, tmp_path, common), key=key) == sorted(expected(rows, *libraries), key=key)


def test_empty_table(spark, tmp_path):
    assert query(spark, [], tmp_path, 10) == []


def test_a_long_text_is_cut_without_changing_its_tokens(models, libraries, monkeypatch):
    monkeypatch.setattr(align, "PIECE", 50)
    a, b = align.ByteLevel(models[0]), align.Pieces(models[1])
    assert b.words
    for t in filter(None, texts(11, 80)):
        t = t * 5
        assert a.encode(t) == libraries[0].encode(" " + t, add_special_tokens=False).ids
        assert b.encode(t) == libraries[1].encode(t)


def test_merging_by_rank_equals_the_library(models, libraries):
    a = align.ByteLevel(models[0])
    assert a.ranks is not None
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    r = random.Random(13)
    r.shuffle(every)
    for s in range(0, len(every), 20_000):
        part = "".join(c + r.choice(["", "", " ", "a", "1", "'s", "\n"]) for c in every[s:s + 20_000])
        assert a.ranks.encode_ordinary(part) == libraries[0].encode(part, add_special_tokens=False).ids
    model = json.loads(models[0])
    model["model"]["merges"].reverse()
    assert align.ByteLevel(json.dumps(model)).ranks is None


@pytest.mark.parametrize("lane", [1, 2, 7, 1000])
def test_lanes_of_any_length_give_the_same_cuts(lane):
    rng = np.random.default_rng(lane)
    ends_a, ends_b, first, end = [], [], [0], 0
    for _ in range(40):
        size = int(rng.integers(0, 60))
        if size:
            ends_a += sorted({end + int(x) for x in rng.integers(1, size + 1, 20)} | {end + size})
            ends_b += sorted({end + int(x) for x in rng.integers(1, size + 1, 20)} | {end + size})
        first.append(len(ends_a))
        end += size
    a, b = np.array(ends_a), np.array(ends_b)
    place = {x: k for k, x in enumerate(ends_b)}
    assert align.lockstep(a, b, np.array(first), lane).tolist() == [place.get(x, -1) for x in ends_a]


def test_long_groups_are_counted_by_distinct_ids(monkeypatch):
    ids_a, ids_b = np.array([3, 3, 4, 5] * 50), np.array([1, 2, 2] * 30)
    args = (np.array([0, 1]), np.array([0, 100]), np.array([100, 200]), np.array([0, 40]), np.array([40, 90]), 10, 10)
    whole = [x.tolist() for x in align._links(ids_a, ids_b, *args)]
    monkeypatch.setattr(align, "EXPANDED", 32)
    assert [x.tolist() for x in align._links(ids_a, ids_b, *args)] == whole


def test_other_columns_with_the_same_names_stay(spark, models):
    tune(spark)
    docs = spark.createDataFrame([(1, "a b", 9)], "N_A long, text string, groups long")
    out = align.align_documents(docs, *models)
    assert out.columns == ["N_A", "text", "groups", "n_a_", "n_b", "n_groups", "n_links", "groups_", "link_a", "link_b", "link_times"]
    row = out.first()
    assert (row["N_A"], row["groups"], row["n_a_"], row["groups_"].count(";")) == (1, 9, 2, 1)


def test_a_hot_pair_and_very_long_texts(spark, tmp_path, libraries):
    rows = [(k, "the same words") for k in range(300)] + [(1000, "the same " * 40_000), (1001, "z" * 30_000)]
    assert sorted(query(spark, rows, tmp_path, 2), key=key) == sorted(expected(rows, *libraries), key=key)
