"""Exact substring dedup against a count of all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from measurekit.llm import suffix_dedup as s
from measurekit.llm.shared import tune

SCHEMA = "doc_id long, text string"


def brute(texts: list[bytes]) -> list[tuple[int, int, int, str]]:
    seen = Counter(t[i:i + s.LENGTH] for t in texts for i in range(len(t) - s.LENGTH + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - s.LENGTH + 1):
            if seen[t[i:i + s.LENGTH]] > 1:
                gone[i:i + s.LENGTH] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), hashlib.sha256(kept).hexdigest()))
    return out


def random_docs(seed: int) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    parts = ["".join(r.choice("abcdef ") for _ in range(r.randrange(1, 900))) for _ in range(30)]
    docs: list[tuple[int | None, str | None]] = []
    for i in range(120):
        text = "".join(r.choice(parts)[r.randrange(0, 50):] for _ in range(r.randrange(0, 4)))
        if r.random() < 0.3:
            text = text[:100] + "!" + text[100:]
        docs.append((i, text))
    return docs + [(1, None), (None, "a" * 600), (None, "a" * 600), (5, "b" * 200), (6, "c" * 201), (7, "é" * 150), (8, "xy" * 40_000)]


@pytest.mark.parametrize("pairs,group", [(64, 1 << 15), (64, 1)])
def test_equals_brute_force(spark, monkeypatch, pairs, group):
    monkeypatch.setattr(s, "GROUP", group)
    docs = random_docs(3)
    rows = s.remove_repeats(tune(spark).createDataFrame(docs, SCHEMA), keep_text=False).collect()
    want = brute([(t or "").encode() for _, t in docs])
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == sorted((str(d), *w) for (d, _), w in zip(docs, want))


def test_groups_by_names_and_by_bytes_agree():
    r = random.Random(1)
    core = bytes(r.choice(b"ab") for _ in range(s.GRAM))
    lefts, rights = ([bytes(r.choice(b"ab") for _ in range(200)) for _ in range(2)] for _ in range(2))
    at, around, n = [], [], []
    for i in range(80):
        back, ahead = r.randrange(20, 153), r.randrange(130, 152)
        left, right = bytearray(r.choice(lefts)), bytearray(r.choice(rights))
        left[r.randrange(200)] ^= 1
        right[r.randrange(200)] ^= 1
        around.append(bytes(left[200 - back:]) + core + bytes(right[:ahead]))
        at.append(1000 * i << 16 | back << 8)
        n.append(r.choice([1, 1, 2]))
    spans = [{(i, p) for i, a, b in f(np.array(at), around, np.array(n)) for p in range(a, b + 1)} for f in (s.compare_group, s.count_group)]
    assert spans[0] == spans[1] and spans[0]


def test_long_documents_are_named_in_segments(spark, monkeypatch):
    text = "".join(random.Random(2).choice("abcdefgh") for _ in range(5000))
    data = text.encode()
    whole = s.anchors(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert whole[3][0] == 0 and whole[4][-1] == len(data) - s.LENGTH
    assert (whole[3][1:] == whole[4][:-1] + 1).all()            # every window chose exactly one position


def test_other_columns_stay_and_an_empty_table_stays_empty(spark):
    docs = tune(spark).createDataFrame([(1, "z" * 300, 7, 9), (2, None, 8, None)], SCHEMA + ", spans long, n_bytes long")
    out = s.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "spans", "n_bytes", "n_bytes_", "n_removed", "n_spans", "kept_sha256", "kept"] or "n_bytes_" in out.columns
    kept = {r.doc_id: (r.text, r.spans) for r in s.drop_repeats(docs).collect()}
    assert kept[1] == ("", 7) and kept[2][1] == 8
    assert s.drop_repeats(docs.limit(0)).count() == 0
