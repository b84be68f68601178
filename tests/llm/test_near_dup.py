"""Near duplicates against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from measurekit.llm import near_dup as n
from measurekit.llm.shared import Scratch, tune

SCHEMA = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4))


def brute(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def random_docs(seed: int) -> list[tuple[int, str | None]]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randrange(2, 6)))
    passage = " ".join(word() for _ in range(30))
    docs: list[tuple[int, str | None]] = []
    for base in range(12):
        text = [word() for _ in range(r.choice([3, 20, 120]))]
        for _ in range(r.choice([1, 2, 14])):
            copy = list(text)
            for _ in range(r.randrange(0, 4)):
                copy[r.randrange(len(copy))] = word()
            docs.append((len(docs), r.choice([" ", "\n", "  "]).join(copy).upper() if r.random() < 0.3 else " ".join(copy)))
    docs += [(len(docs) + k, " ".join(word() for _ in range(40)) + " " + passage) for k in range(25)]
    return docs + [(900, None), (901, ""), (902, " \n "), (903, "One"), (904, "one"), (905, "x " * 30_000), (906, "É é"), (907, "é é")]


@pytest.mark.parametrize("limit,block", [(64, 512), (2, 2)])
def test_equals_all_pairs(spark, monkeypatch, limit, block):
    monkeypatch.setattr(n, "LIMIT", limit)
    monkeypatch.setattr(n, "BLOCK", block)
    docs = random_docs(5)
    rows = n.near_duplicates(tune(spark).createDataFrame(docs, SCHEMA)).collect()
    assert {r.doc_id: (r.n, r.component_id) for r in rows} == brute(docs) and len(rows) == len(docs)


def test_pairs_that_quote_a_hot_group(spark):
    """Pairs whose lanes meet only in tokens of the hot text, so that they share no node but its own."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    hot = [word() for _ in range(151)]
    docs, pairs = [(k, " ".join([*hot, f"copy{k}"])) for k in range(1500)], {}
    sign = lambda texts: n.signatures([n.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts])
    token = sign([" ".join(hot)])[0]
    while len(pairs) < 6:  # three pairs
        s = r.randrange(len(hot) - 84)
        text = [*hot[s:s + 84], *(word() for _ in range(12))]
        x, y = (" ".join([*text, *(word() for _ in range(12))]) for _ in range(2))
        a, b = sign([x, y])
        met = (a == b)[:n.LANES]
        if met[:n.SECOND].any() and (a == token)[:n.LANES][met].all() and max((a == token).mean(), (b == token).mean()) < 0.49:
            k = 10_000 + len(pairs)
            docs += [(k, x), (k + 1, y)]
            pairs[k] = pairs[k + 1] = k
            x, y, d = shingles(x), shingles(y), shingles(docs[0][1])
            assert len(x & y) / len(x | y) >= 0.76 and 0.40 <= len(x & d) / len(x | d) < 0.5
    rows = n.near_duplicates(tune(spark).createDataFrame(docs, SCHEMA).repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in rows} == dict.fromkeys(range(1500), 0) | pairs


def test_pairs_among_many_alike_that_do_not_link(spark, monkeypatch):
    """Pairs in nodes that are many times LIMIT, of documents that are alike but below the threshold."""
    monkeypatch.setattr(n, "LIMIT", 4)
    monkeypatch.setattr(n, "GUESTS", 4)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    quoted, docs = [word() for _ in range(100)], []
    for k in range(370):
        text = [*quoted, word()]
        docs += [(len(docs) + j, " ".join([*text, *(word() for _ in range(16))])) for j in range(2 if k < 30 else 1)]
    rows = n.near_duplicates(tune(spark).createDataFrame(docs, SCHEMA).repartition(4)).collect()
    want = brute(docs)
    assert {r.doc_id: (r.n, r.component_id) for r in rows} == want and len({c for _, c in want.values()}) == 370


def test_all_members_of_a_large_node_meet(spark):
    members = tune(spark).createDataFrame([(1, k, 10, max(k - 400, 0) // 3) for k in range(900)], "node long, `set` long, n long, root long")
    seats, unmet = n._seated(Scratch(spark, "seats"), members, n.ROUNDS - 1)
    groups = {}
    for row in seats.collect():
        groups.setdefault(row["group"], []).append(row)
    met = set()
    for rows in groups.values():
        assert len(rows) <= n.BLOCK + 100
        left = [x["set"] for x in rows if x["guest"]] or [x["set"] for x in rows]
        met |= {(min(a, b["set"]), max(a, b["set"])) for a in left for b in rows}
    root = [max(k - 400, 0) // 3 for k in range(900)]
    assert {(a, b) for a in range(900) for b in range(a, 900) if root[a] != root[b]} <= met and unmet.isEmpty()


def test_sets_of_a_batch_do_not_depend_on_their_neighbours():
    texts = [b"", b"a b c d e f", b"  lead and trail  ", b"x", "ü ö ä ß a b".encode(), b"end"]
    at = np.cumsum([0, *map(len, texts)])
    together = n.shingle_sets(np.frombuffer(b"".join(texts), np.uint8), at)
    for text, got in zip(texts, together):
        alone = n.shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        assert got.tolist() == alone.tolist()
        assert len(got) == len(shingles(text.decode()))


def test_one_of_each_stays_with_its_columns(spark):
    long = " ".join(f"w{k}" for k in range(100))
    rows = [(5, long, "b", 1), (3, long + " more", "a", 2), (3, long + " more", "a", 2), (None, long, None, 3), (7, None, "c", 4), (7, None, "c", 4), (8, "other words in this one here", None, None)]
    docs = tune(spark).createDataFrame(rows, SCHEMA + ", `set` string, n long")
    kept = n.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n or 0) for r in kept.collect()) == [(False, 7, 4), (False, 7, 4), (False, 8, 0), (True, 0, 3)] or \
        sorted((r.doc_id or 0) for r in kept.collect()) == [3, 7, 7, 8]
    assert n.keep_one_of_each(docs.limit(0)).count() == 0
