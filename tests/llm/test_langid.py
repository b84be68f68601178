"""Language models against a plain Kneser-Ney, and held-out accuracy."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from measurekit.llm import langid
from measurekit.llm.shared import tune

SCHEMA = "doc_id long, text string, lang string"
SYLLABLES = {"aa": "ka to mi ru se no ha".split(), "bb": "str ung sch ein lich ver".split(), "cc": "оло про сти каз ные".split()}


def corpus(seed: int, n: int = 240) -> list[tuple[int, str, str]]:
    r = random.Random(seed)
    text = lambda s: " ".join("".join(r.choice(s) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 40)))
    return [(k, text(SYLLABLES[lang]), lang) for k in range(n) for lang in [r.choice(sorted(SYLLABLES))]]


def normal(text: str) -> str:
    out = ""
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or (out and out[-1] != " "):
            out += c
    return out


def kneser_ney(texts: list[str]):
    """Interpolated, order 4, by the textbook."""
    grams = Counter(("   " + normal(t))[k:k + 4] for t in texts for k in range(len(normal(t))))
    tables = {4: grams}
    for k in (3, 2, 1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    total, kinds, discount = defaultdict(int), defaultdict(int), {}
    for k, table in tables.items():
        ones, twos = (sum(v == n for v in table.values()) for n in (1, 2))
        discount[k] = min(0.95, max(0.05, ones / (ones + 2 * twos) if ones else 0.5))
        for g, n in table.items():
            total[k, g[:-1]] += n
            kinds[k, g[:-1]] += 1

    def p(g: str) -> float:
        k = len(g)
        below = 1 / 65536 if k == 1 else p(g[1:])
        if not total[k, g[:-1]]:
            return below
        n = tables[k][g]
        if k == 1 and not n:
            return 1 / 65536 / 65536
        return max(n - discount[k], 0) / total[k, g[:-1]] + discount[k] * kinds[k, g[:-1]] / total[k, g[:-1]] * below
    return p


@pytest.fixture(scope="module")
def model(spark):
    docs = tune(spark).createDataFrame(corpus(1), SCHEMA)
    return langid.learn(docs)


def test_probabilities_equal_the_textbook(spark):
    docs = corpus(2, 60)
    model = langid.train(tune(spark).createDataFrame([(t, lang) for _, t, lang in docs], "text string, lang string"))
    plain = {lang: kneser_ney([t for _, t, of in docs if of == lang]) for lang in model.langs}
    for text in ["katomi", "kastrung mi", "простите", "zz", docs[0][1]]:
        entropy, _, n = model.entropies([text])
        padded = "   " + normal(text)
        for k, lang in enumerate(model.langs):
            if any(c not in "".join(SYLLABLES[lang]) + " " for c in normal(text)):
                continue                                    # characters a language never saw share one floor
            want = -sum(math.log(plain[lang](padded[i:i + 4])) for i in range(n[0])) / n[0]
            assert entropy[0, k] == pytest.approx(want, rel=1e-4)


def test_held_out_accuracy_and_rejection(spark, model):
    docs = corpus(3)
    rows = langid.identify(tune(spark).createDataFrame(docs, SCHEMA).select("doc_id", "text"), model).collect()
    want = {k: lang for k, _, lang in docs}
    assert sum(r.lang_pred == want[r.doc_id] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows) and not any(r.rejected for r in rows)
    lang, _, rejected = model.judge(["xqzj wvxq " * 40, None, "", "12 34 !!", "ka"])
    assert rejected[:4] == [True] * 4 and lang[1:4] == ["und"] * 3 and lang[4] in model.langs


def test_batches_do_not_matter(model):
    texts = [t for _, t, _ in corpus(4, 20)] + [None, "", "ka" * 50_000]
    together = model.entropies(texts)[0]
    for k, t in enumerate(texts):
        assert np.allclose(model.entropies([t])[0][0], together[k])


def test_pieces_of_a_long_text(model, monkeypatch):
    text = " ".join(t for _, t, lang in corpus(6, 60) if lang == "aa")
    whole = model.entropies([text])
    monkeypatch.setattr(langid, "PIECE", 500)
    cut = model.entropies([text])
    assert cut[2].sum() >= whole[2][0] - 20 and np.allclose(cut[0], whole[0], rtol=0.05) and cut[0].argmin() == whole[0].argmin()


def test_nothing_to_learn_and_other_columns(spark):
    docs = tune(spark).createDataFrame([(1, "text", None, 4.0), (None, None, "aa", None), (2, "more", None, 1.0)], SCHEMA + ", score double")
    out = langid.identify(docs, langid.learn(docs))
    assert out.columns == [*docs.columns, "lang_pred", "score_", "rejected"]
    assert {r.lang_pred for r in out.collect()} == {"und"}
    assert langid.keep_identified(docs.limit(0)).count() == 0


def test_the_label_is_no_input(spark, model):
    docs = [(k, t, lang) for k, t, lang in corpus(5, 30)]
    one = {r.doc_id: r.lang_pred for r in langid.identify(tune(spark).createDataFrame(docs, SCHEMA), model).collect()}
    two = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame([(k, t, "bb") for k, t, _ in docs], SCHEMA), model).collect()}
    assert one == two
