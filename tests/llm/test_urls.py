"""URL rules and the Markov ratio against plain Python."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pytest

from measurekit.llm import urls
from measurekit.llm.shared import tune

SCHEMA = "page_id long, url string"


def split(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return host.translate(str.maketrans(urls.UPPER, urls.LOWER)), path


def rule(host: str, path: str):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = ["http://a.example.net/x", "https://EXAMPLE.NET/en/1", "http://b.example.net/en", "http://x.example.com/de/1?q=/en/", "http://x.example.com/fr/1", "http://org/fr/", "http://my.org/fr/a#b",
        "http://myorg/fr/", "ftp://notnet/x", "http://a.net?x=1", "http://net#y", "a://b://c/d", "no scheme", "", None, "http://ünï.org/de/ß", "http://" + "long." * 3000 + "net/" + "p" * 5000, "HTTP://A.NET/X/", "http://\n.org/fr/\nz"]
URLS += [f"https://site{k % 7}.example.{t}/{lang}/{k}" for k in range(60) for t in ("net", "com", "org") for lang in ("en", "de", "fr")]


def spelled(host: str, path: str) -> str:
    return "^" * urls.ORDER + re.sub("[^a-z0-9./_-]", "~", (host + path).translate(str.maketrans(urls.UPPER, urls.LOWER))) + "$"


def brute() -> dict[str | None, tuple]:
    split_of = {u: split(u) for u in URLS}
    marks: dict[str, list[int]] = {}
    for u in URLS:
        verdict = rule(*split_of[u])[1]
        m = marks.setdefault(spelled(*split_of[u]), [0, 0])
        if verdict:
            m[verdict == "block"] += 1
    counts = [Counter(), Counter()]
    for s, m in marks.items():
        if zlib.crc32(s.encode()) % urls.FOLDS:
            for side in (0, 1):
                for k in range(urls.ORDER, len(s)):
                    for n in range(urls.ORDER + 1):
                        counts[side][s[k - n:k + 1]] += m[side]
    totals = [Counter(), Counter()]
    kinds = [Counter(), Counter()]
    for side in (0, 1):
        for g, n in counts[side].items():
            totals[side][len(g), g[:-1]] += n
            kinds[side][len(g), g[:-1]] += n > 0

    def p(side: int, g: str) -> float:
        below = 1 / (len(urls.ALPHABET) + 1) if len(g) == 1 else p(side, g[1:])
        key = len(g), g[:-1]
        if not totals[side][key]:
            return below
        return (counts[side][g] + kinds[side][key] * below) / (totals[side][key] + kinds[side][key])

    score = {s: round(sum(math.log(p(0, s[k - urls.ORDER:k + 1])) - math.log(p(1, s[k - urls.ORDER:k + 1])) for k in range(urls.ORDER, len(s))) / (len(s) - urls.ORDER), 6) for s in marks}
    fold = [s for s in marks if zlib.crc32(s.encode()) % urls.FOLDS == 0]
    a, b = (sum(marks[s][side] for s in fold) for side in (0, 1))
    steps = sorted({math.floor(score[s] * 100) for s in fold})
    limit = max(steps, key=lambda t: (1 - sum(marks[s][0] for s in fold if math.floor(score[s] * 100) < t) / a + sum(marks[s][1] for s in fold if math.floor(score[s] * 100) < t) / b, -t)) / 100
    out = {}
    for u in URLS:
        r, v = rule(*split_of[u])
        out[u] = (*split_of[u], r, v or ("allow" if score[spelled(*split_of[u])] >= limit else "block"), score[spelled(*split_of[u])])
    return out


def test_equals_brute_force(spark):
    docs = tune(spark).createDataFrame(list(enumerate(URLS)), SCHEMA)
    rows = urls.judge_urls(docs).collect()
    want = brute()
    assert len(rows) == len(URLS)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == want[r.url][:4], r.url
        assert r.score == pytest.approx(want[r.url][4], abs=2e-6)


def test_no_python_in_the_plan(spark):
    docs = tune(spark).createDataFrame([(1, "http://a.net/x")], SCHEMA).selectExpr("page_id", "url")
    plan = urls.judge_urls(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_clashing_columns_empty_tables_and_nothing_to_learn(spark):
    docs = tune(spark).createDataFrame([(1, "http://a.xyz/x", "h"), (1, "http://a.xyz/x", "h"), (None, None, None)], SCHEMA + ", host string")
    out = urls.judge_urls(docs)
    assert out.columns == ["page_id", "url", "host", "host_", "path", "rule", "verdict", "score"]
    assert [r.verdict for r in out.collect()] == ["allow"] * 3
    assert urls.judge_urls(docs.limit(0)).count() == 0 and urls.judge_urls(docs, ()).count() == 3
