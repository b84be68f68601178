"""Patience alignment against the longest common run of words, and planted notices."""

from __future__ import annotations

import random

import pytest

from measurekit.llm import licenses
from measurekit.llm.shared import tune


def longest_common(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_alignment_is_a_common_subsequence():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.choice("abcdefghijklmnop") for _ in range(r.randrange(0, 25))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= longest_common(a, b)
        assert len(licenses.align(a, a)) == len(a)


def test_unique_words_are_aligned_in_full():
    r = random.Random(2)
    template = [f"w{k}" for k in range(200)]
    for _ in range(50):
        text = [w for w in template if r.random() < 0.9]
        for _ in range(20):
            text.insert(r.randrange(len(text)), f"x{r.random()}")
        assert len(licenses.align(text, template)) == longest_common(text, template)


MIT = next(t for t in licenses.TEMPLATES if t.text == "Released under the MIT License")
MIT_TEXT = next(t for t in licenses.TEMPLATES if t.license == "MIT" and t.text.startswith("Permission"))


def scan(text: str) -> list[tuple]:
    return licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE).scan(text)[1]


def test_planted_notices():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    filler = "the of and to in a is that for it as was with be by on not he " * 50
    for t in licenses.TEMPLATES:
        n, found = scanner.scan(filler + t.text.upper().replace(" ", "\n  ") + " " + filler)
        assert found[0][:2] == (t.license, 1.0), t
        words = licenses.words(filler)
        assert len(words) <= found[0][3] < found[0][4] <= len(words) + len(licenses.words(t.text)) and n == 2 * len(words) + len(licenses.words(t.text))
    assert scanner.scan(filler)[1] == [] and scanner.scan("license the mit under released " * 3)[1] == []
    assert sorted(f[0] for f in scan(MIT.text + " x " * 400 + "Licensed under the GNU General Public License, version 3")) == ["GPL-3.0", "MIT"]


@pytest.mark.parametrize("text,wanted", [
    ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]), ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]), ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
    ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]), ("This work is licensed under CC BY-SA 3.0", ["CC-BY-SA-3.0"]), ("Licensed under CC BY 2.5.", []),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]), ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("Licensed under the GNU Lesser General Public License, version 3", ["LGPL-3.0"]), ("Licensed under the GNU Lesser General Public License, version 2.1", ["LGPL-2.1"]),
    ("Licensed under the GNU Affero General Public License, version 3", ["AGPL-3.0"]), ("Licensed under the GNU General Public License, version 4", []),
    ("Licensed under the Apache License, Version 1.1", ["Apache-1.1"]), ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]), ("Licensed under the Apache License, Version 1.0", []),
    ("Released under the BSD License.", ["BSD"]), ("Released under the BSD 3-Clause License.", ["BSD-3-Clause"]), ("Released under the BSD 2-Clause License.", ["BSD-2-Clause"]),
    ("Released under the ISC License", ["ISC"]), ("Released under the MIT License", ["MIT"]), ("Released under the Unlicense", ["Unlicense"]), ("Released under CC0 1.0", ["CC0-1.0"]),
    ("Distributed under the terms of the Mozilla Public License, Version 2.0", ["MPL-2.0"]), ("Distributed under the terms of the Boost Software License, Version 1.0", ["BSL-1.0"]),
    ("Released under the Foo License", []), ("Released under the License", []), ("// SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", ["Apache-2.0", "MIT"]), ("SPDX-License-Identifier: Foo-1.0", []), ("The MIT campus is under the sea, released or not.", []),
])
def test_licenses_are_told_from_their_relatives(text, wanted):
    for before, after in (("", ""), ("Some words before it. ", " And some after it, in prose."), ("the license under that version of ", " version or license")):
        assert sorted(f[0] for f in scan(before + text + after)) == wanted


def test_coverage_is_that_of_the_longest_common_run():
    """A notice with words left out, changed and put in, against all places of the template in the text."""
    r = random.Random(7)
    for t in (MIT, MIT_TEXT, *r.sample(licenses.TEMPLATES, 12)):
        template = licenses.words(t.text)
        must, never = set(licenses.words(t.must)), set(licenses.words(t.never))
        for _ in range(10):
            text = [w if r.random() > 0.12 else r.choice(["foo", "bar", w + "x"]) for w in template if r.random() > 0.06]
            found = licenses.Scanner([t], licenses.COVERAGE).scan(" ".join(text))[1]
            common = longest_common(text, template)
            if must <= set(text) and never.isdisjoint(text) and len(set(template)) == len(template):
                assert [f[:3] for f in found] == ([(t.license, common / len(template), common)] if common >= licenses.COVERAGE * len(template) else [])
            elif found:
                assert must <= set(text) and found[0][2] <= common


def test_a_changed_notice_has_its_coverage():
    words = licenses.words(MIT_TEXT.text)
    kept = [w for k, w in enumerate(words) if k % 10 or w in ("granted", "sublicense")]
    found = scan(" ".join(kept))
    assert found[0][0] == "MIT" and found[0][2] == len(kept) and abs(found[0][1] - len(kept) / len(words)) < 1e-12


def test_templates_as_texts_by_license():
    assert licenses.Scanner({"own": "all of this is ours alone"}, 0.8).scan("and all of this is ours only")[1] == [("own", 5 / 6, 5, 1, 6)]


def test_rows(spark):
    notice = MIT.text
    docs = tune(spark).createDataFrame([(1, notice, "x"), (1, notice, "x"), (2, None, None), (3, "", "y"), (4, "the " * 200_000 + notice, None)], "doc_id long, text string, licenses string")
    out = licenses.scan_licenses(docs)
    assert out.columns == ["doc_id", "text", "licenses", "n_words", "licenses_"]
    found = {(r.doc_id, r.n_words, *(f.license for f in r["licenses_"])) for r in out.collect()}
    assert found == {(1, 5, "MIT"), (2, 0), (3, 0), (4, 200_005, "MIT")} and out.count() == 5
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_longest_runs_are_exact():
    r = random.Random(3)
    for _ in range(500):
        a, b = ([r.choice("abcdef") for _ in range(r.randrange(0, 20))] for _ in range(2))
        pairs = licenses._matched_first(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) == longest_common(a, b)
        if b:
            need = r.randrange(1, len(b) + 1)
            near = licenses.align_near(a, b, need, 100, 100)
            assert all(a[i] == b[j] for i, j in near) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(near, near[1:]))
            assert len(near) == (longest_common(a, b) if longest_common(a, b) >= need else 0)


def test_repeated_notices_between_prose():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    assert [f[0] for f in scanner.scan("under the x mit rule released under the mit license released under the mit license so the end under it")[1]] == ["MIT"]
    prose = "under the hood the version of this work is under the sea and the license under it is free "
    for t in licenses.TEMPLATES:
        words = licenses.words(t.text)
        one = licenses.Scanner([t], licenses.COVERAGE)
        for times in (2, 3, 50):
            for between in ("", " the under "):
                found = one.scan(prose + between.join([t.text + " "] * times) + prose)[1]
                assert [f[:3] for f in found] == [(t.license, 1.0, len(words))]
                assert found[0][4] - found[0][3] == len(words)
    changed = "released under the terms of the mit license "
    assert scanner.scan(prose + changed * 3 + prose)[1][0][:3] == ("MIT", 1.0, 5)
    assert scanner.scan(prose * 20)[1] == []
