import random
import re
from collections import Counter

import pytest

from wordloom.llm.licence_texts import FILES, GNU, NOTICES, SHORT, _text, templates
from wordloom.llm.license_scan import Scanner, scan_licenses, scanner

norm = lambda t: re.findall(r"[^\W_]+", t.lower())
grams = lambda w: Counter(zip(w, w[1:]))
PARAGRAPH = " ".join(f"some other words stand here and there number {i}" for i in range(20))


def names(text):
    return {name for name, _, _, _ in scanner(None, 0.8).scan(text)}


def wrapped(text, width=60):
    return re.sub(rf"(.{{1,{width}}})(\s|$)", r"// \1\n", " ".join(text.split()))


@pytest.mark.parametrize("name", FILES)
def test_full_texts(name):
    assert names(PARAGRAPH + "\n" + _text(name) + "\n" + PARAGRAPH) - {"Proprietary"} == {name}
    words = _text(name).split()
    r = random.Random(1)
    changed = [w if r.random() > 0.02 else "changed" for w in words]
    assert names(wrapped(" ".join(changed))) - {"Proprietary"} == {name}


def test_affero_text():
    assert names(dict((n, t) for n, t in templates() if len(t) > 10_000)["AGPL-3.0"]) == {"AGPL-3.0"}


@pytest.mark.parametrize("name,text", [x for x in (*SHORT, *NOTICES)])
def test_short_texts(name, text):
    assert names(f"{PARAGRAPH} {text} {PARAGRAPH}") == {name}
    assert names(wrapped(f"{PARAGRAPH}\n{text}\n{PARAGRAPH}")) == {name}


@pytest.mark.parametrize("kind", GNU)
def test_gnu_notices(kind):
    """The notices as the licences' appendices word them."""
    notice = (
        "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by"
        " the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This {} is"
        " distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
        " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
    )
    for thing in ("program", "library") if kind == "LGPL" else ("program",):
        assert names(notice.format(thing, GNU[kind], thing, GNU[kind])) == {f"{kind}-3.0"}
        older = notice.replace("version 3", "version 2.1" if kind == "LGPL" else "version 2").format(thing, GNU[kind], thing, GNU[kind])
        if kind != "AGPL":
            assert names(older) == {"LGPL-2.1" if kind == "LGPL" else "GPL-2.0"}


@pytest.mark.parametrize(
    "name,text",
    [
        ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
        ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
        ("CC-BY-NC-4.0", "licensed UNDER cc by-nc 4.0"),
        ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License"),
        ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"),
        ("MIT", "/* SPDX-License-Identifier: MIT */"),
    ],
)
def test_families(name, text):
    assert names(f"{PARAGRAPH}\n{text}\n{PARAGRAPH}") == {name}


def test_several_in_one_text():
    parts = [SHORT[0][1], SHORT[4][1], _text("LGPL-3.0"), "Released under CC BY 4.0. Licensed under CC BY 4.0."]
    assert names(f"\n{PARAGRAPH}\n".join(parts)) == {"MIT", "BSD-3-Clause", "LGPL-3.0", "CC-BY-4.0"}
    assert names("the the " * 500 + SHORT[0][1] + " the software" * 500) == {"MIT"}


TEXTS = [
    "All rights reserved.\nSome words here.\nMore words.", "words\nLICENSED!! UNDER!! CC!! BY-NC!! 4.0.!!\nmore",
    "Licensed under the Apache\nLicense, version 2.0\n\nand other things", "Released under the MIT License", "no licence at all",
    "all of the rights that we reserved", "İ Released under the MIT License.", "İ" * 3, "x",
]


def test_place_and_refusal():
    text = "word " * 40 + "Released under the MIT License. " + "word " * 40
    ((name, score, a, b),) = scanner(None, 0.8).scan(text)
    assert (name, score, text[a:b]) == ("MIT", 1.0, "Released under the MIT License")
    text = "This library was written at Foo in 2020 and is released under the\nMIT license. See the file for more."
    ((name, score, a, b),) = scanner(None, 0.8).scan(text)
    assert (name, score, text[a:b]) == ("MIT", 1.0, "released under the\nMIT license")
    with pytest.raises(ValueError):
        Scanner((("x", "two words"),), 0.8)


def test_query(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(50, None, 1), (51, "", 1), (0, TEXTS[0], 2), (60, "so it goes " * 200_000 + TEXTS[3], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license int")
    got = Counter((r.doc_id, r.license) for r in scan_licenses(df).collect())
    assert got == Counter([(0, "Proprietary"), (0, "Proprietary"), (1, "CC-BY-NC-4.0"), (2, "Apache-2.0"), (3, "MIT"), (6, "MIT"), (60, "MIT")])
    assert scan_licenses(df.limit(0)).count() == 0


def test_against_all_word_windows():
    """Matches have the Dice that is said, none overlap, no stretch beside them would be one, and
    none has more evidence than the best of them. By brute force over all stretches of words."""
    r = random.Random(8)
    short = [x for x in templates() if len(x[1]) < 120 and not x[1].startswith("SPDX")][:30]
    own = Scanner(tuple(short), 0.8)
    for _ in range(60):
        words = norm(" ".join(t for _, t in r.choices(short, k=3)))
        words = [w for w in words if r.random() < 0.95]
        for _ in range(r.randint(0, 6)):
            words.insert(r.randint(0, len(words)), r.choice(["foo", "the", "under"]))
        found = own.matches(words)
        taken = [(a, b) for _, _, a, b in found]
        assert all(b < c or d < a for i, (a, b) in enumerate(taken) for c, d in taken[:i])
        most = -1.0
        for t, (_, template) in enumerate(short):
            want = grams(norm(template))
            n = want.total()
            for a in range(len(words)):
                for b in range(a + 1, min(len(words), a + 2 + 2 * n)):
                    g = grams(words[a : b + 1])
                    e = 2 * (g & want).total() - 0.8 * (g.total() + n)
                    if e > 1e-9:
                        most = max(most, e)
                        assert any(a <= d and c <= b for c, d in taken), (words, template)
                    for x in found:
                        if x[1:] == (t, a, b):
                            assert x[0] == pytest.approx(e)
        assert most < 0 or max(x[0] for x in found) == pytest.approx(most)
