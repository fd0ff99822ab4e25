import random

from hypothesis import given, settings
from hypothesis import strategies as st

from seqgraph.llm.op5_licenses import SHORT, TEMPLATES, Template, align, covered, increasing, licenses, told, words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=9))
def test_longest_increasing(places):
    got = [places[i] for i in increasing(places)]
    assert all(a < b for a, b in zip(got, got[1:]))
    best = 0
    for mask in range(1 << len(places)):
        sub = [p for i, p in enumerate(places) if mask >> i & 1]
        if all(a < b for a, b in zip(sub, sub[1:])):
            best = max(best, len(sub))
    assert len(got) == best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=20), st.lists(st.sampled_from("abcdefgh"), max_size=20))
def test_alignment_is_sound(a, b):
    pairs = align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    if len(set(a)) == len(a) and len(set(b)) == len(b):  # all words unique: a longest common subsequence
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) == best[-1][-1]


def test_notices(spark):
    r = random.Random(1)
    prose = lambda k: " ".join("".join(r.choices("abcdefghi", k=5)) for _ in range(k))
    docs = [(i, prose(60)) for i in range(30)]
    names = list(TEMPLATES)
    docs += [(100 + k, prose(40) + " " + TEMPLATES[n] + " " + prose(40)) for k, n in enumerate(names)]
    docs += [(None, prose(9) + " " + TEMPLATES["mit"])] * 2
    docs += [(200, "\n".join([TEMPLATES["mit"]] * 3)), (201, None), (202, ""), (203, "w " * 50_000), (204, TEMPLATES["mit-text"].replace("Software", "work product")), (205, "license the under mit released")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, license string")
    got = {}
    for x in licenses(df).collect():
        got.setdefault(x.doc_id, {})[x.license] = x
    assert licenses(df.where("doc_id is null")).count() == 2
    got.pop(None)
    assert not any(d < 100 or d in (201, 202, 203, 205) for d in got)
    for k, n in enumerate(names):
        assert got[100 + k][n].coverage == 1 and got[100 + k][n].first_word == 40 and got[100 + k][n].end_word == 40 + len(words(TEMPLATES[n]))
    assert got[200]["mit"].coverage == 1 and 0.8 <= got[204]["mit-text"].coverage < 1
    assert licenses(df.limit(0)).count() == 0 and licenses(df, {}).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=30), st.lists(st.sampled_from("abcdefghij"), min_size=1, max_size=6))
def test_short_templates_are_found_word_after_word(text, template):
    """Against plain search."""
    there = any(text[i : i + len(template)] == template for i in range(len(text)))
    assert (len(covered(text, template, 1.0, 0)) == len(template)) == there


def test_licenses_that_differ_in_a_word():
    parts = {k: Template(t, 0.8) for k, t in TEMPLATES.items()}
    names = lambda text: {n for n, *_ in told(words(text), parts)}
    assert names("Code released under the GPL license") == set()
    assert names("Licensed under CC BY 4.0") == {"cc-by-4.0"}
    assert names("This work is licensed under the GNU General Public License, version 2") == {"gpl-2.0"}
    assert names("All people have rights and seats may be reserved") == set()
    assert names(TEMPLATES["gpl-header"].replace("version 3", "version 2")) <= {"gpl-header"}  # nothing tells them apart here


def test_telling_words(spark):
    other = {1: TEMPLATES["gpl-header"].replace("version 3", "version 2"), 2: TEMPLATES["apache-2.0-header"].replace("Apache", "Other").replace("apache", "other"), 3: TEMPLATES["lgpl-header"], 4: TEMPLATES["gpl-header"], 5: TEMPLATES["bsd-2-clause"], 6: TEMPLATES["bsd-3-clause"], 7: TEMPLATES["mit-full"].replace("Software", "work product"), 8: TEMPLATES["apache-2.0-header"]}
    df = spark.createDataFrame(list(other.items()), "doc_id long, text string")
    got = {x.doc_id: x.license for x in licenses(df).collect()}
    assert got == {3: "lgpl-header", 4: "gpl-header", 5: "bsd-2-clause", 6: "bsd-3-clause", 7: "mit-full", 8: "apache-2.0-header"}
    assert SHORT == 16


LABELLED = [
    ("This project is licensed under the MIT License.", "mit"), ("Licensed under the MIT license", "mit"), ("SPDX-License-Identifier: MIT", "mit"), ("Code is MIT licensed; see the file.", "mit"), ("License: MIT", "mit"),
    ("Licensed under the Apache 2.0 license", "apache-2.0"), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("Distributed under the terms of the Apache License, Version 2.0, January 2004", "apache-2.0"),
    ("GPLv3", "gpl-3.0"), ("GNU General Public Licence, version 3", "gpl-3.0"), ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0"), ("You may use it under GPL v2 or ask us", "gpl-2.0"), ("released as GPL-2.0-only", "gpl-2.0"),
    ("the library is under the GNU Lesser General Public License, version 3", "lgpl-3.0"), ("subject to the Mozilla Public License 2.0", "mpl-2.0"), ("under the 3-clause BSD license", "bsd-3-clause"), ("SPDX-License-Identifier: BSD-2-Clause", "bsd-2-clause"), ("ISC License", "isc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by-4.0"), ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa-4.0"), ("text under CC BY-NC 4.0", "cc-by-nc-4.0"),
    ("Not released under the MIT License", None), ("This is never licensed under the Apache License 2.0", None), ("She studied at MIT and got a license to drive", None), ("an apache helicopter, version 2.0", None), ("the general public wants version 3", None),
    ("All people have rights and seats may be reserved", None), ("a clause of the new contract", None), ("the driving licence of Mr Mit", None), ("no warranty, without the GPLv3", None), ("by 4 pm on day 0", None), ("creative commons are shared alike", None),
]


def test_precision_and_recall_on_labelled_notices(spark):
    r = random.Random(4)
    prose = lambda k: " ".join("".join(r.choices("abcdefghi", k=5)) for _ in range(k))
    df = spark.createDataFrame([(i, f"{prose(20)}. {t}. {prose(20)}") for i, (t, _) in enumerate(LABELLED)], "doc_id long, text string")
    got = {}
    for x in licenses(df).collect():
        got.setdefault(x.doc_id, set()).add(x.license)
    right = sum(got.get(i) == {n} for i, (_, n) in enumerate(LABELLED) if n)
    told_ = sum(len(v) for v in got.values())
    assert right == sum(n is not None for _, n in LABELLED) and told_ == right


def test_a_denied_notice_does_not_hide_another(spark):
    df = spark.createDataFrame([(1, "It is not under the MIT License any more. Older files stay under the MIT License."), (1, "x"), (1, "x"), (None, "GPLv3")], "doc_id long, text string")
    assert sorted((x.doc_id, x.license, x.first_word) for x in licenses(df).where("doc_id is not null").collect()) == [(1, "mit", 14)]
    assert licenses(df.where("doc_id is null").union(df.where("doc_id is null"))).count() == 2
