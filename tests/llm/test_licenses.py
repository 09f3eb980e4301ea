from __future__ import annotations

import random

import pytest

from colonnade.llm import licenses
from tests.llm.conftest import SCHEMA, wide


def recursive(a: list[str], b: list[str]) -> int:
    """Words that patience alignment matches, the plain recursive way with a quadratic subsequence search."""
    n = 0
    while a and b and a[0] == b[0]:
        a, b, n = a[1:], b[1:], n + 1
    while a and b and a[-1] == b[-1]:
        a, b, n = a[:-1], b[:-1], n + 1
    once = [w for w in a if a.count(w) == 1 and b.count(w) == 1]
    spots = [(a.index(w), b.index(w)) for w in once]
    best: list[list] = []
    for i, (x, y) in enumerate(spots):
        chains = [best[k] for k in range(i) if spots[k][1] < y]
        best.append(max(chains, key=len, default=[]) + [(x, y)])
    chain = max(best, key=len, default=[])
    if not chain:
        return n
    edges = [(-1, -1), *chain, (len(a), len(b))]
    return n + len(chain) + sum(recursive(a[i + 1 : k], b[j + 1 : m]) for (i, j), (k, m) in zip(edges, edges[1:]))


@pytest.mark.parametrize("seed", range(30))
def test_alignment(seed):
    rng = random.Random(seed)
    a = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 30))]
    b = [w for w in a if rng.random() < 0.8] + [rng.choice("abcxyz") for _ in range(rng.randint(0, 4))]
    pairs = licenses.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    lengths = lambda s: sum(s.count(w) == 1 for w in set(s))
    if lengths(a) == len(a) and lengths(b) == len(b):
        assert len(pairs) == recursive(a, b)
    assert bool(pairs) == bool(recursive(a, b))


def test_planted_notices(spark, docs):
    rows, truth = [], {}
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            words = t.split()
            changed = list(words)
            if len(words) > 12:
                changed[len(words) // 2] = "changed"
            far = words[::2]
            for text, found in ((t, True), (t.upper(), True), (" ".join(changed), True), ("\n * ".join(words), True), (" ".join(far), False), (" x y z w ".join(words), False)):
                i = 70_000 + len(rows)
                rows.append((i, f"Some prose stands before it.\n{text}\nAnd more of it after.", "en", "s", 1))
                truth[i] = (name, found)
    got = licenses.license_notices(wide(docs.unionByName(spark.createDataFrame(rows, SCHEMA)))).collect()
    assert len(got) == docs.count() + len(rows)
    for r in got:
        if r.doc_id in truth:
            name, found = truth[r.doc_id]
            assert (name in r.licenses) == found, (r.doc_id, name, found)
            assert all(n.coverage >= 0.8 and n.first_word <= n.last_word for n in r.notices)
    line = "Licensed under the Apache License, Version 2.0."
    plain = {r.doc_id for r in docs.collect() if line in (r.text or "")}
    assert plain <= {r.doc_id for r in got if "Apache-2.0" in r.licenses}


def test_two_notices_and_empty(spark, empty):
    text = "Released under the MIT License. Licensed under CC BY-NC 4.0. Released under the MIT License."
    row = licenses.license_notices(spark.createDataFrame([(1, text, "en", "s", 1)], SCHEMA)).first()
    assert row.licenses == ["CC-BY-NC-4.0", "MIT"] and row.n_notices == 3
    assert licenses.license_notices(empty).count() == 0


NEIGHBOURS = {
    "Licensed under CC BY-SA 4.0": ["CC-BY-SA-4.0"],
    "Licensed under CC BY 4.0": ["CC-BY-4.0"],
    "Licensed under CC BY 3.0": [],
    "Licensed under CC BY-NC-SA 4.0": ["CC-BY-NC-SA-4.0"],
    "Released under the Apache License": [],
    "Released under the BSD License": ["BSD"],
    "Released under the BSD 3-Clause License": ["BSD-3-Clause"],
    "Released under the ISC License": ["ISC"],
    "Released under the Foo License": [],
    "This work is licensed under the GNU General Public License, version 2": ["GPL-2.0"],
    "This work is licensed under the GNU General Public License, version 4": [],
    "This work is licensed under the GNU Lesser General Public License, version 3": ["LGPL-3.0"],
    "This work is licensed under the GNU Lesser General Public License, version 2.1": ["LGPL-2.1"],
    "This work is licensed under the GNU Affero General Public License, version 3": ["AGPL-3.0"],
    "This work is licensed under the GNU Library General Public License, version 2": [],
    "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License": ["CC-BY-SA-4.0"],
    "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License": ["CC-BY-ND-4.0"],
    "This work is licensed under the Creative Commons Attribution 3.0 International License": [],
    "Licensed under the Apache License, Version 1.1.": [],
}


def test_neighbours(spark):
    texts = list(NEIGHBOURS)
    rows = [(i, f"Notes on it. {t}. More follows here.", "en", "s", 1) for i, t in enumerate(texts)]
    got = {texts[r.doc_id]: r.licenses for r in licenses.license_notices(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == NEIGHBOURS


def test_every_notice_names_its_own_licence_only():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE, licenses.NAMING, licenses.FOREIGN)
    assert set(licenses.NAMING) == set(licenses.TEMPLATES)
    for name, texts in licenses.TEMPLATES.items():
        for k, text in enumerate(texts):
            assert {n["license"] for n in scanner.scan(f"Before it. {text} After it.")} == {name}
            assert scanner.marks[[t[:2] for t in scanner.templates].index((name, k))][0], "nothing names it"
    three = licenses.TEMPLATES["BSD-3-Clause"][1]
    four = three.replace("Neither the name", "All advertising materials mentioning features of this software must display this. Neither the name")
    assert "BSD-3-Clause" not in {n["license"] for n in scanner.scan(four)}


def test_templates_of_ones_own(spark):
    rows = spark.createDataFrame([(1, "Use it under house rules two. Use it under house rules three.", "en", "s", 1)], SCHEMA)
    own = {"two": ["use it under house rules two"], "three": ["use it under house rules three"]}
    assert licenses.license_notices(rows, own).first().n_notices == 4
    named = licenses.license_notices(rows, own, naming={"two": "two", "three": "three"}).first()
    assert [(n.license, n.first_word) for n in named.notices] == [("two", 0), ("three", 6)]
