"""The licence scan against word-by-word search and a recursive evaluation."""

import random
import re

import pytest
from cases import frame, odd_documents

from rankfield.llm import license_scan as ls
from rankfield.llm import queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def places(text, phrases):
    w = WORD.findall(lowered(text))
    return len(w), sorted((i, p) for p in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


TEXTS = [
    "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.\nmit-license MIT\tLICENSE mit license mit license", "Licensed under CC BY-NC 4.0. cc_by  CC  by", "xmit license mit licenses émit license mit licenseé",
    "Licensed under the Apache License, Version 2.0 and the Apache\nLicense", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */\nnext", "All rights reserved.", "gnu general public license version 2 public license", "a 漢字 mit license \U0001f600 cc by",
    "License: MIT License.", "License: see the file. spdx-license-identifier: and or", "spdx-license-identifier: ((mit", '"license": "ISC",', "mit " * 50 + "license " * 3, "spdx-license-identifier: LicenseRef-Own+ or unlicensed",
]


def test_places_words_and_labels_match_plain_python(spark):
    rng = random.Random(4)
    bits = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "nc", "version", "3", "é", "x"]
    texts = TEXTS + [rng.choice([" ", "-", "\n", "\x00"]).join(rng.choice(bits) for _ in range(200)) for _ in range(30)]
    rows = [(i, t, "en", "a", 1, "clash", None, "kept") for i, t in enumerate(texts)] + odd_documents()
    docs = frame(spark, rows)
    scanned = ls.scan_licenses(docs)
    got = sorted(((r.doc_id, r.n_words, sorted((n.word, n.label) for n in r.notices if n.base), sorted((n.word, n.words, n.label) for n in r.notices)) for r in scanned.collect()), key=repr)
    want = []
    for d in rows:
        n, base = places(d[1], ls.BASE)
        every = ls.NOTICES | ls.BASE
        want.append((d[0], n, sorted((i, ls.BASE[p]) for i, p in base), sorted((i, len(p.split()), every[p]) for i, p in places(d[1], every)[1])))
    assert got == sorted(want, key=repr)


def test_query_columns(spark, tmp_path):
    frame(spark, [(i, t, "en", "a", 1, "", "", "") for i, t in enumerate(TEXTS)] + odd_documents()).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_license_scan(spark, str(tmp_path)).collect()}
    for i, text in enumerate(TEXTS[1:3]):
        n, found = places(text, ls.BASE)
        r = got[i + 1] if i + 1 not in (1, 2, 3) else next(x for x in queries.op13_license_scan(spark, str(tmp_path)).where(f"doc_id = {i + 1}").collect() if x.n_base)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(found), found[0][0], found[-1][0]) and r.base_labels == ",".join(sorted({ls.BASE[p] for _, p in found}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(","))
    blank = next(r for r in queries.op13_license_scan(spark, str(tmp_path)).where("doc_id = 6").collect() if not r.n_words)
    assert (blank.n_base, blank.first_word, blank.last_word, blank.base_labels, blank.labels, blank.score) == (0, None, None, "", "", 0.0)
    assert ls.scan_licenses(frame(spark, [])).count() == 0


def tree(rng, depth):
    """(text, grade) of a random expression, evaluated as it is built; lowest operator first."""
    if depth == 0 or rng.random() < 0.3:
        name = rng.choice(["mit", "gpl-2.0-only", "agpl-3.0", "unlicensed", "cc-by-nc-4.0", "lgpl-2.1+", "licenseref-x"])
        grade = ls.grade_of(name)
        if rng.random() < 0.3:
            return f"{name} with some-exception", max(grade, 0.6) if grade >= 0.3 else grade
        return name, grade
    sign = rng.choice(["and", "or"])
    (a, x), (b, y) = tree(rng, depth - 1), tree(rng, depth - 1)
    return f"({a}) {sign} ({b})", min(x, y) if sign == "and" else max(x, y)


def test_random_expressions_have_the_grade_of_their_tree():
    rng = random.Random(9)
    for _ in range(300):
        text, grade = tree(rng, 4)
        assert ls.evaluate(ls.postfix(text.upper().lower()))[0] == grade, text


@pytest.mark.parametrize(
    ("text", "order"),
    [
        ("a or b and c", "a b c and or"), ("a and b or c", "a b and c or"), ("a and (b or c)", "a b c or and"), ("a with e and b", "a e with b and"), ("a or b or c", "a b or c or"), ("mit license.", "mit"), ("mit, see below", "mit"),
        ("(mit", "mit"), ("mit or", "mit"), ("mit and (", "mit"), ("or mit", ""), (") mit", ""), ("", ""), ("mit) and b", "mit"), ("((a) or ((b and c", "a b c and or"), ("a or (b and", "a b or"),
    ],
)
def test_postfix_order_and_broken_expressions(text, order):
    assert " ".join(ls.postfix(text)) == order
    ls.evaluate(ls.postfix(text))


def test_score_is_the_strictest_of_what_holds(spark):
    text = {1: "mit license", 2: "mit license\nall rights reserved", 3: "cc by nc 4.0", 4: "cc by nc and cc by", 5: "spdx-license-identifier: mit or gpl-3.0-only", 6: "nothing here", 7: "spdx-license-identifier: gpl-2.0 with classpath-exception-2.0"}
    got = {r.doc_id: r.score for r in ls.scan_licenses(frame(spark, [(i, t, "", "", 1, "", "", "") for i, t in text.items()])).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.2, 4: 0.2, 5: 1.0, 6: 0.0, 7: 0.6}
