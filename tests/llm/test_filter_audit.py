"""The filter audit against a plain run of every order over every document."""

from itertools import permutations

import numpy as np
from cases import frame, letters, odd_documents, words

from rankfield.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int, n string"


def documents():
    rows = [(r[0], r[1], r[2], r[3]) for r in odd_documents()]
    long = " ".join(letters(i) for i in range(60))
    rows += [(100 + i, long, "en", "hot") for i in range(30)] + [(200, long, "en", None), (201, long, "en", ""), (None, long, "en", "hot"), (None, long, "en", "hot"), (100, long, "en", "hot"), (100, long, "en", "other")]
    rows += [(300 + i, f"{long} {'# ' * (i % 2)}{'SHOUT ' * (i % 3) * 10}{'again ' * (i % 5) * 20}", "en", f"s{i % 2}") for i in range(40)]
    return [(*r, 1, "clash", None, "kept") for r in rows]


def failing(text):
    w = words(text)
    capitals = sum("A" <= c <= "Z" for c in text)
    return {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * capitals > 5 * len(text), "D": any(c in "#$%&*|" for c in text)}


def plain(docs, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    rows = []
    for d in docs:
        text = d[1] or ""
        fails = {f for f, x in failing(text).items() if x}
        if d[0] is not None and any(o[0] is not None and o[0] < d[0] and (o[1] or "") == text for o in docs):
            fails.add("E")
        rows.append((d[0], d[3] or "", fails))
    out = {}
    for part in {p for _, p, _ in rows}:
        own, total = [(i, f) for i, p, f in rows if p == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in x for _, x in own) - len(gone), sum(x == {f} for _, x in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_every_order_run_by_hand(spark):
    docs = documents()
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (100, 1, 1), (101, 1, 0), (305, 1, 1), (306, 0, 1), (None, 1, 1), (9999, 1, 1)] + [(310 + i, i % 2, i % 3 == 0 and 1 or 0) for i in range(20)]
    got = filter_audit.audit(frame(spark, docs).repartition(3), spark.createDataFrame([(*r, "n") for r in labels], LABELS)).collect()
    want = plain(docs, labels)
    assert len(got) == len(want) and {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want


def test_audit_of_empty_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(frame(spark, []), labels).count() == 0
    alone = filter_audit.audit(frame(spark, [(1, None, None, None, None, None, None, None)]), labels).collect()
    assert len(alone) == 600 and {r.part for r in alone} == {""} and {(r.kept, r.removed) for r in alone if r.filter_order == "ABCDE"} == {(0, 1), (0, 0)}


def test_gray_walk_gives_the_survivors_of_every_subset():
    counts = np.random.default_rng(1).integers(0, 50, (3, 32, 3))
    states = filter_audit.survivors(counts)
    for subset in range(32):
        assert (states[:, subset] == counts[:, [m for m in range(32) if not m & subset]].sum(axis=1)).all()
