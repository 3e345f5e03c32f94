"""Keys that hold a large part of all rows give the results of any other key."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rankfield.llm import quality_rules, simhash, suffix_dedup
from tests.llm.cases import components, fingerprint, frame, letters, removed_bytes


def document(i, text, host="a"):
    return (i, text, "en", host, 1, "", "", "")


def outcome(rows):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


@pytest.mark.parametrize("levels", [0, 1, 3])
def test_strings_that_share_one_gram_are_dealt_over_groups(spark, monkeypatch, levels):
    monkeypatch.setattr(suffix_dedup, "LEVELS", levels)
    rng = np.random.default_rng(levels)
    noise = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    phrase = "one phrase that many hundreds of texts share word by word"
    rows = []
    for i in range(250):
        text = f"{noise(70)} {phrase} {noise(70)}"
        rows += [document(2 * i, text), document(2 * i + 1, noise(40) + text[10:-10] + noise(40))]
    rows += [document(900 + i, "=" * (120 + i)) for i in range(20)]
    sizes = []
    sort = suffix_dedup._sort_bucket
    monkeypatch.setattr(suffix_dedup, "_sort_bucket", lambda length: (sizes.append(length), sort(length))[1])
    got = outcome(suffix_dedup.repeated_spans(frame(spark, rows), bucket_entries=2_000, bucket_bytes=4_000).collect())
    assert got == Counter((d[0], *x) for d, x in zip(rows, removed_bytes([(d[0], d[1]) for d in rows]), strict=True))
    assert len(sizes) == levels + 1, "every level was needed"


def test_runs_are_cut_alike_wherever_they_lie(spark):
    rng = np.random.default_rng(4)
    raw = bytes(rng.integers(97, 123, 400).astype(np.uint8))
    def cut(text, level):
        row = pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (0, None, 5, 30, 7, 2, 0)), pa.array([text], pa.binary())], names=suffix_dedup.RUN_COLUMNS)
        return [r for b in suffix_dedup._cut_runs(100, level)([row]) for r in b.to_pylist()]

    for level in (1, 2, suffix_dedup.LEVELS + 1):
        whole, part = cut(raw, level), cut(raw[50:], level)
        assert [r["skip"] for r in whole] == sorted(r["skip"] for r in whole) and all(r["offset"] == 30 + r["skip"] and r["id"] is None for r in whole)
        strings = lambda found: {r["text"][k : k + 100]: r["gram"] for r in found for k in range(len(r["text"]) - 99)}
        assert set(strings(whole)) == {raw[k : k + 100] for k in range(301)}
        if level <= suffix_dedup.LEVELS:
            assert strings(part).items() <= strings(whole).items(), "equal strings meet in one bucket"


def test_a_null_id_comes_before_the_smallest_long(spark):
    text = "".join(np.random.default_rng(2).choice(list("abcdefgh"), 150))
    rows = [document(-(2**63), text + "x"), document(None, text + "y"), document(1, text + "z")]
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.repeated_spans(frame(spark, rows)).collect()}
    assert removed == {None: 0, -(2**63): 150, 1: 150}


def test_lines_over_the_limit_are_joined_alike_when_they_are_many(spark):
    filler = lambda i: "\n".join(" ".join(letters(i, j, k) for k in range(20)) for j in range(3))
    rows = [document(i, f"Subscribe now\n{filler(i)}\nSubscribe now", None if i % 3 else "b") for i in range(1_400)]
    rows += [document(i, None) for i in range(1_400, 1_410)] + [document(None, "Subscribe now")] + rows[:5]
    docs = frame(spark, rows)
    few, many = (Counter(map(tuple, quality_rules.judge(docs, broadcast_lines=n).collect())) for n in (1_000, 0))
    assert few == many and sum(r[6] == 4 for r in few) == 1_400
    few, many = (Counter(map(tuple, quality_rules.keep_good(docs, broadcast_lines=n).collect())) for n in (1_000, 0))
    assert few == many and sum(few.values()) == 1_405


def test_a_fingerprint_of_most_rows_and_a_component_of_most_fingerprints(spark):
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in rng.integers(0, 5_000, 300)]
    rows = [document(i, None if i % 2 else " \n") for i in range(2_500)]
    rows += [document(3_000 + i, " ".join(base[:150] + [f"n{i}"] + base[150:])) for i in range(60)]
    rows += [document(None, "")]
    found = simhash.duplicate_report(frame(spark, rows)).collect()
    prints = {r[1]: fingerprint(r[1]) for r in rows}
    distinct = sorted(set(prints.values()))
    label = dict(zip(distinct, components(distinct), strict=True))
    least: dict = {}
    for r in rows:
        if r[0] is not None:
            least[label[prints[r[1]]]] = min(r[0], least.get(label[prints[r[1]]], r[0]))
    want = Counter((r[0], f"{prints[r[1]]:016x}", least[label[prints[r[1]]]]) for r in rows)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == want
