import random
from functools import partial

import numpy as np
import pytest
from cases import frame, odd_documents, words

import corpus_pipeline
from rankfield.llm import near_copies, simhash


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def roots(texts):
    """Component number of each text, by comparing all of them."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if 100 * len(sets[i] & sets[j]) >= 80 * union and label[i] != label[j]:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return label


def near_rows(groups=60):
    rng = random.Random(5)
    rows = []
    for g in range(groups):
        w = [f"g{g}w{i}" for i in range(rng.randint(50, 200))]
        rows.append(w)
        for _ in range(3):  # Jaccard from about 0.6 to 1
            copy = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                copy[rng.randrange(len(copy))] = f"x{rng.random()}"
            rows.append(copy)
    return [(i, " ".join(w), "en", "a", 1, "", "", "") for i, w in enumerate(rows)]


def test_pipeline_stage_matches_brute_force_jaccard(spark):
    rows = near_rows() + [(1000 + (r[0] or 0), *r[1:]) for r in odd_documents()]
    label = roots([r[1] for r in rows])
    want = {min(r[0] for r, c in zip(rows, label, strict=True) if c == g) for g in set(label)}
    got = [r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, frame(spark, rows), "").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_blocks_find_the_same_components(spark):
    rows = near_rows(8)
    found = near_copies.near_copies(frame(spark, rows), block_rows=1).collect()
    label = roots([r[1] for r in rows])
    assert {r._doc: r.component_id for r in found} == {r[0]: min(q[0] for q, c in zip(rows, label, strict=True) if c == g) for r, g in zip(rows, label, strict=True)}


def test_a_large_component_in_blocks_is_one(spark):
    base = [f"w{i}" for i in range(60)]
    # each copy is linked to the base (51 of 61 shingles), hardly any two copies to each other
    texts = [base] + [[*base[: 5 + i % 50], f"x{i}", *base[6 + i % 50 :]] for i in range(1_300)]
    rows = [(i, " ".join(w), "en", "a", 1, "", "", "") for i, w in enumerate(texts)] + [(2_000, "on its own", "en", "a", 1, "", "", "")]
    found = near_copies.near_copies(frame(spark, rows), block_rows=200).collect()
    assert {r._doc: r.component_id for r in found} == {**{i: 0 for i in range(1_301)}, 2_000: 2_000}


def planted(pairs=400):
    """Pairs of sets of which 0.80 to 0.95 are shared, of 40 to 300 shingles, and as many sets on their own."""
    rng = np.random.default_rng(9)
    sets, want = [], []
    for k in range(pairs):
        n, s = int(rng.integers(40, 300)), 0.80 + 0.15 * rng.random()
        x = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        other = int(n * (1 - s) / (1 + s))
        want.append((len(sets), len(sets) + 1))
        sets += [x[:n], x[other : n + other], rng.integers(0, 1 << 63, n).astype(np.uint64)]
    return sets, want


def test_trees_name_the_planted_pairs_and_hardly_any_other(spark):
    sets, want = planted()
    rows = [(i, bytearray(near_copies.fingerprint(x).tobytes())) for i, x in enumerate(sets)]
    distinct = spark.createDataFrame(rows, "_set long, _print binary")
    for options in ({}, {"shard_rows": 60}):
        found = {(min(r), max(r)) for r in near_copies.candidate_links(distinct, **options).collect()}
        assert found == set(want)


def test_a_fingerprint_has_the_bits_of_over_half_of_the_mixed_hashes():
    hashes = np.random.default_rng(2).integers(0, 1 << 63, 700).astype(np.uint64)
    one = [near_copies.fingerprint(hashes[i : i + 1]) for i in range(700)]
    bits = np.unpackbits(np.stack(one).view(np.uint8), axis=1).astype(int)
    assert (np.unpackbits(near_copies.fingerprint(hashes).view(np.uint8)) == (2 * bits.sum(axis=0) > 700)).all()


def test_many_links_of_a_leaf_are_a_forest():
    checks = np.zeros((500, near_copies.CHECK_WORDS), np.uint64)
    checks[300:] = np.uint64(0xFFFFFFFFFFFFFFFF)
    y = np.arange(500, dtype=np.uint64) << np.uint64(16)
    a, b = near_copies.near_checks(checks, y[:400], y[400:], near_copies.CHECK_RADIUS)
    assert len(a) == 498 and ((a >> 16 < 300) == (b >> 16 < 300)).all()


@pytest.mark.parametrize("held", [1 << 20, 100])
def test_a_shard_returns_fewer_links_than_it_has_rows(monkeypatch, held):
    monkeypatch.setattr(simhash, "HELD_LINKS", held, raising=False)
    # 200 groups of 10: 45 pairs in each, too few in a leaf for its own forest
    rng = np.random.default_rng(3)
    checks = np.repeat(rng.integers(0, 1 << 63, (200, near_copies.CHECK_WORDS)).astype(np.uint64), 10, axis=0)
    part = np.repeat(rng.integers(0, 1 << 16, 200).astype(np.uint64), 10)
    y = part | (np.arange(2_000, dtype=np.uint64) << np.uint64(16))
    a, b = simhash.links(y[:1_500], y[1_500:], near_copies.MASK, near_copies.REACH, near_copies.CHECK_RADIUS, 1 << 17, partial(near_copies.near_checks, checks))
    a, b = (a >> np.uint64(16)).astype(int), (b >> np.uint64(16)).astype(int)
    assert (a // 10 == b // 10).all() and len(a) == 150 * 9 and len(np.unique(b)) == len(b)


def test_a_shard_of_fingerprints_returns_a_forest():
    ball = np.array([1 << i for i in range(16)] + [0, (1 << 32) - 1], np.uint64)
    a, b = simhash.links(ball, np.empty(0, np.uint64), 0xFFFF, 1, 4)
    assert len(a) == 16 and set(b.tolist()) | set(a.tolist()) == set(ball[:17].tolist())
