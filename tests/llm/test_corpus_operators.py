import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from cases import SCHEMA, base_counts, components, fingerprint, frame, letters, odd_documents, removed_bytes, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankfield.llm import components as cc
from rankfield.llm import line_dedup, mixing, packing, quality_classifier, quality_rules, simhash, suffix_dedup, token_records, topk, url_filter
from rankfield.llm.common import storage_dir

EMPTY = []


def test_quality_counts_match_plain_python(spark):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(frame(spark)).collect())
    want = Counter()
    for d in odd_documents():
        c = base_counts(d[1])
        want[(d[0], *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert got == want


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    filler = lambda i: "\n".join(" ".join(letters(i, j, k) for k in range(20)) for j in range(4))
    banner = "Subscribe NOW 123 to our letter"
    rows = [(i, f"{banner}\n{filler(i)}", "en", "hot", 1, "", "", "") for i in range(40)]
    spam = " ".join(f"spam{k}" for k in range(60))
    rows += [(100 + i, f"{spam}\nshort end {i}", "en", "hot", 1, "", "", "") for i in range(30)]
    rows += [(500, f"{banner}\n{filler(500)}", "en", "cold", 1, "", "", "")]
    docs = frame(spark, rows)
    kept = {r.doc_id: r for r in quality_rules.keep_good(docs).collect()}
    assert set(kept) == {*range(40), 500}
    assert all(banner not in kept[i].text and kept[i].n_chars == len(kept[i].text) for i in range(40))
    assert banner in kept[500].text, "the line is frequent in the other host only"
    copies = frame(spark, [(i, f"{banner}\n{filler(1)}", "en", "hot", 1, "", "", "") for i in range(60)])
    assert quality_rules.keep_good(copies).count() == 0, "every document counts, a copy too"
    once = frame(spark, [(1, f"{banner}\n{filler(1)}", "en", "hot", 1, "", "", "")] * 60)
    assert quality_rules.keep_good(once).count() == 60, "rows that repeat a document are one document"
    large = frame(spark, [(i, f"{banner}\n{filler(i)}", "en", "hot", 1, "", "", "") for i in range(40)] + [(1000 + i, filler(1000 + i), "en", "hot", 1, "", "", "") for i in range(400)])
    kept_at = lambda n: banner in {r.doc_id: r.text for r in quality_rules.keep_good(large, max_share=0.2, max_documents=n).collect()}[0]
    assert kept_at(1_000) and not kept_at(30), "a count of its own suffices, whatever the host's size"
    judged = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert judged[0].n_removed_words == 6 and judged[0].kept and not judged[100].kept and not judged[100].base_failed
    assert kept[0].asDict().keys() == set(docs.columns)


def test_line_dedup_matches_plain_python(spark):
    docs = odd_documents()
    lines = {(d[0], d[1]): [re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ") for x in (d[1] or "").split("\n") if words(x)] for d in docs}
    got = {(r.doc_id, r.n_lines, r.n_removed) for r in line_dedup.dedup_report(frame(spark)).collect()}
    want = set()
    for (key, text), own in lines.items():
        gone = set()
        for p in range(len(own) - 2):
            run = own[p : p + 3]
            earlier = any(other[q : q + 3] == run and ((k, t) == (key, text) and q < p or (k is None and key is not None) or (k is not None and key is not None and k < key)) for (k, t), other in lines.items() for q in range(len(other) - 2))
            gone |= {p, p + 1, p + 2} if earlier else set()
        want.add((key, len(own), len(gone)))
    assert got == want


def test_line_dedup_keeps_first_and_rewrites_text(spark):
    run = "alpha one\nbeta two\ngamma three"
    rows = [(1, f"start\n{run}\nend", "en", "a", 1, "", "", ""), (2, f"{run}\nother text", "en", "a", 1, "", "", ""), (3, "alpha one\nbeta two\nno", "en", "a", 1, "", "", "")]
    got = {r.doc_id: r for r in line_dedup.deduplicated_documents(frame(spark, rows)).collect()}
    assert (got[1].text, got[2].text, got[3].text) == (rows[0][1], "other text", rows[2][1])
    assert got[2].n_chars == len("other text")


def test_top_k_matches_all_pairs(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.1, 8)], "clash") for i in range(130)] + [(1000 + i, [0.1] * 8, None) for i in range(30)]
    vectors += [(2000, None, None), (2020, [0.1, None], None), (2040, [float("nan")] * 8, None), (2060, [float("inf")], None), (None, [0.1] * 8, None), (2080, [], None), (2100, [0.5, 0.5], None), (20, [9.0] * 8, None)]
    docs = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, query_id string")
    usable: dict = {}
    for i, v, _ in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable[i] = min(usable.get(i, v), v)
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in usable.items()}
    want = set()
    for q in (i for i in whole if i % 20 == 0):
        near = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=False)), i) for i, v in whole.items() if i != q)[:20]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(near)}
    assert {tuple(r) for r in topk.top_k(docs).collect()} == want
    assert {tuple(r) for r in topk.top_k(docs, shard_rows=40).collect()} == want


def test_top_k_of_nothing_and_of_large_components(spark):
    schema = "vec_id long, embedding array<double>"
    assert topk.top_k(spark.createDataFrame(EMPTY, schema)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    big = spark.createDataFrame([(0, [1e7, 1.0]), (1, [1e7, -1.0])], schema)
    assert [tuple(r) for r in topk.top_k(big).collect()] == [(0, 1, 1, 640_000_000**2 - 64 * 64)]
    huge = spark.createDataFrame([(0, [1e300, -1e300]), (1, [1e300, -1e300]), (2, [-1e300, 1e300])], schema)
    assert [tuple(r) for r in topk.top_k(huge).collect()] == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def labelled(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    rows, labels = [], []
    for i in range(240):
        plain = " ".join(rng.choice(vocabulary, 120))
        good = i % 3 > 0
        rows.append((i, plain if good else " ".join(f"{w.upper()}!!" for w in plain.split()), "en", "a", 1, "", "", ""))
        labels.append((i, int(good), 0))
    return frame(spark, rows + odd_documents()[3:8]), spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_classifier_separates_held_out_rows(spark):
    docs, labels = labelled(spark)
    rows = quality_classifier.score_quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id >= 16]
    assert len(held) > 30 and np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95


def test_classifier_learns_nothing_from_held_out_labels(spark):
    docs, labels = labelled(spark)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    score = lambda x: sorted((r.doc_id, r.score) for r in quality_classifier.score_quality(docs, x).collect())
    assert score(labels) == score(flipped)


def plain_scores(docs, labels, piece=1024, size=65_536, dictionary_rows=600, calibration_rows=900):
    """The classifier's score of each text in plain Python, one by one."""
    import xxhash
    import zstandard

    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    known: dict = {}
    for r in labels:
        if r.doc_id is not None and r.quality is not None and not held(r.doc_id):
            known[r.doc_id] = min(known.get(r.doc_id, 1), r.quality)
    share = sum(known.values()) / len(known)
    texts: dict = {}
    for r in docs:
        if r.text:
            texts[r.doc_id] = min(texts.get(r.doc_id, r.text), r.text)
    # Spark's xxhash64 of two columns: the hash of the second seeded with that of the first
    first = lambda i: xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42)
    order = lambda i: (np.uint64(xxhash.xxh64_intdigest(b"sample", first(i))).astype(np.int64), i)
    split = [sorted((i for i, y in known.items() if y == c), key=order)[: dictionary_rows + calibration_rows] for c in (1, 0)]
    split = [[texts[i].encode() for i in c if i in texts and len(texts[i].encode()) <= 32_768] for c in split]
    cuts = lambda t: [t[k : k + piece] for k in range(0, len(t), piece)]
    packers, rest = [], []
    for c in split:
        n = min(dictionary_rows, len(c) // 2)
        samples = [x for t in c[: max(1, n)] for x in cuts(t)]
        try:
            words = zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            words = b"".join(samples)[-size:]
        packers.append(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=False, write_dict_id=False))
        rest.append(c[n:])

    def shape(t):
        good, bad = (sum(len(z.compress(x)) for x in cuts(t)) for z in packers)
        return [(bad - good) / len(t), (bad - good) / (bad + good), good / len(t)]

    x = np.array([shape(t) for c in rest for t in c])
    y = np.repeat([1, 0], [len(c) for c in rest])
    centre, scale, b = quality_classifier.calibrate(x, y, share)
    return [share if not r.text else 1 / (1 + np.exp(-np.clip(b[0] + ((np.array(shape(r.text.encode())) - centre) / scale) @ b[1:], -30, 30))) for r in docs]


def test_classifier_matches_plain_python(spark):
    docs, labels = labelled(spark)
    long = frame(spark, [(1, "other text of the same id", "en", "a", 1, "", "", ""), (500, "word salad " * 20_000, "en", "a", 1, "", "", ""), (None, "no id", "en", "a", 1, "", "", "")])
    docs = docs.unionByName(long)
    rows = docs.collect()
    got = Counter((r.doc_id, round(r.score, 9)) for r in quality_classifier.score_quality(docs, labels).collect())
    assert got == Counter((r.doc_id, round(float(x), 9)) for r, x in zip(rows, plain_scores(rows, labels.collect()), strict=True))


def test_classifier_without_labels_or_documents(spark):
    docs, labels = labelled(spark)
    assert {r.score for r in quality_classifier.score_quality(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert {r.score for r in quality_classifier.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.score_quality(docs.limit(0), labels).count() == 0


def padding(lengths, counts, bounds):
    return sum(c * (next(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_have_the_least_padding(seed):
    from itertools import combinations

    rng = np.random.default_rng(seed)
    lengths = sorted(rng.choice(60, 9, replace=False).tolist())
    counts = rng.integers(1, 40, 9).tolist()
    for k in (1, 2, 3, 4):
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for c in combinations(lengths[:-1], k - 1))
        assert padding(lengths, counts, packing.best_boundaries(lengths, counts, k)) == best
    assert packing.best_boundaries([5], [3], 8) == [5]


def test_packing_covers_every_token_once(spark):
    docs = frame(spark)
    rows = packing.pack(docs, max_tokens=100, batch_tokens=400, shard_rows=50).collect()
    want = Counter()
    for d in odd_documents():
        n = len(words(d[1]))
        want.update((d[0], p, p * 100, min(100, n - p * 100)) for p in range(max(1, -(-n // 100))))
    assert Counter((r.doc_id, r.piece, r.start_token, r.n_tokens) for r in rows) == want
    batches: dict = {}
    for r in rows:
        assert r.n_tokens <= r.padded_tokens
        batches.setdefault((r.bucket, r.padded_tokens), []).append((r.batch, r.slot))
    for (_, padded), places in batches.items():
        most = max(1, 400 // max(padded, 1))
        assert sorted(places) == [(i // most, i % most) for i in range(len(places))]
    assert packing.pack(docs.limit(0)).count() == 0


def test_simhash_matches_plain_python(spark):
    docs = odd_documents()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id is None, r.component_id or 0) for r in simhash.duplicate_report(frame(spark)).collect())
    prints = [fingerprint(d[1]) for d in docs]
    label = components(prints)
    least = {c: min((d[0] for d, x in zip(docs, label, strict=True) if x == c and d[0] is not None), default=None) for c in set(label)}
    want = sorted((d[0] is None, d[0] or 0, f"{p:016x}", least[c] is None, least[c] or 0) for d, p, c in zip(docs, prints, label, strict=True))
    assert got == want


@pytest.mark.parametrize("options", [{}, {"shard_rows": 60}, {"leaf_rows": 16, "sample_rows": 64}])
def test_vantage_trees_lose_no_link(spark, options):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 64, 300, np.uint64)
    near = np.array([int(v) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 6)), replace=False)) for v in np.repeat(x[:80], 3)], np.uint64)
    ball = np.array([int(x[0]) ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(i)], np.uint64)
    every = np.unique(np.concatenate([x, near, ball]))
    frame_ = spark.createDataFrame([(int(v),) for v in every.view(np.int64)], "fp long")
    labels = {r.node: r.component for r in cc.connected_components(simhash.near_links(frame_, **options)).collect()}
    want = components(every.tolist())
    got = [labels.get(int(v), int(v)) for v in every.view(np.int64)]
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(7, 7), (5, 4), (5, 4)]
    rows = {r.node: r.component for r in cc.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert rows == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 40)}
    assert cc.connected_components(spark.createDataFrame(EMPTY, "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(spark):
    kept = Counter(r.doc_id for r in simhash.one_of_each(frame(spark)).collect())
    assert kept[1] == 1 and kept[2] == 0 and kept[7] == 1 and kept[8] == 0 and kept[4] == 1 and kept[5] == 0 and kept[None] == 1 and max(kept.values()) == 1
    assert simhash.one_of_each(frame(spark).limit(0)).columns == frame(spark).columns


def test_url_rules_list_and_false_positives(spark):
    urls = ["http://A.Example.org/en/12", "https://example.org/es/", "http://org", "http://org/", "https://x.com/fr/a?b#c", "x.com/fr/", None, "http://bad.net/p.html?utm_source=x#top", "https://www.bad.net/p/", "http://bad.net/q", "ftp://a.com/de/://b.org/", "http://bad.net/p?page=2"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("https://bad.net/p",), (None,), ("https://bad.net/p",)], "url string")
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    for options in ({}, {"broadcast_bytes": 0}, {"bits_per_key": 1}):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, listed, rules, **options).collect()}
        assert got == {
            0: ("a.example.org", "/en/12", "example.org/en/1", "block"), 1: ("example.org", "/es/", "example.org/es/", "block"), 2: ("org", "", None, "allow"), 3: ("org", "/", "org/", "allow"), 4: ("x.com", "/fr/a", "com/fr/", "allow"),
            5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("bad.net", "/p.html", None, "block"), 8: ("www.bad.net", "/p/", None, "block"), 9: ("bad.net", "/q", None, "allow"), 10: ("a.com", "/de/://b.org/", "com/de/", "block"), 11: ("bad.net", "/p", None, "allow"),
        }
    assert url_filter.filter_urls(pages.limit(0), listed, rules).count() == 0
    assert url_filter.filter_urls(pages, listed.limit(0), rules).where("listed").count() == 0


def sourced(spark):
    rows = [(i, " ".join(["w"] * (20 + i % 30)), "en", "big" if i % 4 else ("small" if i % 8 else None), 1, "", "", "") for i in range(400)] + [(900, None, "en", "void", 0, "", "", "")]
    return frame(spark, rows)


def test_mixing_meets_the_repetition_limit_and_keeps_every_document(spark):
    rows = mixing.mixed_order(sourced(spark), target_entropy=0.99, repetition_limit=1.5, block_tokens=500).collect()
    uses = Counter(r.doc_id for r in rows)
    assert set(uses) == {*range(400), 900} and max(uses.values()) <= 2
    tokens = Counter()
    for r in rows:
        tokens[r.source] += r.n_tokens
    own = Counter()
    for i in range(400):
        own["big" if i % 4 else ("small" if i % 8 else None)] += 20 + i % 30
    assert tokens["big"] == own["big"]
    assert max(abs(tokens[s] / own[s] - 1.5) for s in ("small", None) if own[s] == min(own["small"], own[None])) < 0.05
    places: dict = {}
    for r in rows:
        places.setdefault((r.source, r.block, r.epoch), []).append(r.position)
    assert all(len(set(p)) == len(p) for p in places.values()) and len({r.block_order for r in rows}) == len(places)


def test_mixing_meets_the_entropy_target_within_a_budget(spark):
    plan, _ = mixing.source_plan(sourced(spark).selectExpr("source AS _source", "size(split(text, ' ')) AS _tokens").fillna({"_source": "none", "_tokens": 0}), budget=5000, target_entropy=0.9, repetition_limit=None)
    rows = [r for r in plan.collect() if r.weight]
    w = np.array([r.weight for r in rows])
    assert abs(w.sum() - 1) < 1e-4 and abs(-(w * np.log(w)).sum() - 0.9 * np.log(len(w))) < 1e-3
    same = mixing.mixed_documents(sourced(spark).limit(0))
    assert same.count() == 0 and same.columns == sourced(spark).columns


def test_token_records_round_trip(spark, tmp_path):
    docs = odd_documents()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    index = token_records.export(frame(spark), str(tmp_path), file_bytes=60_000).collect()
    ids = lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    want = Counter((d[0], len(ids(d[1])), zlib.crc32(ids(d[1]).tobytes())) for d in docs)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in index) == want
    ordered = sorted(index, key=lambda r: (r.file, r.offset))
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1].tolist()]
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in ordered]
    assert keys == sorted(keys) and len({r.file for r in index}) > 1
    some = ordered[7]
    with open(some.file.removeprefix("file:"), "rb") as f:
        f.seek(some.offset)
        data = f.read(some.length)
    (_, _, key, read), = token_records.frames(data)
    assert (key, len(read)) == (some.doc_id, some.n_tokens)
    with pytest.raises(ValueError, match="broken record"):
        list(token_records.frames(data[:20] + bytes([data[20] ^ 1]) + data[21:]))
    assert token_records.export(frame(spark).limit(0), str(tmp_path / "none")).count() == 0


def test_token_files_go_by_their_number(spark):
    names = [f"file:/x/part-{n:05d}-abc.txt" for n in (0, 7, 1023, 1024, 99_999, 100_000, 100_001, 1_000_000)]
    index = spark.createDataFrame([(f, b, 10 + k, b * 3) for k, f in enumerate(names) for b in (0, 1)], "file string, offset int, n_tokens int, before int")
    got = {(r.file, r.offset): r.start for r in token_records.with_starts(index).collect()}
    sums = np.cumsum([0] + [2 * (10 + k) for k in range(len(names))])
    assert got == {(f, b): sums[k] + 3 * b for k, f in enumerate(names) for b in (0, 1)}


def test_word_cache_equals_the_tokenizer():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoder = token_records.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), most_words=5)
    texts = ["Thonst. thonst, THONST.,", "it's we'll.", "É Über ÀÉ. straße ΟΔΟΣ. İstanbul", "é .é", "<|endoftext|> <|ENDOFTEXT|>.", "a..b ...", "µ ª.", "x y\x85z", "99 1a2.", "", None, "\x1d a", "ǅ."]
    for _ in range(3):
        for text, got in zip(texts, encoder.encode(texts), strict=True):
            assert got.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_suffix_dedup_matches_plain_python(spark):
    docs = [d for d in odd_documents() if d[0] not in (7, 8)]
    long = "".join(chr(97 + (i * i) % 23) for i in range(700))
    extra = [(20, long), (21, long[50:400] + "x" * 260), (22, "y" * 30 + long[300:600]), (22, "other " + long[:90]), (23, long[:99]), (24, "é" * 80), (25, "z" + "é" * 60), (19, long[600:] + long[:300])]
    docs += [(k, t, "en", "a", 1, "", "", "") for k, t in extra]
    rows = suffix_dedup.repeated_spans(frame(spark, docs), bucket_entries=500).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)
    want = Counter((d[0], *x) for d, x in zip(docs, removed_bytes([(d[0], d[1]) for d in docs]), strict=True))
    assert got == want
    assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in rows)
    assert suffix_dedup.repeated_spans(frame(spark).limit(0)).count() == 0


def test_difference_cover_shifts_any_two_places():
    cover = set(suffix_dedup.COVER)
    v = suffix_dedup.COVER_MODULUS
    assert all(any((i + s) % v in cover and (j + s) % v in cover for s in range(v)) for i in range(v) for j in range(v))


@pytest.mark.parametrize("run", [quality_rules.judge, quality_rules.keep_good, suffix_dedup.repeated_spans, line_dedup.dedup_report, line_dedup.deduplicated_documents, simhash.duplicate_report, mixing.mixed_documents])
def test_empty_tables_give_empty_results(spark, run):
    assert run(spark.createDataFrame(EMPTY, SCHEMA)).count() == 0


def test_storage_follows_the_session(spark):
    assert storage_dir(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("letters_", [2, 3, 26])
def test_suffixes_stand_in_byte_order(letters_):
    rng = np.random.default_rng(letters_)
    base = rng.integers(0, letters_, 900).astype(np.uint8) + 97
    data = np.concatenate([base, base[:400], np.full(300, 97, np.uint8), base[100:350], np.zeros(150, np.uint8), base[250:260], base[:500]])
    data[::61] ^= 128
    at = np.sort(rng.choice(len(data) - 100, 1500, replace=False))
    order, new = suffix_dedup.sort_suffixes(data, at, 100)
    strings = [data[p : p + 100].tobytes() for p in at.tolist()]
    assert order.tolist() == sorted(range(len(at)), key=lambda k: (strings[k], k))
    ranked = [strings[k] for k in order.tolist()]
    assert new.tolist() == [k for k in range(len(ranked)) if k == 0 or ranked[k] != ranked[k - 1]]


def test_suffix_dedup_of_hundreds_of_documents_matches_plain_python(spark):
    rng = np.random.default_rng(9)
    words_ = ["".join(rng.choice(list("abcdefghé"), int(rng.integers(2, 9)))) for _ in range(300)]
    passages = [" ".join(rng.choice(words_, 40)) for _ in range(12)]
    rows = []
    for i in range(400):
        parts = [" ".join(rng.choice(words_, int(rng.integers(5, 60))))]
        for p in rng.choice(12, int(rng.integers(0, 3)), replace=False):
            cut_at = int(rng.integers(0, 80))
            parts += [passages[p][cut_at:], " ".join(rng.choice(words_, 8))]
        rows.append((i, "\n".join(parts) if i % 50 else "-" * int(rng.integers(90, 9_000)), "en", "a", 1, "", "", ""))
    rows += [(1_000 + r[0], *r[1:]) for r in rows[::40]] + [rows[3], rows[3]]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_spans(frame(spark, rows), bucket_entries=2_000, bucket_bytes=20_000).collect())
    assert got == Counter((d[0], *x) for d, x in zip(rows, removed_bytes([(d[0], d[1]) for d in rows]), strict=True))


def test_packing_follows_the_mixture_and_keeps_uses_apart(spark, tmp_path):
    rows = [(i, " ".join(["w"] * (20 + i % 30)), "en", "big" if i % 4 else "small", 1, "", "", "") for i in range(800)]
    mixed = mixing.mixed_documents(frame(spark, rows), target_entropy=1.0, repetition_limit=3.0, block_tokens=500)
    mixed.write.parquet(f"{tmp_path}/mixed")
    stored = spark.read.parquet(f"{tmp_path}/mixed")
    at = stored.select("doc_id", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("file"), F.col("_metadata.row_index").alias("row")).collect()
    packed = packing.pack(stored, batch_tokens=1_000, shard_rows=30, follow=True).collect()
    for bucket in {r.bucket for r in packed}:
        inside = {r.doc_id for r in packed if r.bucket == bucket}
        want = [r.doc_id for r in sorted(at, key=lambda r: (r.file, r.row)) if r.doc_id in inside]
        assert [r.doc_id for r in sorted((r for r in packed if r.bucket == bucket), key=lambda r: (r.batch, r.slot))] == want
    uses = Counter(r.doc_id for r in packed)
    assert max(uses.values()) == 3
    batches = Counter(r.bucket for r in {(r.bucket, r.batch): r for r in packed}.values())
    together = [r for r, n in Counter((r.doc_id, r.bucket, r.batch) for r in packed).items() if n > 1 and batches[r[1]] > 3]
    assert not together


def test_hot_keys_are_split_and_lose_nothing(spark):
    from rankfield.llm.common import join_split

    big = spark.range(6_000).selectExpr("id", "CASE WHEN id < 5000 THEN 1 ELSE id END AS k", "'x' AS _n")
    small = spark.createDataFrame([(1, 5_000, "a"), (5_500, 1, "b"), (9, 1, "c")], "k long, n long, v string")
    got = Counter((r.k, r.v) for r in join_split(big, small, ["k"], "n", ["id"], 6_000).collect())
    assert got == {(1, "a"): 5_000, (5_500, "b"): 1}


def test_storage_must_be_shared_off_local_mode():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(ValueError, match="share"):
        storage_dir(Session())
