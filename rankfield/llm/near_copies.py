"""Near copies by SimHash and vantage-point trees, decided by Jaccard similarity, for the pipeline.

Texts are sets of ``shingle``-word hashes; equal sets collapse to one. Pairs at or
over ``percent`` are found in two steps:

1. SimHash: a set has a fingerprint of 512 bits in 32 parts, and a vantage-point tree for
   each part finds the fingerprints that differ by at most 1 of its 16 bits, as in
   ``simhash``. Those that differ by at most 54 of 192 bits are linked, and the
   components of these links are candidates. Bits of sets of Jaccard s = 0.8 and equal
   size differ with chance arccos(2s / (1 + s)) / pi = 0.15, so such a pair is near in
   one part with chance 0.28 and in none with 3 in 100,000; less above. The 0.19 of the
   smallest sets (4 shingles of 5) makes that 3 in 1,000. A fingerprint of 64 bits with
   a radius for all of 0.8 (19) would prune nothing: the parts' small radius prunes, and
   their number makes up for what one of them misses.
2. Inside a component the sets themselves are compared, so every link is exact. It
   yields a spanning forest, not all pairs. A large component is compared block by
   block, so that none has to fit one task.

Defined results: a text of fewer than ``shingle`` words is one shingle; null and blank
texts are one empty set. Null ids and repeated rows are as in ``simhash``.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfield.llm.common import cut, text_key
from rankfield.llm.components import connected_components
from rankfield.llm.simhash import first_of_each, links, route, shingle_hashes, top_tree

BROADCAST_ROWS = 200_000
# A fingerprint: 8 words of 64 bits, 32 parts of 16 bits, of which 1 may differ; its first words tell near from far.
WORDS, PARTS, MASK, REACH = 8, 32, 0xFFFF, 1
CHECK_WORDS, CHECK_RADIUS = 3, 54
SLICE = 255  # sums of so many bits fit a byte
SEEDS = np.random.default_rng(1).integers(0, np.iinfo(np.uint64).max, WORDS, np.uint64, endpoint=True)


def shingle_set(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(text or "", shingle, seed))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a set in ``WORDS`` words: a bit is set if it is set in over half of the mixed hashes."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), SLICE):
        x = hashes[at : at + SLICE, None] ^ SEEDS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(31))).astype("<u8")
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def marked(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(_doc, _text_key, _chars, _set, _print) of every row; an empty set has no fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, prints = [], []
            for t in batch.column(3):
                found = shingle_set(t.as_py(), shingle)
                names.append(xxhash.xxh64_intdigest(found.astype("<u8").tobytes()))
                prints.append(fingerprint(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(prints, pa.binary())], names=["_doc", "_text_key", "_chars", "_set", "_print"])

    flat = docs.select(docs[key].cast("long").alias("_doc"), text_key(docs[text]).alias("_text_key"), F.coalesce(F.length(docs[text]), F.lit(0)).cast("long").alias("_chars"), docs[text].alias("_text"))
    return flat.mapInArrow(run, "_doc long, _text_key long, _chars long, _set long, _print binary")


def near_checks(checks: np.ndarray, home: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a leaf, as ``simhash.links`` asks for them: row numbers above the part's 16 bits.

    Rows near in the part are compared by their ``checks``; where there are many links,
    a spanning forest of them.
    """
    every = np.concatenate([home, visitors])
    row, n = (every >> np.uint64(16)).astype(np.int64), len(every)
    a, b, count = [], [], 0
    for at in range(0, len(home), step := max(1, (1 << 20) // n)):
        i, j = np.nonzero(np.bitwise_count((home[at : at + step, None] ^ every[None, :]) & np.uint64(MASK)) <= REACH)
        i, j = i[i + at < j] + at, j[i + at < j]
        near = np.bitwise_count(checks[row[i]] ^ checks[row[j]]).sum(axis=1, dtype=np.int64) <= radius
        a.append(every[i[near]])
        b.append(every[j[near]])
        count += int(near.sum())
        if count > 16 * n:
            break
    else:
        return np.concatenate(a), np.concatenate(b)
    a, b, left = [], [], every
    while len(left):
        wave, left = [left[0]], left[1:]
        while wave and len(left):
            x = wave.pop()
            hit = np.bitwise_count(checks[(left >> np.uint64(16)).astype(np.int64)] ^ checks[int(x) >> 16]).sum(axis=1, dtype=np.int64) <= radius
            found, left = left[hit], left[~hit]
            a.append(np.full(len(found), x, np.uint64))
            b.append(found)
            wave += list(found)
    return np.concatenate(a), np.concatenate(b)


def candidate_links(distinct: DataFrame, leaf_rows: int = 65_536, shard_rows: int = 400_000, sample_rows: int = 8_192) -> DataFrame:
    """(a, b) links between sets (_set, _print) whose fingerprints are near in some part.

    The top of each part's tree is fitted on a bounded sample; every set is routed
    through it. A shard of more than ``shard_rows`` is compared in blocks.
    """
    depth = min(14, max(3, (distinct.count() // leaf_rows).bit_length()))
    sample = distinct.orderBy(F.xxhash64("_set", F.lit("sample")), "_set").limit(sample_rows).select("_print").collect()
    sampled = np.frombuffer(b"".join(r[0] for r in sample), "<u2").reshape(-1, PARTS).astype(np.uint64)
    shared = distinct.sparkSession.sparkContext.broadcast([top_tree(sampled[:, p], MASK, depth) for p in range(PARTS)])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            names = np.asarray(batch.column(0))
            prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, WORDS)
            values, number = prints.view("<u2").astype(np.uint64), np.arange(len(names), dtype=np.uint64) << np.uint64(16)
            for part, tree in enumerate(shared.value):
                leaf, y, home = route(values[:, part] | number, tree, MASK, REACH)
                yield part, leaf, (y & np.uint64(MASK)).astype(np.int32), home, (y >> np.uint64(16)).astype(np.int64), names, prints

    def leaf_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at, *_ in routed(batches):
            leaf, rows = np.unique(at, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), part)), pa.array(leaf), pa.array(rows)], names=["part", "leaf", "n"])

    sizes = distinct.select("_set", "_print").mapInArrow(leaf_sizes, "part long, leaf long, n long").groupBy("part", "leaf").agg(F.sum("n").alias("n"))
    # at most PARTS x 2^depth rows, and only shards that are too large
    chunks = {(r.part, r.leaf): -(-r.n // shard_rows) for r in sizes.where(F.col("n") > shard_rows).collect()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at, value, home, row, names, prints in routed(batches):
            large = np.isin(at, [k[1] for k in chunks if k[0] == part])
            picks = [(np.flatnonzero(~large), np.zeros(int((~large).sum()), np.int64))]
            for leaf in np.unique(at[large]).tolist():
                here, c = np.flatnonzero(at == leaf), chunks[part, leaf]
                own = ((names[row[here]].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(c)).astype(np.int64)
                # block own x other, named by its smaller number first
                picks += [(here, np.minimum(own, other) * c + np.maximum(own, other)) for other in range(c)]
            at_, block = (np.concatenate(x) for x in zip(*picks, strict=True))
            r = row[at_]
            checks = [pa.array(prints[r, w].view(np.int64)) for w in range(CHECK_WORDS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), part)), pa.array(at[at_]), pa.array(block), pa.array(names[r]), pa.array(value[at_]), pa.array(home[at_]), *checks], names=["part", "leaf", "block", "_set", "value", "home", "c0", "c1", "c2"])

    def compare(group: pa.Table) -> pa.Table:
        names, home = group["_set"].to_numpy(), group["home"].to_numpy()
        checks = np.stack([group[f"c{w}"].to_numpy() for w in range(CHECK_WORDS)], axis=1).view(np.uint64)
        y = group["value"].to_numpy().astype(np.uint64) | (np.arange(len(names), dtype=np.uint64) << np.uint64(16))
        a, b = links(y[home], y[~home], MASK, REACH, CHECK_RADIUS, 1 << 17, partial(near_checks, checks))
        return pa.table({"a": names[(a >> np.uint64(16)).astype(np.int64)], "b": names[(b >> np.uint64(16)).astype(np.int64)]})

    dealt = distinct.select("_set", "_print").mapInArrow(deal, "part long, leaf long, block long, _set long, value int, home boolean, c0 long, c1 long, c2 long")
    return dealt.groupBy("part", "leaf", "block").applyInArrow(compare, "a long, b long").distinct()


def similar_forest(sets: list[np.ndarray], percent: int = 80) -> list[tuple[int, int]]:
    """Links of a spanning forest over the pairs at or over ``percent``; no set is empty."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    parts = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum([len(s) for s in sets])[:-1])
    shared = np.zeros(1 + max(int(p.max()) for p in parts), bool)
    seen, links = np.zeros(len(sets), bool), []

    def packed(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(parts[i]) for i in ids])
        return ids, np.concatenate([parts[i] for i in ids]), sizes, np.concatenate([[0], np.cumsum(sizes)])

    ids, tokens, sizes, starts = packed(order)
    for seed in order:
        if seen[seed]:
            continue
        seen[seed], wave = True, [seed]
        while wave:
            x = wave.pop()
            left = int((~seen[ids]).sum())
            if not left:
                break
            if 2 * left < len(ids):  # sets that are linked need no further look
                ids, tokens, sizes, starts = packed(ids[~seen[ids]])
            n = len(parts[x])
            lo, hi = np.searchsorted(sizes, -(-percent * n // 100)), np.searchsorted(sizes, 100 * n // percent, "right")
            if lo == hi or seen[ids[lo:hi]].all():
                continue
            shared[parts[x]] = True
            common = np.add.reduceat(shared[tokens[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo], dtype=np.int64)
            shared[parts[x]] = False
            hit = ids[lo:hi][(100 * common >= percent * (n + sizes[lo:hi] - common)) & ~seen[ids[lo:hi]]]
            seen[hit] = True
            links += [(int(x), int(y)) for y in hit]
            wave += hit.tolist()
    return links


def near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, block_rows: int = 2_048, block_chars: int = 8_000_000, **options
) -> DataFrame:
    """(_doc, _text_key, _root, component_id) of every row of ``docs``."""
    marks = cut(marked(docs, key, text, shingle))
    place = F.struct("_doc", "_text_key", "_chars")
    distinct = cut(marks.groupBy("_set").agg(F.min("_doc").alias("_least"), F.min(place).alias("_at"), F.min("_print").alias("_print")))
    near = connected_components(candidate_links(distinct.where("_print is not null"), **options))
    near = near.unionAll(near.select("component", "component").distinct())  # a component's smallest node is no row of its own

    # sizes from rows without texts; only components of more than one block are told to the rest
    found = near.join(distinct.hint("merge"), near["node"] == distinct["_set"]).select("component", "_set", "_at")
    blocks = F.ceil(F.greatest(F.count("*") / block_rows, F.sum("_at._chars") / block_chars)).cast("int")
    large = cut(found.groupBy("component").agg(blocks.alias("_blocks")).where("_blocks > 1"))
    strategy = "broadcast" if large.count() <= BROADCAST_ROWS else "merge"
    found = found.join(large.hint(strategy), "component", "left").select("component", "_set", F.coalesce("_blocks", F.lit(1)).alias("_blocks"), "_at._doc", "_at._text_key")
    flat = docs.select(docs[key].cast("long").alias("_id"), text_key(docs[text]).alias("_hash"), docs[text].alias("_text"))
    texts = flat.join(found.hint("merge"), flat["_id"].eqNullSafe(found["_doc"]) & (flat["_hash"] == found["_text_key"]))
    texts = texts.select("component", "_set", "_blocks", "_text").dropDuplicates(["_set"])
    own = F.pmod(F.xxhash64("_set"), F.col("_blocks")).cast("int")
    others = F.when(F.col("_blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("_blocks") - 1), F.col("_own")))
    dealt = texts.withColumn("_own", own).withColumn("_other", F.explode(others))
    dealt = dealt.select("component", F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"), "_set", "_text")

    def compare(group: pa.Table) -> pa.Table:
        names = group["_set"].to_numpy()
        pairs = np.array(similar_forest([shingle_set(t.as_py(), shingle) for t in group["_text"]], percent), np.int64).reshape(-1, 2)
        return pa.table({"a": names[pairs[:, 0]], "b": names[pairs[:, 1]]})

    block = ["component", "_low", "_high"]
    # else the groups stay in the join's partitions, all blocks of a component in one task
    labels = connected_components(dealt.repartition(*block).groupBy(*block).applyInArrow(compare, "a long, b long"))
    joined = distinct.join(labels.hint("merge"), distinct["_set"] == labels["node"], "left")
    rooted = joined.select("_set", "_least", F.coalesce("component", "_set").alias("_root"))
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    classes = rooted.select("_set", "_root").join(least.hint("merge"), "_root")
    return marks.join(classes.hint("merge"), "_set").select("_doc", "_text_key", "_root", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The document with the smallest id of each component, all columns."""
    return first_of_each(docs, near_copies(docs, key, text, **options), key, text)
