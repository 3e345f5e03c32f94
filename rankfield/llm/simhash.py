"""SimHash near-duplicates, found exactly with forests of vantage-point trees.

A fingerprint has 64 bits. Two fingerprints within ``radius`` differ by at most
``radius // parts`` bits in one of ``parts`` equal parts, so there is one
vantage-point tree for each part, with Hamming distance on the part as its metric. A
node splits its fingerprints at a distance from its vantage point. By the triangle
inequality a fingerprint only has to be looked for across a split if its distance is
within the part's radius of it: it is then sent to the other shard as a visitor.
The top of the trees is fitted on a bounded sample and splits the work into shards;
every fingerprint is routed through it. Inside a shard the tree goes on until its
leaves are small, and leaves compare all 64 bits, so the links are exact.

Copies are collapsed to one fingerprint before. A shard yields a spanning forest of
its links, not all pairs: components stay the same, and a shard returns fewer links than
it has fingerprints. A shard with more than ``shard_rows`` fingerprints is compared in
blocks, so none has to fit one task.

Defined results: a text without words, or null, has fingerprint zero and is linked
like any other. Null ids take part; the component of a group with only null ids is
null. Rows are kept as often as they occur. An empty table gives an empty result.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfield.llm.common import cut, join_split, text_key
from rankfield.llm.components import connected_components, contracted

BITS = 64
BLOCK = 1 << 16
HELD_LINKS = 1 << 20


def shingle_hashes(text: str, shingle: int, seed: int) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Fingerprint: a bit is set if it is set in over half of the shingle hashes."""
    hashes = shingle_hashes(text or "", shingle, seed)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = np.ascontiguousarray(hashes[at : at + BLOCK].astype("<u8")).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(_doc, _text_key, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash(t.as_py(), shingle, seed) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["_doc", "_text_key", "fp"])

    flat = docs.select(docs[key].cast("long").alias("_doc"), text_key(docs[text]).alias("_text_key"), docs[text].alias("_text"))
    return flat.mapInArrow(run, "_doc long, _text_key long, fp long")


def part_masks(parts: int) -> list[int]:
    width = BITS // parts
    return [((1 << width) - 1) << (width * i) for i in range(parts)]


def _distance(x: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((x ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int16)


def _split(x: np.ndarray, mask: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """Vantage point and distance of the evenest split among a few tries."""
    best, found = 0, None
    for vantage in x[rng.integers(0, len(x), 4)]:
        d = _distance(x, int(vantage), mask)
        for r in {int(np.median(d)), int(np.median(d)) - 1}:
            even = min(int((d <= r).sum()), int((d > r).sum()))
            if even > best:
                best, found = even, (int(vantage), r)
    return found


def top_tree(sample: np.ndarray, mask: int, depth: int, seed: int = 7) -> dict[int, tuple[int, int]]:
    """Node number (root 1, children 2n and 2n + 1) to vantage point and distance."""
    nodes: dict[int, tuple[int, int]] = {}
    rng = np.random.default_rng(seed)
    todo = [(1, sample)]
    while todo:
        node, x = todo.pop()
        if node >= 1 << depth or len(x) < 8 or (cut_at := _split(x, mask, rng)) is None:
            continue
        nodes[node] = cut_at
        d = _distance(x, cut_at[0], mask)
        todo += [(2 * node, x[d <= cut_at[1]]), (2 * node + 1, x[d > cut_at[1]])]
    return nodes


def route(x: np.ndarray, tree: dict[int, tuple[int, int]], mask: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, fingerprint, home) rows: one home leaf each, and the leaves to visit.

    Of two fingerprints on either side of a split the outer one visits the inner side.
    """
    out = []
    todo = [(1, x, np.ones(len(x), bool))]
    while todo:
        node, y, home = todo.pop()
        if not len(y):
            continue
        if node not in tree:
            out.append((np.full(len(y), node, np.int64), y, home))
            continue
        vantage, r = tree[node]
        d = _distance(y, vantage, mask)
        inner, outer = d <= r, d > r
        visits_in = outer & (d <= r + reach)
        visits_out = inner & ~home & (d > r - reach)
        todo.append((2 * node, np.concatenate([y[inner], y[visits_in]]), np.concatenate([home[inner], np.zeros(visits_in.sum(), bool)])))
        todo.append((2 * node + 1, np.concatenate([y[outer], y[visits_out]]), np.concatenate([home[outer], np.zeros(visits_out.sum(), bool)])))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _leaf_links(home: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a leaf; where there are many, a spanning forest of them."""
    every = np.concatenate([home, visitors])
    n = len(every)
    if len(home) * n <= 1 << 22:
        near = np.bitwise_count(home[:, None] ^ every[None, :]) <= radius
        if int(near.sum()) - len(home) <= 16 * n:
            i, j = np.nonzero(near)
            keep = i < j
            return home[i[keep]], every[j[keep]]
    a, b, left = [], [], every
    while len(left):
        wave, left = left[:1], left[1:]
        while len(wave) and len(left):
            x, wave = wave[0], wave[1:]
            hit = np.bitwise_count(left ^ x) <= radius
            if hit.any():
                found, left = left[hit], left[~hit]
                a.append(np.full(len(found), x))
                b.append(found)
                wave = np.concatenate([wave, found])
    none = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(home: np.ndarray, visitors: np.ndarray, mask: int, reach: int, radius: int, leaf: int = 1 << 15, leaf_links: Callable = _leaf_links) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one shard's links: home fingerprints with each other and with its visitors.

    Fingerprints are distinct. Links are contracted whenever many are held.
    """
    rng = np.random.default_rng(11)
    none = np.empty(0, np.uint64)
    a, b, held = [none], [none], 0
    todo = [(home, visitors)]
    while todo:
        h, v = todo.pop()
        if not len(h) or len(h) + len(v) < 2:
            continue
        cut_at = None if len(h) * (len(h) + len(v)) <= leaf else _split(h, mask, rng)
        if cut_at is None:
            x, y = leaf_links(h, v, radius)
            a.append(x)
            b.append(y)
            held += len(x)
            if held > HELD_LINKS:
                x, y = contracted(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], 0
            continue
        vantage, r = cut_at
        dh, dv = _distance(h, vantage, mask), _distance(v, vantage, mask)
        todo.append((h[dh <= r], np.concatenate([h[(dh > r) & (dh <= r + reach)], v[dv <= r + reach]])))
        todo.append((h[dh > r], v[dv > r - reach]))
    return contracted(np.concatenate(a), np.concatenate(b))


def near_links(distinct: DataFrame, radius: int = 4, parts: int = 4, leaf_rows: int = 16_384, shard_rows: int = 200_000, sample_rows: int = 8_192) -> DataFrame:
    """(a, b) links that connect all fingerprints ``fp`` within ``radius`` of each other."""
    n = distinct.count()
    depth = min(14, max(3, (n // leaf_rows).bit_length()))
    sample = distinct.orderBy(F.xxhash64("fp", F.lit("sample")), "fp").limit(sample_rows).collect()
    sampled = np.array([r[0] for r in sample], np.int64).view(np.uint64)
    masks, reach = part_masks(parts), radius // parts
    trees = [top_tree(sampled, m, depth) for m in masks]
    spark = distinct.sparkSession
    shared = spark.sparkContext.broadcast(trees)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            x = np.asarray(batch.column(0)).view(np.uint64)
            for part, (tree, mask) in enumerate(zip(shared.value, masks, strict=True)):
                yield part, *route(x, tree, mask, reach)

    def leaf_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at, _, _ in routed(batches):
            leaf, rows = np.unique(at, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), part)), pa.array(leaf), pa.array(rows)], names=["part", "leaf", "n"])

    sizes = distinct.mapInArrow(leaf_sizes, "part long, leaf long, n long").groupBy("part", "leaf").agg(F.sum("n").alias("n"))
    # at most parts x 2^depth rows, and only shards that are too large
    chunks = {(r.part, r.leaf): -(-r.n // shard_rows) for r in sizes.where(F.col("n") > shard_rows).collect()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at, y, home in routed(batches):
            chunk = (y * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            large = np.isin(at, [k[1] for k in chunks if k[0] == part])
            rows = [(at[~large], np.zeros((~large).sum(), np.int64), y[~large], home[~large])]
            for leaf in np.unique(at[large]).tolist():
                here, c = at == leaf, chunks[part, leaf]
                own = (chunk[here] % np.uint64(c)).astype(np.int64)
                for other in range(c):  # block own x other, named by its smaller number first
                    low, high = np.minimum(own, other), np.maximum(own, other)
                    rows.append((at[here], low * c + high, y[here], home[here]))
            leaf, block, y, home = (np.concatenate(c) for c in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), part)), pa.array(leaf), pa.array(block), pa.array(y.view(np.int64)), pa.array(home)], names=["part", "leaf", "block", "fp", "home"])

    def compare(group: pa.Table) -> pa.Table:
        y, home = group["fp"].to_numpy().view(np.uint64), group["home"].to_numpy()
        a, b = links(y[home], y[~home], masks[group["part"][0].as_py()], reach, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.mapInArrow(deal, "part long, leaf long, block long, fp long, home boolean")
    return dealt.groupBy("part", "leaf", "block").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42, radius: int = 4, **options) -> DataFrame:
    """(_doc, _text_key, fp, _root, component_id) of every row of ``docs``."""
    prints = cut(fingerprints(docs, key, text, shingle, seed))
    distinct = cut(prints.groupBy("fp").agg(F.min("_doc").alias("_least"), F.count("*").alias("_n")))
    pairs = near_links(distinct.select("fp"), radius, **options)
    labels = connected_components(pairs)
    joined = distinct.join(labels.hint("merge"), distinct["fp"] == labels["node"], "left")
    rooted = cut(joined.select("fp", "_least", "_n", F.coalesce("component", "fp").alias("_root")))
    least = cut(rooted.groupBy("_root").agg(F.min("_least").alias("component_id"), F.count("*").alias("_prints"), F.sum("_n").alias("_all")))
    total = least.agg(F.coalesce(F.sum("_prints"), F.lit(0)), F.coalesce(F.sum("_all"), F.lit(0))).first()
    # a component of very many fingerprints, a fingerprint of very many documents
    classes = cut(join_split(rooted.select("fp", "_n", "_root"), least.drop("_all"), ["_root"], "_prints", ["fp"], total[0]))
    return join_split(prints, classes, ["fp"], "_n", ["_doc", "_text_key"], total[1]).select("_doc", "_text_key", "fp", "_root", "component_id")


def fingerprint_text(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def duplicate_report(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id."""
    found = near_duplicates(docs, key, text, **options)
    return found.select(F.col("_doc").alias(key), fingerprint_text().alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The document with the smallest id of each component, all columns.

    Of rows that share that id (or of null ids) the one with the smallest text key
    stays; further copies of it go.
    """
    return first_of_each(docs, near_duplicates(docs, key, text, **options), key, text)


def first_of_each(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, given the component of every row."""
    first = found.where(F.col("_doc").eqNullSafe(F.col("component_id"))).groupBy("_root").agg(F.min(F.struct("_doc", "_text_key")).alias("_x"))
    kept = first.select(F.col("_x._doc").alias("_doc"), F.col("_x._text_key").alias("_text_key"))
    flat = docs.select(F.struct("*").alias("_row"), docs[key].cast("long").alias("_doc"), text_key(docs[text]).alias("_text_key"))
    matched = flat.join(kept.hint("merge"), flat["_doc"].eqNullSafe(kept["_doc"]) & (flat["_text_key"] == kept["_text_key"]), "left_semi")
    once = F.row_number().over(Window.partitionBy("_doc", "_text_key").orderBy("_doc")) == 1
    return matched.withColumn("_once", once).where("_once").select("_row.*")
