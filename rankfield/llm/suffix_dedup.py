"""Exact removal of repeated byte strings: blockwise suffixes with a difference cover.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (in a
document with a smaller id, or earlier in the same). Matches stay inside documents.

1. Documents that repeat a whole earlier text (by SHA-256) are set aside: every string
   of theirs starts earlier. The others are packed into blocks of a few megabytes.
2. Cover sample. The places whose offset modulo v lies in a difference cover are
   sampled; for any two places i and j some shift below v takes both into the sample.
   So two equal strings of ``length`` bytes share a sampled piece of ``length`` - v + 1
   bytes at the same shift. Only suffixes that start at most v - 1 places before a
   sampled piece which occurs elsewhere are candidates, and of these only the ones stay
   whose whole string seems to occur elsewhere. Both are counted by hashes. A hash that
   two strings share by chance costs work here and changes no result.
3. Suffix buckets. A suffix belongs to the bucket of the smallest hash among the
   16-byte grams of its string, a property that neighbours share. So a run of suffixes
   travels as one piece of text, and equal runs as one. Buckets have a few megabytes
   each, whatever the corpus: the runs of a gram with more text than a bucket are cut
   again by a smallest hash of another kind, and after ``LEVELS`` cuts into single
   strings, which Spark's aggregation tells apart without any group. A bucket is sorted
   in byte order: by the first 16 bytes,
   then long ties are resolved by the ranks of the bucket's own cover sample, and where
   these differ the next bytes are read. Equality is decided by bytes.
4. The first of equal strings in document order stays, the others are later. The bytes
   that the later strings cover are removed.

A block sends each hash and each run once, however often it holds them, and Spark
combines the runs of the blocks, so a string repeated a million times is no hot group.
A block is as large as its longest text at least; its task needs some twenty times that.

Defined results: a null text is empty; a null id comes before all others; rows that
agree in id and text are one document and get the same result; rows that share only
the id are ordered by the key of their text. Texts shorter than ``length`` lose nothing.
An empty table gives an empty result.
"""

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfield.llm.common import join_split, stored, text_key

COVER_MODULUS = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)  # fixed values: a perfect difference set modulo 57
BLOCK_BYTES = 4 << 20
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15
GRAM = 16
LONGEST_RUN = 4_096
LEVELS = 3


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    return np.cumprod(np.full(CHUNK, BASE, np.uint64)), np.cumprod(np.full(CHUNK, pow(BASE, -1, 1 << 64), np.uint64))


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    """A random value for each byte."""
    return np.random.default_rng(20).integers(1, 1 << 64, 256, np.uint64)


def _hashes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the strings of ``length`` bytes at the ascending places ``at``."""
    up, down = _powers()
    out, step = np.empty(len(at), np.uint64), CHUNK - length
    for start in range(0, len(data), step):
        a, b = np.searchsorted(at, (start, start + step))
        if a == b:
            continue
        part = data[start : start + CHUNK]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_values()[part] * up[: len(part)], out=sums[1:])
        x = at[a:b] - start
        out[a:b] = (sums[x + length] - sums[x]) * down[x]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def _covered(offset: np.ndarray) -> np.ndarray:
    return np.isin(np.arange(COVER_MODULUS), COVER)[offset % COVER_MODULUS]


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """A shift that takes places of two residues into the cover."""
    inside = np.isin(np.arange(2 * COVER_MODULUS), [c + k for c in COVER for k in (0, COVER_MODULUS)])
    r = np.arange(COVER_MODULUS)
    both = inside[r[:, None, None] + r] & inside[r[None, :, None] + r]
    return both.argmax(axis=2)


def _samples(starts: np.ndarray, lengths: np.ndarray, piece: int) -> np.ndarray:
    """Places of the cover sample whose piece lies inside its document, ascending."""
    cover = np.array(COVER)
    per = np.maximum(0, lengths - piece + COVER_MODULUS) // COVER_MODULUS  # an upper bound
    doc = np.repeat(np.arange(len(starts)), per)
    step = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    offset = (step[:, None] * COVER_MODULUS + cover).ravel()
    doc = np.repeat(doc, len(COVER))
    inside = offset <= lengths[doc] - piece
    return starts[doc[inside]] + offset[inside]


def _candidates(starts: np.ndarray, lengths: np.ndarray, samples: np.ndarray, piece: int, length: int) -> np.ndarray:
    """Places of the strings of ``length`` bytes that hold one of the ``samples``."""
    doc = np.searchsorted(starts, samples, side="right") - 1
    low = np.maximum(samples - (length - piece), starts[doc])
    high = np.minimum(samples, starts[doc] + lengths[doc] - length)
    edge = np.zeros(int(starts[-1] + lengths[-1]) + 2 if len(starts) else 1, np.int32)
    ok = high >= low
    np.add.at(edge, low[ok], 1)
    np.add.at(edge, high[ok] + 1, -1)
    return np.flatnonzero(np.cumsum(edge, dtype=np.int32) > 0)


def _layout(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array(lengths, np.int64)
    return np.cumsum(size) - size, size


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents in ascending id order; empty texts need no block."""
    from pyspark import TaskContext

    number, rows, size = TaskContext.get().partitionId() << 32, [], 0

    def block(rows: list) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        columns = [pa.array([number], pa.int64()), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), pa.array([[r[1] for r in rows]], pa.list_(pa.int64()))]
        texts = [pa.array([[len(r[2]) for r in rows]], pa.list_(pa.int64())), pa.array([b"".join(r[2] for r in rows)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns + texts, names=["block", "ids", "keys", "sizes", "data"])

    for batch in batches:
        for doc, key, text in zip(*batch.columns, strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            if data:
                rows.append((doc.as_py(), key.as_py(), data))
                size += len(data)
            if size >= BLOCK_BYTES or len(rows) == 1 << 16:
                yield block(rows)
                number, rows, size = number + 1, [], 0
    if rows:
        yield block(rows)


BLOCK_SCHEMA = "block long, ids array<long>, keys array<long>, sizes array<long>, data binary"


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
            starts, lengths = _layout(row["sizes"].as_py())
            yield row, starts, lengths, np.frombuffer(row["data"].as_buffer(), np.uint8)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are equal ranges of the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each bucket that occurs, and its stretch of the ascending ``bucket``."""
    found, start = np.unique(bucket, return_index=True)
    for b, x, y in zip(found.tolist(), start.tolist(), [*start[1:].tolist(), len(bucket)], strict=True):
        yield b, slice(x, y)


def _sampled(row: dict, starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    return _samples(starts, lengths, size)


def _chosen(row: dict, starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    return np.flatnonzero(_flags(row["chosen"].as_buffer(), int(lengths.sum())))


def _hash_entries(places, buckets: int, size: int):
    """Each distinct hash of a block's ``places``: (bucket, block, 32 bits of the hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, starts, lengths, data in _each_block(batches):
            hashes = np.unique(_hashes(data, places(row, starts, lengths, size), size))
            found = [(b, hashes[s].astype("<u4").tobytes()) for b, s in _by_bucket(_bucket(hashes, buckets))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([row["block"].as_py()] * len(found), pa.int64()), pa.array([f[1] for f in found], pa.binary())], names=["bucket", "block", "hashes"])

    return run


def _elsewhere(group: pa.Table) -> pa.Table:
    """A bit for each hash of a block in one bucket: another block has it too."""
    parts = [np.frombuffer(x.as_buffer(), "<u4") for x in group["hashes"].combine_chunks()]
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    twin = np.zeros(len(every) + 1, bool)
    twin[1:-1] = ranked[1:] == ranked[:-1]
    shared = np.empty(len(every), bool)
    shared[order] = twin[1:] | twin[:-1]
    ends = np.cumsum([len(p) for p in parts])
    bits = [_bits(shared[e - len(p) : e]) for p, e in zip(parts, ends, strict=True)]
    return pa.table({"bucket": group["bucket"], "block": group["block"], "bits": pa.array(bits, pa.binary())})


def _keep_shared(places, buckets: int, size: int, widen):
    """Blocks with the documents that hold shared places, and these marked in ``chosen``.

    ``widen`` makes the marked places of the shared ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, starts, lengths, data in _each_block(batches):
            at = places(row, starts, lengths, size)
            hashes, place, times = np.unique(_hashes(data, at, size), return_inverse=True, return_counts=True)
            shared = times > 1
            answers = {a["bucket"]: a["bits"] for a in row["answers"].as_py()} if row["answers"].is_valid else {}
            for b, s in _by_bucket(_bucket(hashes, buckets)):
                if b in answers:
                    shared[s] |= _flags(answers[b], s.stop - s.start)
            chosen = np.zeros(len(data), bool)
            chosen[widen(starts, lengths, at[shared[place]])] = True
            if not chosen.any():
                continue
            keep = np.array([chosen[a : a + n].any() for a, n in zip(starts, lengths, strict=True)])
            inside = np.repeat(keep, lengths)
            lists = [[x for x, k in zip(row[c].as_py(), keep, strict=True) if k] for c in ("ids", "keys", "sizes")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["block"].as_py()]), *[pa.array([x], pa.list_(pa.int64())) for x in lists], pa.array([data[inside].tobytes()], pa.binary()), pa.array([_bits(chosen[inside])], pa.binary()), pa.array([int(chosen.sum())], pa.int64())],
                names=["block", "ids", "keys", "sizes", "data", "chosen", "n_chosen"],
            )

    return run


def _least_gram(data: np.ndarray, at: np.ndarray, length: int, level: int = 0) -> np.ndarray:
    """Smallest 32-bit hash of the grams of the string at each place; each ``level`` hashes in its own way."""
    if not len(at):
        return np.empty(0, np.uint32)
    words = np.ndarray(len(data) - 7, "<u8", data.tobytes(), strides=(1,))
    mixed = words[: len(data) - 15] * np.uint64(BASE) ^ (words[8:] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= np.uint64(level * 0xA0761D6478BD642F % (1 << 64))
    mixed ^= mixed >> np.uint64(29)
    least, width, window = (mixed * np.uint64(BASE) >> np.uint64(32)).astype(np.uint32), 1, length - GRAM + 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[at], least[at + window - width])


def _runs(row: dict, starts: np.ndarray, lengths: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(places, first place of each run, its number of places, its gram hash, its text)."""
    at = _chosen(row, starts, lengths, length)
    least = _least_gram(data, at, length)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (least[1:] != least[:-1])
    begin = np.flatnonzero(new)
    new |= (np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % LONGEST_RUN == 0
    begin = np.flatnonzero(new)
    size, raw = np.diff(np.append(begin, len(at))), data.tobytes()
    texts = [raw[a : a + n + length - 1] for a, n in zip(at[begin].tolist(), size.tolist(), strict=True)]
    return at, begin, size, least[begin], texts


RUN_COLUMNS = ["gram", "id", "key", "offset", "block", "run", "skip", "text"]
RUN_SCHEMA = "gram long, id long, key long, offset long, block long, run long, skip long, text binary"


def _run_entries(length: int):
    """Each distinct run of a block at its first place, with its number among the runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, starts, lengths, data in _each_block(batches):
            at, begin, _, least, texts = _runs(row, starts, lengths, data, length)
            first: dict[bytes, int] = {}
            for k, t in enumerate(texts):
                first.setdefault(t, k)
            mine = np.fromiter(first.values(), np.int64, len(first))
            doc = np.searchsorted(starts, at[begin[mine]], side="right") - 1
            ids, keys = (row[c].values.take(pa.array(doc)) for c in ("ids", "keys"))
            columns = [pa.array(least[mine].astype(np.int64)), ids, keys, *map(pa.array, (at[begin[mine]] - starts[doc], np.full(len(mine), row["block"].as_py(), np.int64), mine, np.zeros(len(mine), np.int64)))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(first), pa.binary())], names=RUN_COLUMNS)

    return run


def _cut_runs(length: int, level: int):
    """Each run cut where the smallest hash of ``level`` changes; past ``LEVELS``, at every place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
                raw = row["text"].as_py()
                at = np.arange(len(raw) - length + 1)
                least = _least_gram(np.frombuffer(raw, np.uint8), at, length, level) if level <= LEVELS else at
                begin = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
                size = np.diff(np.append(begin, len(at)))
                texts = [raw[a : a + n + length - 1] for a, n in zip(begin.tolist(), size.tolist(), strict=True)]
                same = {c: pa.array([row[c].as_py()] * len(begin), pa.int64()) for c in ("id", "key", "block", "run")}
                moved = {c: pa.array(begin + row[c].as_py()) for c in ("offset", "skip")}
                columns = {**same, **moved, "gram": pa.array(least[begin].astype(np.int64)), "text": pa.array(texts, pa.binary())}
                yield pa.RecordBatch.from_arrays([columns[c] for c in RUN_COLUMNS], names=RUN_COLUMNS)

    return run


def sort_suffixes(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the places ``at`` in byte order of their strings of ``length`` bytes,
    equal ones in their given order, and where in it a new string begins.

    After the first 16 bytes ties are compared by the ranks of the cover sample and the
    bytes outside the sampled piece. Where a group of ties is not all equal, the next 8
    bytes split it.
    """
    piece = length - COVER_MODULUS + 1
    words = np.ndarray(max(len(data) - 7, 0), ">u8", data.tobytes(), strides=(1,))
    word = lambda places: words[places].astype(np.uint64)
    sample = np.flatnonzero(_covered(np.arange(max(len(data) - piece + 1, 0))))
    rank = np.zeros(len(data), np.int32)
    pieces = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, piece)[sample]) if len(sample) else np.empty((0, piece), np.uint8)
    rank[sample] = np.unique(pieces.view(f"S{piece}").ravel(), return_inverse=True)[1]

    def same(i: np.ndarray, j: np.ndarray, known: int) -> np.ndarray:
        shift = _shifts()[i % COVER_MODULUS, j % COVER_MODULUS]
        ok = rank[i + shift] == rank[j + shift]
        for o in [*range(known, length - 8, 8), length - 8]:
            look = np.flatnonzero(ok & ((o < shift) | (o + 8 > shift + piece)))
            ok[look] = words[i[look] + o] == words[j[look] + o]
        return ok

    order = np.lexsort((word(at + 8), word(at)))
    new = np.ones(len(at), bool)
    x, y = word(at[order]), word(at[order] + 8)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    begin, known = np.flatnonzero(new), 16
    size = np.diff(np.append(begin, len(at)))
    open_ = np.flatnonzero(np.repeat(size > 1, size))
    while len(open_) and known < length:
        group = np.cumsum(new)[open_]  # groups stand together
        lead = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        number = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(open_))))
        equal = same(at[order[open_]], at[order[open_[lead]]][number], known)
        mixed = ~np.logical_and.reduceat(equal, lead)
        left, number = open_[mixed[number]], number[mixed[number]]
        if not len(left):
            break
        value = word(at[order[left]] + min(known, length - 8))
        by = np.lexsort((value, number))
        order[left], value = order[left][by], value[by]
        new[left[1:]] |= (number[1:] == number[:-1]) & (value[1:] != value[:-1])
        known += 8
        begin = np.flatnonzero(np.append(True, new[left[1:]] | (number[1:] != number[:-1])))
        size = np.diff(np.append(begin, len(left)))
        open_ = left[np.repeat(size > 1, size)]
    return order, np.flatnonzero(new)


def _sort_bucket(length: int):
    """For each run of a bucket, a bit for each of its places: the string starts earlier."""

    def run(group: pa.Table) -> pa.Table:
        in_order = pc.sort_indices(group, [(c, "ascending") for c in ("id", "key", "offset")], null_placement="at_start")
        group = group.take(in_order)
        texts = [x.as_buffer() for x in group["text"].combine_chunks()]
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts, sizes = _layout([len(t) for t in texts])
        count = sizes - (length - 1)
        ends = np.cumsum(count)
        at = np.repeat(starts - (ends - count), count) + np.arange(int(ends[-1]))
        order, new = sort_suffixes(data, at, length)
        least = np.minimum.reduceat(order, new)
        later = np.empty(len(at), bool)
        later[order] = order > np.repeat(least, np.diff(np.append(new, len(at))))
        bits = [_bits(later[e - n : e]) for e, n in zip(ends.tolist(), count.tolist(), strict=True)]
        return pa.table({"block": group["block"], "run": group["run"], "skip": group["skip"], "bits": pa.array(bits, pa.binary()), "places": pa.array(count)})

    return run


def _remove(length: int):
    """Per document of a block: bytes and runs removed, hash of the rest, removed runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, starts, lengths, data in _each_block(batches):
            at, begin, *_ = _runs(row, starts, lengths, data, length)
            # a run, or a piece of it, that an earlier place has as well is not answered: all of it is later
            later = np.ones(len(at), bool)
            for a in row["answers"].as_py() or ():
                k = begin[a["run"]] + a["skip"]
                later[k : k + a["places"]] = _flags(a["bits"], a["places"])
            gone_at = at[later]
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, gone_at, 1)
            np.add.at(edge, gone_at + length, -1)
            gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
            raw, ids, keys, out = data.tobytes(), row["ids"].as_py(), row["keys"].as_py(), []
            for k, (a, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
                hit = gone[a : a + n]
                if not hit.any():
                    continue
                turns = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                spans = turns.reshape(-1, 2).tolist()
                kept = b"".join(raw[a + x : a + y] for x, y in zip([0, *[s[1] for s in spans]], [*[s[0] for s in spans], n], strict=True))
                out.append((ids[k], keys[k], int(hit.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["_doc", "_text_key", "_removed", "_spans", "_sha", "spans"])

    return run


def _answered(blocks: DataFrame, answers: DataFrame, *answer: str) -> DataFrame:
    """Blocks with the list of their answers."""
    listed = answers.groupBy("block").agg(F.collect_list(F.struct(*answer, "bits")).alias("answers"))
    return blocks.join(listed.hint("merge"), "block", "left")


def _shared_places(blocks: DataFrame, places, n_places: int, size: int, widen, bucket_entries: int, name: str) -> DataFrame:
    """The blocks' documents with places whose string of ``size`` bytes occurs elsewhere."""
    buckets = max(1, -(-n_places // bucket_entries))
    entries = blocks.mapInArrow(_hash_entries(places, buckets, size), "bucket long, block long, hashes binary")
    answers = stored(entries.groupBy("bucket").applyInArrow(_elsewhere, "bucket long, block long, bits binary"), f"{name}-answers")
    return stored(_answered(blocks, answers, "bucket").mapInArrow(_keep_shared(places, buckets, size, widen), BLOCK_SCHEMA + ", chosen binary, n_chosen long"), name)


def _later(runs: DataFrame, length: int, bucket_bytes: int) -> DataFrame:
    """Which places of the runs, or of pieces of them, hold a string that starts earlier.

    Only the first of equal runs or pieces is answered. Every group has the text of one
    hash range, and no gram in it has more than ``bucket_bytes``.
    """
    place, bytes_ = F.struct("id", "key", "offset", "block", "run", "skip"), F.octet_length("text").cast("long")
    rest, parts = runs, []
    for level in range(1, LEVELS + 2):
        distinct = stored(rest.groupBy("gram", "text").agg(F.min(place).alias("_at")).select("gram", "text", "_at.*"), "suffix-texts")
        grams = stored(distinct.groupBy("gram").agg(F.count("*").alias("_n"), F.sum(bytes_).alias("_bytes")), "suffix-grams")
        sums = grams.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_bytes"), F.lit(0)), F.coalesce(F.max("_bytes"), F.lit(0))).first()
        fitting, hot = distinct, sums[2] > bucket_bytes
        if hot:
            marked = join_split(distinct, grams.where(F.col("_bytes") > bucket_bytes).select("gram", "_n", F.lit(True).alias("_hot")), ["gram"], "_n", ["text"], sums[0], "left")
            marked = stored(marked.select(*RUN_COLUMNS, F.coalesce("_hot", F.lit(False)).alias("_hot")), "suffix-marked")
            fitting, over = marked.where("not _hot"), marked.where("_hot").select(*RUN_COLUMNS)
        dealt = fitting.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(max(1, -(-sums[1] // bucket_bytes))).cast("long")))
        parts.append(dealt.groupBy("bucket").applyInArrow(_sort_bucket(length), "block long, run long, skip long, bits binary, places long"))
        if not hot:
            break
        rest = stored(over.mapInArrow(_cut_runs(length, level), RUN_SCHEMA), "suffix-cut")
    else:
        # single strings: the first of each is not later, all others are not answered
        firsts = rest.groupBy("text").agg(F.min(place).alias("_at"))
        parts.append(firsts.select("_at.block", "_at.run", "_at.skip", F.lit(b"\0").alias("bits"), F.lit(1).cast("long").alias("places")))
    return reduce(DataFrame.unionAll, parts)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, bucket_entries: int = 500_000, bucket_bytes: int = 4_000_000, copy_broadcast: int = 2_000_000) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256, spans (byte runs removed) of every document."""
    piece = length - COVER_MODULUS + 1
    if not COVER_MODULUS + 15 <= length < CHUNK // 2:
        raise ValueError(f"length must be from {COVER_MODULUS + 15} to {CHUNK // 2}")
    body = F.coalesce(docs[text], F.lit(""))
    whole = docs.select(docs[key].cast("long").alias("_doc"), text_key(body).alias("_text_key"), body.alias("_text"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("_all"))
    names = stored(whole.drop("_text"), "suffix-names")
    total = names.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")).first()
    seen = names.where(f"n_bytes >= {length}").groupBy("_all").agg(F.min(F.struct(F.col("_doc").isNotNull().alias("_set"), "_doc")).alias("_first"), F.count("*").alias("_n"))
    known = join_split(names.select("_doc", "_text_key", "_all"), stored(seen.where("_n > 1"), "suffix-texts"), ["_all"], "_n", ["_doc"], total.n)
    # rows that repeat an earlier text, or a row: both are few, or joined by key
    copies = stored(known.where(F.struct(F.col("_doc").isNotNull(), F.col("_doc")) > F.col("_first")).select("_doc", "_text_key").distinct(), "suffix-copies")
    repeats = stored(names.groupBy("_doc", "_text_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_doc", "_text_key"), "suffix-repeats")
    same = lambda a, b: a["_doc"].eqNullSafe(b["_doc"]) & (a["_text_key"] == b["_text_key"])
    few = lambda n: "broadcast" if n <= copy_broadcast else "merge"

    long = whole.where(f"n_bytes >= {length}").select("_doc", "_text_key", "_text")
    firsts = long.join(copies.hint(few(copies.count())), same(long, copies), "left_anti")
    n_repeats = repeats.count()
    if n_repeats:
        again = firsts.join(repeats.hint(few(n_repeats)), same(firsts, repeats), "left_semi").dropDuplicates(["_doc", "_text_key"])
        firsts = firsts.join(repeats.hint(few(n_repeats)), same(firsts, repeats), "left_anti").unionAll(again)
    blocks = stored(firsts.select("_doc", "_text_key", F.col("_text").cast("binary").alias("_text")).mapInArrow(_pack, BLOCK_SCHEMA), "suffix-blocks")

    samples = total.bytes * len(COVER) // COVER_MODULUS
    marked = _shared_places(blocks, _sampled, samples, piece, lambda starts, lengths, at: _candidates(starts, lengths, at, piece, length), bucket_entries, "suffix-candidates")
    held = marked.agg(F.coalesce(F.sum("n_chosen"), F.lit(0))).first()[0]
    shared = _shared_places(marked, _chosen, held, length, lambda starts, lengths, at: at, bucket_entries, "suffix-shared")

    runs = stored(shared.mapInArrow(_run_entries(length), RUN_SCHEMA), "suffix-runs")
    later = stored(_later(runs, length, bucket_bytes), "suffix-later")
    losses = stored(_answered(shared, later, "run", "skip", "places").mapInArrow(_remove(length), "_doc long, _text_key long, _removed long, _spans long, _sha string, spans array<array<long>>"), "suffix-losses")

    gone = copies.withColumn("_copy", F.lit(True))
    every = names.join(gone.hint("merge"), same(names, gone), "left").select(names["*"], "_copy")
    every = every.join(losses.hint("merge"), same(every, losses), "left").select(every["*"], "_removed", "_spans", "_sha", "spans")
    copy = F.coalesce("_copy", F.lit(False))
    return every.select(
        F.col("_doc").alias(key), "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_sha", "_all")).alias("kept_sha256"),
        F.when(copy, F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))).otherwise(F.coalesce("spans", F.array().cast("array<array<bigint>>"))).alias("spans"),
    )
