"""Length buckets that minimise padding, and token-budget batches inside them.

Texts longer than ``max_tokens`` are cut into pieces of that length, so the global
length histogram has at most ``max_tokens`` + 1 entries however large the corpus is;
only it reaches the driver. Dynamic programming over it finds the bucket boundaries
with the least padding exactly. Inside a bucket the pieces are numbered in a hashed
order, or in the order of the rows in their Parquet files (``follow``; rows that are not
in files are written first; files go by the number in their names, those without one
first, by a hash of their paths), and every batch takes as many as fit the token budget at
the padded length.

Numbering needs no global sort: pieces are dealt into shards, numbered there, and
moved on by the counts of the shards before. A shard is a range of hashes, or of rows
of one file.

Defined results: null and blank texts are one piece of 0 tokens; repeated rows are
packed each; an empty table gives an empty result.
"""

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfield.llm.common import cut, md5_place, row_name, stored, text_key, word_count

BROADCAST_ROWS = 200_000


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    ``lengths`` ascend; the last is always a bound. A bucket pads to its bound.
    """
    n = len(lengths)
    at = np.asarray(lengths, dtype=np.float64)
    upto = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=np.float64))])
    # the lengths themselves are the same in total for every choice: minimise the padded size
    cost = at * upto[1:]
    back = []
    for _ in range(min(buckets, n) - 1):
        best, pick = cost.copy(), np.full(n, -1)
        for j in range(1, n):
            split = cost[:j] + at[j] * (upto[j + 1] - upto[1 : j + 1])
            i = int(split.argmin())
            if split[i] < best[j]:
                best[j], pick[j] = split[i], i
        cost = best
        back.append(pick)
    bounds, j = [lengths[-1]], n - 1
    for pick in reversed(back):
        if pick[j] >= 0:
            j = int(pick[j])
            bounds.append(lengths[j])
    return bounds[::-1]


def _in_files(docs: DataFrame) -> bool:
    """Whether the rows know their place in a Parquet file."""
    try:
        return bool(docs.select(docs.metadataColumn("_metadata")["row_index"]).columns)
    except AnalysisException:
        return False


def _stored_at(docs: DataFrame, follow: bool) -> dict[str, Column]:
    """Where rows lie: the number in the file's name (-1: it has none), a hash of its path, and the row's number in the file."""
    if not follow:
        return {c: F.lit(0).cast("long") for c in ("_file", "_path", "_index")}
    at = docs.metadataColumn("_metadata")
    number = F.nullif(F.regexp_extract(at["file_name"], r"part-(\d{1,18})", 1), F.lit(""))
    return {"_file": F.coalesce(number.cast("long"), F.lit(-1).cast("long")), "_path": F.xxhash64(at["file_path"]), "_index": at["row_index"]}


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokens: str | None = None, buckets: int = 8, max_tokens: int = 4096, batch_tokens: int = 65_536, shard_rows: int = 20_000, follow: bool = False
) -> DataFrame:
    """One row per piece: key, piece, start_token, n_tokens, bucket, padded_tokens, batch, slot.

    ``tokens`` names a column of token counts; without it words are counted.
    ``batch`` counts from 0 inside its bucket, ``slot`` inside its batch.
    """
    if follow and not _in_files(docs):
        docs = stored(docs, "rows-in-order")
    count = word_count(docs[text]) if tokens is None else F.coalesce(docs[tokens], F.lit(0)).cast("long")
    rows = docs.select(docs[key].alias("_doc"), text_key(docs[text]).alias("_text_key"), count.alias("_all"), *(c.alias(n) for n, c in _stored_at(docs, follow).items()))
    use = F.expr("row_number() OVER (PARTITION BY _doc, _text_key ORDER BY _all, _file, _path, _index)").cast("long") - 1
    whole = cut(rows.withColumn("_use", use))
    pieces = whole.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_all") / max_tokens).cast("long") - 1, F.lit(0).cast("long")))))
    pieces = pieces.withColumn("_n", F.least(F.lit(max_tokens).cast("long"), F.col("_all") - F.col("_piece") * max_tokens))
    histogram = sorted(pieces.groupBy("_n").count().collect()) or [(0, 0)]
    bounds = best_boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets)

    number, padded = F.lit(len(bounds) - 1), F.lit(bounds[-1])
    for i in range(len(bounds) - 2, -1, -1):
        inside = F.col("_n") <= bounds[i]
        number, padded = F.when(inside, F.lit(i)).otherwise(number), F.when(inside, F.lit(bounds[i])).otherwise(padded)
    shards = max(1, -(-sum(r[1] for r in histogram) // shard_rows))
    # each repeat of a row is placed by its number, so that the uses of a document lie apart
    place = md5_place(row_name(F.col("_doc"), F.col("_text_key")), F.col("_piece"), F.col("_use"))
    shard = F.struct("_file", "_path", (F.floor(F.col("_index") / shard_rows) if follow else F.pmod(place, F.lit(shards).cast("long"))).cast("long").alias("part"))
    order = "_index, _piece" if follow else "_place, _doc, _piece, _text_key"
    pieces = pieces.select("*", number.alias("_bucket"), padded.cast("long").alias("_padded"), place.alias("_place"), shard.alias("_shard"))

    sizes = cut(pieces.groupBy("_bucket", "_shard").agg(F.count("*").alias("_rows")))
    before = sizes.select("_bucket", "_shard", F.expr("sum(_rows) OVER (PARTITION BY _bucket ORDER BY _shard ROWS UNBOUNDED PRECEDING) - _rows").alias("_before"))
    strategy = "broadcast" if sizes.count() <= BROADCAST_ROWS else "merge"
    numbered = pieces.withColumn("_at", F.expr(f"row_number() OVER (PARTITION BY _bucket, _shard ORDER BY {order})") - 1)
    numbered = numbered.join(before.hint(strategy), ["_bucket", "_shard"])
    place_in_bucket = F.col("_before") + F.col("_at")
    in_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(batch_tokens) / F.greatest(F.col("_padded"), F.lit(1).cast("long"))).cast("long"))
    return numbered.select(
        F.col("_doc").alias(key), F.col("_piece").alias("piece"), (F.col("_piece") * max_tokens).alias("start_token"), F.col("_n").alias("n_tokens"), F.col("_bucket").alias("bucket"),
        F.col("_padded").alias("padded_tokens"), F.floor(place_in_bucket / in_batch).cast("long").alias("batch"), F.pmod(place_in_bucket, in_batch).alias("slot"),
    )
