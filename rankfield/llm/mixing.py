"""Temperature mixing of sources, DataFrame functions only.

With token shares p of the sources, the weights are p^a normalised. The exponent a
in [0, 1] is bisected to the largest value whose entropy reaches ``target_entropy``
(a share of ln(number of sources)) and raised, where needed, to the smallest value
that repeats no source more than ``repetition_limit`` times.

The weights become epochs of each source: its weight times the token budget over
its own tokens. Without a budget the smallest one is taken that uses every document
once, so the largest source has one epoch and none is cut; with a budget a source
may have less than one epoch, which is then a sample of it. A source is dealt into
blocks of about ``block_tokens`` tokens by a hash of the document id. Whole epochs
repeat every block; the last, partial one takes from each block, in permuted order,
the documents whose middle lies within the block's token budget. ``block_order`` is
the place of a block in the permutation of all blocks, ``position`` the place in it.
As documents, the mixture comes in an order that follows the permutation, the uses of
a document evenly apart: use k of n has its block's place moved on by k / n rounds.

Defined results: a null source is a source of its own; null and blank texts have no
tokens; a source without tokens is used once. Rows that agree in id and text are
interchangeable copies. Null ids are dealt by their text. An empty table gives an empty
result.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfield.llm.common import cut, group_key, md5_place, row_name, text_key, word_count

BROADCAST_SOURCES = 100_000
PASSES, LEVELS = 8, 5


def _bisect(shares: DataFrame, value, wanted: float, falls: bool) -> float:
    """Exponent in [0, 1] where ``value(exponent)``, monotone, meets ``wanted``.

    Each pass evaluates the midpoints of several levels in one aggregation.
    """
    low, high, n = 0.0, 1.0, 2**LEVELS
    for _ in range(PASSES):
        grid = [low + (high - low) * k / n for k in range(1, n)]
        tried = shares.withColumn("_a", F.explode(F.array(*[F.lit(a) for a in grid])))
        got = sorted(tried.groupBy("_a").agg(value(F.col("_a")).alias("v")).collect())
        meets = [v >= wanted if falls else v <= wanted for _, v in got]
        # falls: the largest exponent that meets it; otherwise the smallest
        k = sum(meets) if falls else len(meets) - sum(meets)
        low, high = low + (high - low) * k / n, low + (high - low) * (k + 1) / n
    return low if falls else high


def _entropy(exponent: Column) -> Column:
    power = F.pow("_p", exponent)
    return F.ln(F.sum(power)) - F.sum(power * exponent * F.ln("_p")) / F.sum(power)


def source_plan(
    tokens: DataFrame, budget: int | None = None, target_entropy: float | None = 0.95, repetition_limit: float | None = 2.0, block_tokens: int = 200_000
) -> tuple[DataFrame, int]:
    """(plan, number of sources): weight, epochs and blocks of each ``_source``."""
    sums = cut(tokens.groupBy("_source").agg(F.sum("_tokens").alias("_sum")))
    total = sums.agg(F.count("*").alias("sources"), F.count_if(F.col("_sum") > 0).alias("n"), F.sum("_sum").alias("all"), F.max("_sum").alias("most")).first()
    if not total["all"]:
        plan = sums.select("_source", F.lit(None).cast("double").alias("weight"), F.lit(1.0).alias("epochs"), F.lit(1).cast("long").alias("_blocks"))
        return plan, total["sources"]
    shares = sums.withColumn("_p", F.col("_sum") / F.lit(total["all"])).where("_sum > 0")
    most = total["most"] / total["all"]

    def epochs(exponent: Column) -> Column:
        if budget is None:
            return F.pow(F.col("_p") / F.lit(most), exponent - 1)
        return F.pow("_p", exponent - 1) * F.lit(budget / total["all"])

    exponent = 1.0
    if target_entropy is not None and total["n"] > 1:
        exponent = _bisect(shares, _entropy, target_entropy * math.log(total["n"]), falls=True)
    if repetition_limit is not None:
        # without a budget the epochs need no normalisation: the largest source has 1
        def repeats(a: Column) -> Column:
            return F.max(epochs(a)) if budget is None else F.max(epochs(a)) / F.sum(F.pow("_p", a))

        if shares.agg(repeats(F.lit(exponent)).alias("r")).first()["r"] > repetition_limit:
            exponent = max(exponent, _bisect(shares, repeats, repetition_limit, falls=False))
    power = F.lit(round(exponent, 6))
    norm = shares.agg(F.sum(F.pow("_p", power)).alias("z")).first()["z"]
    used = epochs(power) if budget is None else epochs(power) / F.lit(norm)
    planned = sums.withColumn("_p", F.col("_sum") / F.lit(total["all"]))
    plan = planned.select(
        "_source",
        F.when(F.col("_sum") > 0, F.round(F.pow("_p", power) / F.lit(norm), 6)).alias("weight"),
        F.when(F.col("_sum") > 0, F.round(used, 6)).otherwise(F.lit(1.0)).alias("epochs"),
        F.greatest(F.lit(1), F.ceil(F.col("_sum") / F.lit(block_tokens))).cast("long").alias("_blocks"),
    )
    return plan, total["sources"]


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokens: str | None = None, **limits) -> DataFrame:
    """One row for each use of a document: ``_row`` (all its columns) and where it goes.

    ``tokens`` names a column of token counts; without it words are counted.
    """
    count = word_count(docs[text]) if tokens is None else F.coalesce(docs[tokens], F.lit(0)).cast("long")
    flat = docs.select(F.struct("*").alias("_row"), docs[key].alias("_doc"), text_key(docs[text]).alias("_text_key"), group_key(docs[source]).alias("_source"), count.alias("_tokens"))
    plan, sources = source_plan(flat.select("_source", "_tokens"), **limits)
    dealt = flat.join(plan.hint("broadcast" if sources <= BROADCAST_SOURCES else "merge"), "_source")
    name = row_name(F.col("_doc"), F.col("_text_key"))
    dealt = dealt.withColumn("_block", F.pmod(md5_place(name, F.lit("block")), F.col("_blocks")))
    inside = "PARTITION BY _source, _block ORDER BY _place, _doc, _tokens, _text_key"
    dealt = dealt.withColumn("_place", md5_place(name, F.lit("place")))
    dealt = dealt.withColumn("_before", F.expr(f"sum(_tokens) OVER ({inside} ROWS UNBOUNDED PRECEDING) - _tokens"))
    dealt = dealt.withColumn("_all", F.expr("sum(_tokens) OVER (PARTITION BY _source, _block)"))
    dealt = dealt.withColumn("position", F.expr(f"row_number() OVER ({inside})").cast("long"))
    part = F.col("epochs") - F.floor("epochs")
    uses = F.floor("epochs") + F.when(F.col("_before") + F.col("_tokens") / 2 < part * F.col("_all"), 1).otherwise(0)
    used = dealt.withColumn("_uses", uses.cast("long")).where("_uses > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_uses") - 1)))
    return used.select(
        "_row", "_doc", F.col("_row")[source].alias("_name"), F.col("_tokens").alias("n_tokens"), "weight", "epoch", F.col("_block").alias("block"),
        md5_place(F.col("_source"), F.col("_block"), F.col("epoch")).alias("block_order"), "position", ((F.col("epoch") + md5_place(F.col("_source"), F.col("_block")) / F.lit(float(1 << 60))) / F.col("_uses")).alias("_turn"),
    )


def mixed_order(docs: DataFrame, key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mixture as ids: key, source, n_tokens, weight, epoch, block, block_order, position."""
    mixed = mix_sources(docs, key=key, source=source, **options)
    return mixed.select(F.col("_doc").alias(key), F.col("_name").alias(source), "n_tokens", "weight", "epoch", "block", "block_order", "position")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as documents: the input's columns, a row for each use, in its order."""
    return mix_sources(docs, **options).orderBy("_turn", "block_order", "position").select("_row.*")
