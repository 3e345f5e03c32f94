"""What each of several document filters removes, alone and in every order.

A document has a mask of the filters that it fails. A part (a source) is then only a
count for each of the 2^n masks, its cells, and every order's steps follow from how many
documents survive each subset of the filters. A Gray-code walk visits the subsets,
toggling one filter at a time: each cell keeps the number of active filters that it
fails, and the running survivors change by the cells whose number leaves or reaches zero.
The survivors of all subsets are stored; a step of an order is the difference of two.

The filters are SQL conditions on the text, but for one: a document fails ``E`` if a row
with a smaller id has the same text, told by SHA-256. Copies are counted by (text, part)
before they meet, so a text with millions of copies is as many rows as it has parts.

Defined results: a null text is empty, a null part the empty string. A null id has no
label, is no smaller than another and none is smaller than it. Rows are counted as often
as they occur. Of several labels of one id one that says good, or toxic, suffices; null
labels say nothing. An empty table gives an empty result.
"""

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfield.llm.common import let, stored, words_of

FILTERS = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that a text fails."""
    text = F.coalesce(text, F.lit(""))
    counts = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("d")))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    few = let(counts, lambda c: F.when(c["n"] < 50, 1).otherwise(0) + F.when(100 * c["d"] < 65 * c["n"], 2).otherwise(0))
    return few + F.when(100 * capitals.cast("long") > 5 * F.length(text).cast("long"), 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail just the filters of a mask."""
    rows = docs.select(
        docs[key].cast("long").alias("_doc"), F.coalesce(docs[part], F.lit("")).alias("_part"), F.unhex(F.sha2(F.coalesce(docs[text], F.lit("")), 256)).alias("_text"), text_mask(docs[text]).alias("_mask")
    )
    one = stored(rows.groupBy("_doc", "_part", "_text", "_mask").agg(F.count("*").alias("n")), "audited-rows")
    marks = labels.groupBy(labels[key].cast("long").alias("_doc")).agg(
        F.coalesce(F.max((labels[good] == 1).cast("long")), F.lit(0)).alias("_good"), F.coalesce(F.max((labels[toxic] == 1).cast("long")), F.lit(0)).alias("_toxic")
    )
    marks = marks.where("_doc is not null and _good + _toxic > 0")
    # rows without an id meet no label; in the join they would all meet in one task
    told = one.where("_doc is not null").join(marks.hint("merge"), "_doc", "left").select(*one.columns, F.coalesce(F.col("n") * F.col("_good"), F.lit(0)).alias("good"), F.coalesce(F.col("n") * F.col("_toxic"), F.lit(0)).alias("toxic"))
    told = told.unionAll(one.where("_doc is null").select(*one.columns, F.lit(0).cast("long"), F.lit(0).cast("long")))
    copies = told.groupBy("_text", "_mask", "_part").agg(
        *(F.sum(c).alias(c) for c in ("n", "good", "toxic")),
        F.min(F.when(F.col("_doc").isNotNull(), F.struct("_doc", "n", "good", "toxic"))).alias("_first"),
        F.sum(F.when(F.col("_doc").isNull(), F.col("n")).otherwise(0)).alias("_nameless"),
    )
    least = F.min("_first._doc").over(Window.partitionBy("_text"))  # as many rows of a text as it has parts
    first = F.col("_first._doc") == least
    held = {c: F.coalesce(F.when(first, F.col(f"_first.{c}")), F.lit(0)) for c in ("n", "good", "toxic")}
    held["n"] = held["n"] + F.col("_nameless")
    split = copies.select("_part", "_mask", "n", "good", "toxic", *(x.alias(f"_{c}") for c, x in held.items()))
    both = F.explode(
        F.array(
            F.struct(F.col("_mask").alias("mask"), *(F.col(f"_{c}").alias(c) for c in held)),
            F.struct((F.col("_mask") + 16).alias("mask"), *((F.col(c) - F.col(f"_{c}")).alias(c) for c in held)),
        )
    )
    return split.select(F.col("_part").alias("part"), both.alias("x")).groupBy("part", "x.mask").agg(*(F.sum(f"x.{c}").alias(c) for c in ("n", "good", "toxic")))


def survivors(counts: np.ndarray) -> np.ndarray:
    """``counts`` is (parts, 2^n masks, measures); what survives each subset of the filters, in the same shape."""
    masks = np.arange(counts.shape[1])
    active, running = np.zeros(len(masks), np.int64), counts.sum(axis=1)
    states, subset = np.zeros_like(counts), 0
    states[:, 0] = running
    for step in range(1, len(masks)):
        bit = (step & -step).bit_length() - 1  # the Gray code's next toggle
        subset ^= 1 << bit
        failing = (masks >> bit & 1).astype(bool)
        if subset >> bit & 1:
            running = running - counts[:, failing & (active == 0)].sum(axis=1)
            active[failing] += 1
        else:
            active[failing] -= 1
            running = running + counts[:, failing & (active == 0)].sum(axis=1)
        states[:, subset] = running
    return states


def order_steps(counts: np.ndarray, filters: str = FILTERS) -> tuple[list[str], list[int], np.ndarray]:
    """(orders, steps, values): every order of the filters, its steps, and (parts, rows, COUNTS) of them."""
    states, orders = survivors(counts), ["".join(p) for p in permutations(filters)]
    bit = {f: 1 << i for i, f in enumerate(filters)}
    masks = np.arange(counts.shape[1])
    fails = np.stack([counts[:, (masks & b) > 0, 0].sum(axis=1) for b in bit.values()], axis=1)
    alone = np.stack([counts[:, b, 0] for b in bit.values()], axis=1)
    before = np.array([sum(bit[f] for f in o[:i]) for o in orders for i in range(len(o))])
    which = np.array([filters.index(f) for o in orders for f in o])
    after = before | 1 << which
    lost = states[:, before] - states[:, after]
    shapley = np.stack([lost[:, which == i, 0].sum(axis=1) for i in range(len(filters))], axis=1)
    values = np.stack([states[:, after, 0], lost[:, :, 0], fails[:, which] - lost[:, :, 0], alone[:, which], lost[:, :, 1], lost[:, :, 2], shapley[:, which]], axis=2)
    return [o for o in orders for _ in o], [i + 1 for o in orders for i in range(len(o))], values


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """part, filter_order, step and COUNTS: a row for each part, order of the filters and step."""
    found = cells(docs, labels, **columns)
    by_part = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2^n at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((batch.num_rows, 1 << len(FILTERS), 3), np.int64)
            for i, own in enumerate(batch.column(1).to_pylist()):
                for c in own:
                    counts[i, c["mask"]] = c["n"], c["good"], c["toxic"]
            orders, steps, values = order_steps(counts)
            for i, name in enumerate(batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(steps), pa.string()), pa.array(orders), pa.array(steps, pa.int32()), *(pa.array(values[i, :, k]) for k in range(len(COUNTS)))], names=["part", "filter_order", "step", *COUNTS]
                )

    return by_part.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
