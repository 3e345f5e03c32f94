"""Intent groups: a page split by meaning, and each group described."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfield.functions import text as tx

SIMILARITY = 0.50
# Words that name no meaning: fixed values.
STOP_WORDS = ("the", "and", "for", "app", "apps", "free", "pro", "to", "my", "your", "with", "of", "in", "on", "a", "best", "new", "phone", "mobile")


def page_similarity(members: DataFrame) -> DataFrame:
    """Inner product of every pair of apps on a page; ``members`` has unit vectors."""
    a = members.select("keyword", F.col("pkg").alias("a"), F.col("slot").alias("sa"), F.col("vector").alias("va"))
    b = members.select("keyword", F.col("pkg").alias("b"), F.col("slot").alias("sb"), F.col("vector").alias("vb"))
    return a.join(b, "keyword").where("sa < sb").select("keyword", "a", "b", tx.dot(F.col("va"), F.col("vb")).alias("similarity"))


def average_linkage(vectors: np.ndarray, cutoff: float) -> np.ndarray:
    """Group number of each row; the closest two groups merge while their mean
    similarity reaches the cutoff, the earlier pair on ties.

    Means of merged groups follow from the sums, so each merge is one row update.
    """
    sums = (vectors @ vectors.T).astype(np.float64)
    size = np.ones(len(vectors))
    label = np.arange(len(vectors))
    alive, below = np.ones(len(vectors), bool), np.tril_indices(len(vectors))
    while alive.sum() > 1:
        mean = sums / np.outer(size, size)
        mean[~alive] = mean[:, ~alive] = -np.inf
        mean[below] = -np.inf
        best = int(mean.argmax())
        a, b = divmod(best, len(vectors))
        if mean[a, b] < cutoff:
            break
        sums[a] += sums[b]
        sums[:, a] += sums[:, b]
        size[a] += size[b]
        label[label == b] = a
        alive[b] = False
    return label


def cluster_pages(members: DataFrame, cutoff: float = SIMILARITY) -> DataFrame:
    """(keyword, pkg, group): pages in parallel, at most 250 apps each; groups are
    numbered by their best slot from 0. Fewer than three apps are one group."""

    def split(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("slot")
        label = np.zeros(len(page), int) if len(page) < 3 else average_linkage(np.stack(page["vector"].to_numpy()).astype(np.float64), cutoff)
        order = {g: i for i, g in enumerate(dict.fromkeys(label.tolist()))}
        return pd.DataFrame({"keyword": page["keyword"], "pkg": page["pkg"], "group": [order[g] for g in label.tolist()]})

    return members.select("keyword", "pkg", "slot", "vector").groupBy("keyword").applyInPandas(split, "keyword string, pkg string, group int")


def describe_groups(rows: DataFrame) -> DataFrame:
    """Size, ranks, installs and newcomers of each (keyword, group)."""
    recent = (F.col("days") > 0) & (F.col("age") <= 1.0)
    weakest = F.min(F.struct("installs", "slot", "title"))
    ordered = F.array_sort(F.collect_list(F.struct("slot", "pkg", "title")))
    return rows.groupBy("keyword", "group").agg(
        F.count("*").alias("size"), F.min("slot").alias("best_rank"), F.percentile("installs", 0.5).cast("long").alias("median_installs"),
        weakest["installs"].alias("weakest_installs"), weakest["slot"].alias("weakest_rank"), weakest["title"].alias("weakest_title"),
        F.count_if(recent).alias("newcomers"), F.coalesce(F.max(F.when(recent, F.col("installs"))), F.lit(0)).alias("newcomer_installs"),
        F.transform(ordered, lambda x: x["pkg"]).alias("packages"), F.slice(F.transform(ordered, lambda x: x["title"]), 1, 4).alias("titles"),
    )


def label_groups(rows: DataFrame) -> DataFrame:
    """Up to three title words that enough members share; else 'mixed'."""
    sizes = rows.groupBy("keyword", "group").agg(F.count("*").alias("size"))
    words = rows.select("keyword", "group", F.explode(F.array_distinct(tx.tokens(F.col("title")))).alias("w")).where((F.length("w") > 2) & ~F.col("w").isin(*STOP_WORDS))
    counts = words.groupBy("keyword", "group", "w").agg(F.count("*").alias("n"))
    top = counts.withColumn("_r", F.row_number().over(Window.partitionBy("keyword", "group").orderBy(F.desc("n"), "w"))).where("_r <= 3")
    need = F.when(F.col("size") <= 2, 1).otherwise(F.greatest(F.lit(2), F.floor(F.col("size") / 2)))
    named = sizes.join(top.hint("merge"), ["keyword", "group"], "left").groupBy("keyword", "group", "size").agg(F.array_sort(F.collect_list(F.when(F.col("n") >= need, F.struct("_r", "w")))).alias("_w"))
    return named.select("keyword", "group", F.when(F.size("_w") > 0, F.array_join(F.transform("_w", lambda x: x["w"]), " / ")).otherwise("mixed").alias("label"))


def group_affinity(rows: DataFrame, keywords: DataFrame) -> DataFrame:
    """Inner product of the keyword's vector with each group's normalised mean vector."""
    cells = rows.select("keyword", "group", F.posexplode("vector").alias("i", "x")).groupBy("keyword", "group", "i").agg(F.avg("x").alias("m"))
    keyed = keywords.select("keyword", F.posexplode("keyword_vector").alias("i", "k"))
    sums = cells.join(keyed.hint("merge"), ["keyword", "i"]).groupBy("keyword", "group").agg(F.sum(F.col("m") * F.col("k")).alias("_d"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("_n"))
    return sums.select("keyword", "group", (F.col("_d") / (F.col("_n") + 1e-9)).alias("affinity"))


def group_for(apps: DataFrame, membership: DataFrame) -> DataFrame:
    """An app's own group if it is ranked, otherwise the group at the top of the page."""
    return apps.join(membership.hint("merge"), ["keyword", "pkg"], "left").withColumn("group", F.coalesce("group", F.lit(0)))


def intent_stats(slots: DataFrame, membership: DataFrame, top_n: int = 10) -> DataFrame:
    """Rivals, installs, reach and share of each ranked app's own group."""
    rows = slots.join(membership.hint("merge"), ["keyword", "pkg"])
    groups = describe_groups(rows).select("keyword", "group", "size", "best_rank", "median_installs", "weakest_installs")
    pages = slots.groupBy("keyword").agg(F.least(F.count("*") - 1, F.lit(top_n)).alias("_n"))
    joined = rows.select("keyword", "pkg", "group").join(groups, ["keyword", "group"]).join(pages, "keyword")
    n = F.greatest("_n", F.lit(1))
    return joined.select("keyword", F.col("pkg").alias("own_pkg"), (F.col("size") - 1).alias("intent_rivals"), F.col("median_installs").alias("intent_median"), F.col("weakest_installs").alias("intent_weakest"), (1.0 - (F.col("best_rank") - 1) / n).alias("intent_reach"), (F.col("size") / n).alias("intent_share"))


def outside_stats(slots: DataFrame, membership: DataFrame, entrants: DataFrame, top_n: int = 10) -> DataFrame:
    """``intent_stats`` of apps that are not on the page: all of their group are rivals.

    ``entrants`` has (keyword, pkg, group), from ``group_for``.
    """
    found = describe_groups(slots.join(membership.hint("merge"), ["keyword", "pkg"])).select("keyword", "group", "size", "best_rank", "median_installs", "weakest_installs")
    pages = slots.groupBy("keyword").agg(F.greatest(F.least(F.count("*"), F.lit(top_n)), F.lit(1)).alias("_n"))
    joined = entrants.select("keyword", "pkg", "group").join(found.hint("merge"), ["keyword", "group"]).join(pages.hint("merge"), "keyword")
    return joined.select("keyword", F.col("pkg").alias("own_pkg"), F.col("size").alias("intent_rivals"), F.col("median_installs").alias("intent_median"), F.col("weakest_installs").alias("intent_weakest"), (1.0 - (F.col("best_rank") - 1) / F.col("_n")).alias("intent_reach"), (F.col("size") / F.col("_n")).alias("intent_share"))


def ambiguous_pages(membership: DataFrame) -> DataFrame:
    return membership.groupBy("keyword").agg(F.count_distinct("group").alias("groups")).where("groups > 1")
