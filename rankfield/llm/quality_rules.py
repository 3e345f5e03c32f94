"""Quality rules: cross-document line frequency, DataFrame functions only.

Each line is normalised (ASCII lower case, digits to 0, white space runs to one
space, ends trimmed) and hashed, once. For each host the distinct documents that hold
a line are counted; a line is over the limit where that count exceeds
``min_documents`` and ``max_share`` of the host's documents, or ``max_documents``
alone, so that a large host has no higher limit than that. Such lines are removed, and
a document that loses more than ``max_removed`` of its words is rejected as depleted.

The lines over the limit are broadcast while they are counted to be few
(``broadcast_lines``); beyond that they are joined by host and line, a line of many
rows being dealt over several tasks.

Defined results: a null text has no words, a null host is a host of its own. Rows
that agree in id, host and text are one document and get the same result. A text that
loses lines keeps its other lines with a word. Lines without a word are never counted.
An empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfield.llm.common import SPACE_RUN, SPACES, cut, group_key, join_split, let, stored, text_key, words_of

SYMBOLS = "#*$%&|<>"
FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789"
TO = "abcdefghijklmnopqrstuvwxyz000000000"
ROW_KEY = ["_doc", "_text_key", "_host"]
BROADCAST_LINES = 200_000


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """Words lying in a window of ``width`` words that the array holds twice or more.

    Windows are told apart by a 64-bit hash. Sorting (hash, place) keeps the work at
    n log n for any text, also for one that repeats a single word.
    """
    window = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)])
    places = F.sequence(F.lit(0), F.size(words) - width)

    def covered(ranked: Column) -> Column:
        same = lambda s, i, step: F.coalesce(F.get(ranked, i + step)["h"] == s["h"], F.lit(False))
        found = F.filter(ranked, lambda s, i: same(s, i, -1) | same(s, i, 1))
        starts = F.sort_array(F.transform(found, lambda s: s["p"]))
        new = lambda at: F.transform(at, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - p, F.lit(width))))
        return F.aggregate(let(starts, new), F.lit(0).cast("long"), lambda a, x: a + x)

    ranked = F.sort_array(F.transform(places, lambda i: F.struct(window(i).alias("h"), i.alias("p"))))
    return F.when(F.size(words) < width, F.lit(0).cast("long")).otherwise(let(ranked, covered))


def lines_with_words(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.filter(lines, lambda x: F.btrim(x, F.lit(SPACES)) != "")


def normal_line(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.translate(line, FROM, TO), SPACE_RUN, " "))


def _hashed_lines(text: Column) -> Column:
    """(hash, words) of each line with a word, in order."""
    words = lambda m: F.length(m) - F.length(F.translate(m, " ", "")) + 1
    return F.transform(lines_with_words(text), lambda x: let(normal_line(x), lambda m: F.struct(F.xxhash64(m).alias("h"), words(m).cast("long").alias("w"))))


def _keyed(docs: DataFrame, key: str, text: str, host: str) -> list[Column]:
    return [docs[key].alias("_doc"), text_key(docs[text]).alias("_text_key"), group_key(docs[host]).alias("_host")]


def hashed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Every line with a word, stored: row key, its number from 0, hash and words."""
    lines = docs.select(*_keyed(docs, key, text, host), F.posexplode(_hashed_lines(docs[text])).alias("_at", "_x"))
    return stored(lines.select(*ROW_KEY, "_at", F.col("_x.h").alias("_line"), F.col("_x.w").alias("_words")), "quality-lines")


def frequent_lines(lines: DataFrame, documents: DataFrame, min_documents: int = 20, max_share: float = 0.01, max_documents: int = 1_000) -> DataFrame:
    """(_host, _line, _rows) of every line that is over its host's limit; ``documents`` has the row keys."""
    seen = lines.groupBy(*ROW_KEY, "_line").agg(F.count("*").alias("_rows"))
    counts = seen.groupBy("_host", "_line").agg(F.count("*").alias("_n"), F.sum("_rows").alias("_rows")).where(F.col("_n") > min_documents)
    hosts = documents.distinct().groupBy("_host").agg(F.count("*").alias("_docs"))
    over = (F.col("_n") > F.lit(max_share) * F.col("_docs")) | (F.col("_n") > max_documents)
    return counts.join(hosts.hint("merge"), "_host").where(over).select("_host", "_line", "_rows")


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", broadcast_lines: int = BROADCAST_LINES, **limits) -> DataFrame:
    """Per document that loses lines: its key, the words removed, the line numbers.

    Line numbers count the lines with a word, from 0.
    """
    lines = hashed_lines(docs, key, text, host)
    over = cut(frequent_lines(lines, docs.select(*_keyed(docs, key, text, host)), **limits))
    if over.count() <= broadcast_lines:
        found = lines.join(F.broadcast(over), ["_host", "_line"])
    else:
        found = join_split(lines, over, ["_host", "_line"], "_rows", ["_doc", "_text_key", "_at"], lines.count())
    # repeated rows would count twice: each place of a text counts once
    return found.groupBy(*ROW_KEY, "_at").agg(F.max("_words").alias("_words")).groupBy(*ROW_KEY).agg(F.sum("_words").alias("_removed"), F.collect_set("_at").alias("_gone"))


def _base(docs: DataFrame, key: str, text: str, host: str) -> list[Column]:
    body = F.coalesce(docs[text], F.lit(""))
    words = let(words_of(docs[text]), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_window_words(w).alias("repeated")))
    duplicates = let(lines_with_words(docs[text]), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return [
        words.alias("_w"),
        F.length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        duplicates.cast("long").alias("n_dup_lines"),
    ]


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["_doc"].eqNullSafe(right["_doc"]) & (left["_text_key"] == right["_text_key"]) & (left["_host"] == right["_host"])


def _verdict(max_removed: float) -> list[Column]:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("n_removed_words") > F.lit(max_removed) * F.col("n_words")
    return [failed.alias("base_failed"), (~failed & ~depleted).alias("kept")]


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_removed: float = 0.5, **limits) -> DataFrame:
    """One row per document: counts, words removed and the verdict, without texts."""
    lost = removals(docs, key, text, host, **limits).drop("_gone")
    base = docs.select(*_keyed(docs, key, text, host), *_base(docs, key, text, host))
    joined = base.join(lost.hint("merge"), _same_row(base, lost), "left")
    counts = joined.select(
        base["_doc"].alias(key), F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.col("_w.repeated").alias("n_repeat_words"), F.coalesce("_removed", F.lit(0)).cast("long").alias("n_removed_words"),
    )
    return counts.select("*", *_verdict(max_removed))


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", chars: str = "n_chars", max_removed: float = 0.5, **limits) -> DataFrame:
    """The kept documents, all columns, with the lines over the limit removed."""
    lost = removals(docs, key, text, host, **limits)
    base = docs.select(*_keyed(docs, key, text, host), F.struct("*").alias("_row"), *_base(docs, key, text, host))
    joined = base.join(lost.hint("merge"), _same_row(base, lost), "left")
    judged = joined.select(
        "_row", "_gone", F.col("_w.n").alias("n_words"), F.col("_w.repeated").alias("n_repeat_words"),
        F.coalesce("_removed", F.lit(0)).cast("long").alias("n_removed_words"),
    ).select("_row", "_gone", *_verdict(max_removed)).where("kept")
    kept_lines = F.array_join(let(lines_with_words(F.col("_row")[text]), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone")), lambda i: F.get(x, i))), "\n")
    cleaned = judged.select("_row", F.when(F.col("_gone").isNull(), F.col("_row")[text]).otherwise(kept_lines).alias("_clean"))
    out = [F.col("_clean").alias(c) if c == text else F.length("_clean").cast(kind).alias(c) if c == chars else F.col("_row")[c].alias(c) for c, kind in docs.dtypes]
    return cleaned.select(*out)
