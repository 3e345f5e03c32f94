"""Line dedup by winnowing over line hashes, DataFrame functions only.

Lines with a word are hashed, white space runs as one space and ends trimmed; case
and digits count. In every window of ``min_run`` lines
the smallest hash (the last of equal ones) is selected; equal runs of ``min_run``
lines select the same place, so every repeated run of that length shares such a
fingerprint. Fingerprints that occur once are dropped; the places of the others are
joined and extended both ways, over the windows they were selected in, to whole
runs. A line is deleted if it lies in a run of ``min_run`` or more lines that also
starts earlier: in a document with a smaller (id, text key), or earlier in the same.

With ``long_words``, a run of one or two lines also counts if it has more words than
that: such windows are keyed by the hash of all their lines, without winnowing. A text
may be shorter than ``min_run`` lines.

Nothing is paired with every other copy: each run is held against its first place.
Those first places are found by partial aggregates, and the rows of a very common
fingerprint are dealt over several tasks to meet them.

Defined results: null and blank texts have no lines; a null id comes before all
others; rows that agree in id and text are one document, so neither deletes the
other. A text that loses no line stays as it is; one that does keeps its other lines
with a word, joined by line feeds. An empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfield.llm.common import SPACE_RUN, cut, join_split, let, stored, text_key
from rankfield.llm.quality_rules import lines_with_words


def _fingerprints(hashes: Column, run: int) -> Column:
    """(fingerprint, first window, hashes of all lines of its windows) in text order."""

    def place(s: Column) -> Column:
        def last_minimum(w: Column) -> Column:
            return s + run - F.array_position(F.reverse(w), F.array_min(w)).cast("int")

        return let(F.slice(hashes, s + 1, run), last_minimum)

    def grouped(picks: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(picks) - 1), lambda i: (i == 0) | (F.get(picks, i) != F.coalesce(F.get(picks, i - 1), F.lit(-1))))

        def spans(at: Column) -> Column:
            def span(i: Column, k: Column) -> Column:
                after = F.coalesce(F.get(at, k + 1), F.size(picks))
                return F.struct(F.get(hashes, F.get(picks, i)).alias("f"), i.alias("start"), F.slice(hashes, i + 1, after - i + run - 1).alias("around"))

            return F.transform(at, span)

        return let(starts, spans)

    none = F.array().cast("array<struct<f:bigint,start:int,around:array<bigint>>>")
    return F.when(F.size(hashes) < run, none).otherwise(let(F.transform(F.sequence(F.lit(0), F.size(hashes) - run), place), grouped))


def _exact_line(line: Column) -> Column:
    return F.btrim(F.regexp_replace(line, SPACE_RUN, " "))


def _line_hashes(text: Column) -> Column:
    return F.transform(lines_with_words(text), lambda x: F.xxhash64(_exact_line(x)))


def _long_windows(text: Column, long_words: int) -> Column:
    """(at, lines, w, words) of every window of one or two lines with over ``long_words`` words."""
    words = lambda m: F.length(m) - F.length(F.translate(m, " ", "")) + 1
    lines = F.transform(lines_with_words(text), lambda x: let(_exact_line(x), lambda m: F.struct(F.xxhash64(m).alias("h"), words(m).alias("n"))))
    window = lambda at, lines, w, n: F.struct(at.alias("at"), F.lit(lines).alias("lines"), w.alias("w"), n.alias("words"))

    def windows(x: Column) -> Column:
        one = F.transform(x, lambda s, i: window(i, 1, s["h"], s["n"]))
        two = F.transform(x, lambda s, i: window(i, 2, F.xxhash64(s["h"], F.get(x, i + 1)["h"]), s["n"] + F.get(x, i + 1)["n"]))
        return F.filter(F.concat(one, two), lambda s: s["words"] > long_words)

    return let(lines, windows)


def _later_long_lines(docs: DataFrame, key: str, text: str, long_words: int) -> DataFrame:
    """(_doc, _text_key, _line) of every line in a long window that also starts earlier."""
    found = docs.select(docs[key].alias("_doc"), text_key(docs[text]).alias("_text_key"), F.explode(_long_windows(docs[text], long_words)).alias("_x"))
    windows = stored(found.select("_doc", "_text_key", F.col("_x.at").alias("_at"), F.col("_x.lines").alias("_lines"), F.col("_x.w").alias("w")), "long-lines")
    place = F.struct("_doc", "_text_key", "_at")
    firsts = cut(windows.groupBy("w", "_lines").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1"))
    return join_split(windows, firsts, ["w", "_lines"], "_n", ["_doc", "_text_key"], windows.count()).where(place > F.col("_first")).select("_doc", "_text_key", F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("_lines") - 1)).alias("_line"))


def later_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_run: int = 3, long_words: int | None = None) -> DataFrame:
    """(_doc, _text_key, _gone): the numbers, from 0, of the lines to delete."""
    found = docs.select(docs[key].alias("_doc"), text_key(docs[text]).alias("_text_key"), F.explode(let(_line_hashes(docs[text]), lambda h: _fingerprints(h, min_run))).alias("_x"))
    selected = stored(found.select("_doc", "_text_key", "_x.f", "_x.start", "_x.around"), "winnowed-lines")
    repeated = cut(selected.groupBy("f").agg(F.count("*").alias("_n")).where("_n > 1"))
    shared = join_split(selected, repeated, ["f"], "_n", ["_doc", "_text_key"], selected.count())
    windows = F.transform(F.sequence(F.lit(0), F.size("around") - min_run), lambda j: F.struct((F.col("start") + j).alias("at"), F.xxhash64(F.slice("around", j + 1, min_run)).alias("w")))
    runs = stored(shared.select("_doc", "_text_key", "f", F.explode(windows).alias("_r")).select("_doc", "_text_key", "f", F.col("_r.at").alias("_at"), F.col("_r.w").alias("w")), "line-runs")
    place = F.struct("_doc", "_text_key", "_at")
    firsts = cut(runs.groupBy("f", "w").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1"))
    later = join_split(runs, firsts, ["f", "w"], "_n", ["_doc", "_text_key"], runs.count()).where(place > F.col("_first")).select("_doc", "_text_key", F.explode(F.sequence(F.col("_at"), F.col("_at") + min_run - 1)).alias("_line"))
    if long_words is not None:
        later = later.unionAll(_later_long_lines(docs, key, text, long_words))
    return later.groupBy("_doc", "_text_key").agg(F.array_sort(F.collect_set("_line")).alias("_gone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_run: int = 3, long_words: int | None = None) -> DataFrame:
    """_row (all columns), _clean (the text left), _lines, _gone of every document."""
    gone = later_lines(docs, key, text, min_run, long_words)
    flat = docs.select(F.struct("*").alias("_row"), docs[key].alias("_doc"), text_key(docs[text]).alias("_text_key"))
    joined = flat.join(gone.hint("merge"), flat["_doc"].eqNullSafe(gone["_doc"]) & (flat["_text_key"] == gone["_text_key"]), "left")
    lines = lines_with_words(F.col("_row")[text])
    left = F.array_join(let(lines, lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone")), lambda i: F.get(x, i))), "\n")
    clean = F.when(F.col("_gone").isNull(), F.col("_row")[text]).otherwise(left)
    return joined.select("_row", clean.alias("_clean"), F.size(lines).cast("long").alias("_lines"), "_gone")


def dedup_report(docs: DataFrame, key: str = "doc_id", text: str = "text", min_run: int = 3) -> DataFrame:
    """Per document: lines, removed lines, removed runs, SHA-256 of the text left."""
    done = dedup_lines(docs.select(docs[key].alias(key), docs[text].alias(text)), key, text, min_run)
    gone = F.coalesce("_gone", F.array().cast("array<int>"))
    runs = F.size(F.filter(gone, lambda x, i: F.coalesce(F.get(gone, i - 1) != x - 1, F.lit(True))))
    return done.select(
        F.col("_row")[key].alias(key), F.col("_lines").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"),
        runs.cast("long").alias("n_runs"), F.sha2(F.coalesce("_clean", F.lit("")), 256).alias("kept_sha256"),
    )


def deduplicated_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str = "n_chars", min_run: int = 3, long_words: int | None = None) -> DataFrame:
    """All documents, all columns, with the later repeated runs deleted."""
    done = dedup_lines(docs, key, text, min_run, long_words)
    out = [F.col("_clean").alias(c) if c == text else F.length("_clean").cast(kind).alias(c) if c == chars else F.col("_row")[c].alias(c) for c, kind in docs.dtypes]
    return done.select(*out)
