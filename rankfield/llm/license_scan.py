"""Licence notices and identifiers in texts.

Two Aho-Corasick automata read every whole text. One runs over the text's words, joined
by single spaces, and finds the notice phrases, each place with the number of its first
word; the other runs over the lower-cased text and finds the tags in front of a licence
expression. An expression goes on to the end of its line. A shunting-yard parser turns it
into postfix order (``with`` binds closest, then ``and``, then ``or``) and evaluates it
to a grade of what the text may be used for: 1 permissive, 0 nothing.

* An ``or`` offers a choice: its grade is the larger. An ``and`` asks for both: the
  smaller. An exception after ``with`` makes a copyleft licence no stricter than weak
  copyleft and leaves others as they are.
* All notices and expressions of a text hold at once: its score is their smallest grade,
  0 where there is none. A phrase inside a longer one is a place of its own, but has no
  grade of its own.
* Expressions are read as far as they go: a token that cannot continue one ends it, an
  operator without a right side and an unclosed parenthesis are dropped.

Only A-Z are lower-cased. Words are maximal runs of 0-9, a-z and all characters beyond
ASCII. Defined results: null and empty texts have no words, no labels and score 0. Rows
are kept as often as they occur, null ids too. An empty table gives an empty result.
"""

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Further notices, by their words, and their labels.
NOTICES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license version 2 0": "apache-2.0",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl-1.0",
    "isc license": "isc",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "public domain": "public-domain",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "all-rights-reserved",
}
# What stands in front of a licence expression.
TAGS = ("spdx-license-identifier:", "license-expression:", '"license":', "license:")
# Grades by the longest name that an identifier equals or goes on from with a hyphen.
GRADES = {
    "0bsd": 1.0, "agpl": 0.3, "all-rights-reserved": 0.0, "apache": 1.0, "artistic": 0.9, "bsd": 1.0, "bsl": 1.0, "cc-by": 0.9, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "cc-by-sa": 0.5, "cc0": 1.0, "epl": 0.6,
    "gpl": 0.4, "isc": 1.0, "lgpl": 0.6, "mit": 1.0, "mpl": 0.6, "proprietary": 0.0, "public-domain": 1.0, "unlicense": 1.0, "unlicensed": 0.0, "wtfpl": 1.0, "zlib": 1.0,
}
UNKNOWN = 0.1
WEAK_COPYLEFT = 0.6
BINDING = {"or": 1, "and": 2, "with": 3}

WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
TOKEN = re.compile(r"[()]|[a-z0-9.+:-]+")


def grade_of(identifier: str) -> float:
    name = identifier.rstrip("+")
    while name not in GRADES:
        name, cut, _ = name.rpartition("-")
        if not cut:
            return UNKNOWN
    return GRADES[name]


def postfix(text: str) -> list[str]:
    """The longest licence expression that ``text`` begins with, lower-cased, in postfix order."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next, at = True, 0
    while token := TOKEN.search(text, at):
        if text[at : token.start()].strip(" \t'\"`"):
            break  # something else stands between
        t = token.group()
        if operand_next and t == "(":
            waiting.append(t)
        elif operand_next and t != ")" and t not in BINDING and t.strip(".+:-"):
            out.append(t.rstrip(".:"))
            operand_next = False
        elif not operand_next and t in BINDING:
            while waiting and waiting[-1] != "(" and BINDING[waiting[-1]] >= BINDING[t]:
                out.append(waiting.pop())
            waiting.append(t)
            operand_next = True
        elif not operand_next and t == ")" and "(" in waiting:
            while (top := waiting.pop()) != "(":
                out.append(top)
        else:
            break
        at = token.end()
    while operand_next and waiting:  # operators and parentheses that nothing follows
        operand_next = waiting.pop() == "("
    return out + [t for t in reversed(waiting) if t != "("]


def evaluate(order: list[str]) -> tuple[float, list[str]] | None:
    """(grade, labels) of an expression in postfix order; None of an empty one."""
    stack: list[tuple[float, list[str]]] = []
    for t in order:
        if t not in BINDING:
            stack.append((grade_of(t), [t]))
            continue
        (right, names), (left, own) = stack.pop(), stack.pop()
        if t == "with":
            stack.append((max(left, WEAK_COPYLEFT) if 0.3 <= left else left, [f"{x} with {y}" for x in own for y in names]))
        else:
            stack.append((max(left, right) if t == "or" else min(left, right), own + names))
    return stack[0] if stack else None


def automaton(words: dict[str, object]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for text, value in words.items():
        found.add_word(text, value)
    found.make_automaton()
    return found


class Scanner:
    """Places of the phrases and expressions behind the tags, of one text after the other."""

    def __init__(self, base: dict[str, str], notices: dict[str, str], tags: tuple[str, ...]):
        self.phrases = automaton({f" {p} ": (p, label, p in base) for p, label in (notices | base).items()})
        self.tags = automaton({t: t for t in tags})

    def scan(self, data: bytes) -> tuple[int, list[tuple[int, int, str, bool]], list[tuple[str, float, list[str]]]]:
        """(number of words, (first word, words, label, base) of each place, (expression, grade, labels) of each tag)."""
        words = data.translate(WORD_BYTES).split()
        joined = f" {b' '.join(words).decode('latin-1')} "  # one character a byte; phrases are ASCII
        places, counted, number = [], 0, 0
        for end, (phrase, label, is_base) in self.phrases.iter(joined):
            number += joined.count(" ", counted, end)  # spaces before the match's last one
            counted = end
            size = phrase.count(" ") + 1
            places.append((number - size, size, label, is_base))
        expressions = []
        lowered = data.lower().decode("latin-1")
        taken = -1
        for end, _ in self.tags.iter(lowered):
            if end > taken:  # a tag inside a tag ends where the longer one does
                taken = end
                stop = lowered.find("\n", end)
                line = lowered[end + 1 : stop if stop >= 0 else len(lowered)]
                if found := evaluate(order := postfix(line)):
                    expressions.append((" ".join(order), *found))
        return len(words), places, expressions


def score(places: list[tuple[int, int, str, bool]], expressions: list[tuple[str, float, list[str]]]) -> float:
    """The smallest grade of what holds."""
    grades, last = [g for _, g, _ in expressions], -1
    for at, size, label, _ in sorted(places, key=lambda p: (p[0], -p[1])):
        if at + size > last:  # not inside a longer phrase
            grades.append(grade_of(label))
            last = at + size
    return min(grades, default=0.0)


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags: tuple[str, ...] = TAGS
) -> DataFrame:
    """key, n_words, notices (first word, words, label, base), expressions (postfix, grade, labels), score of every document."""
    places = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("base", pa.bool_())]))
    stated = pa.list_(pa.struct([("postfix", pa.string()), ("grade", pa.float64()), ("labels", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices, tags)
        for batch in batches:
            found = [scanner.scan(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1)]
            columns = [
                pa.array([n for n, _, _ in found], pa.int64()), pa.array([[dict(zip(("word", "words", "label", "base"), p, strict=True)) for p in ps] for _, ps, _ in found], places),
                pa.array([[dict(zip(("postfix", "grade", "labels"), e, strict=True)) for e in es] for _, _, es in found], stated), pa.array([score(ps, es) for _, ps, es in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["_doc", "n_words", "notices", "expressions", "score"])

    schema = "_doc long, n_words long, notices array<struct<word: long, words: long, label: string, base: boolean>>, expressions array<struct<postfix: string, grade: double, labels: array<string>>>, score double"
    return docs.select(docs[key].cast("long").alias("_doc"), docs[text].alias("_text")).mapInArrow(run, schema).withColumnRenamed("_doc", key)


def joined_labels(labels: Column) -> Column:
    """Distinct labels, sorted, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")
