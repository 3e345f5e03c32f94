"""Documents with every odd case, and plain versions of the operators to hold against."""

import hashlib
import re

import numpy as np
import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc string, h string, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))


def odd_documents() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    body = [f"first line {i}\nsecond line {i}\nthird line {i}\nfourth line {i}" for i in range(6)]
    rows = [
        (1, body[0], "en", "a"), (2, body[0], "en", "a"), (2, body[0], "en", "a"), (3, body[1] + "\n" + body[0], "en", "b"), (4, None, None, None), (5, "", "de", "a"), (6, " \t\n\x0b ", "de", None),
        (7, LONG, "en", "a"), (8, LONG + " tail", "en", "b"), (None, body[2], "en", "a"), (None, body[2], "en", "a"), (9, "x\x00y é ü 漢字 \U0001f600 " + PASSAGE, "fr", "b"), (10, PASSAGE + " end of it", "fr", "b"),
        (11, "word " * 300, "en", "a"), (12, "One two three", "en", "a"), (13, "one TWO three", "en", "a"), (14, body[3] + "\n" + body[4] + "\n" + body[3], "en", "a"), (-5, "a b c d e f g", "en", "a"), (15, "it's the 'test' <|endoftext|> A.B, c.. d'll \x1c tail end", "en", "c"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), "clash", None, "kept") for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA)


def letters(*numbers):
    """A word of its own for the numbers, without digits."""
    return "q".join("".join(chr(97 + int(d)) for d in str(n)) for n in numbers)


def words(text):
    return WORD.findall(text or "")


def base_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen: dict = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def fingerprint(text):
    w = [x.encode() for x in words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[int], radius: int = 4) -> list[int]:
    """Component number of each fingerprint, by comparing all of them."""
    x = np.array(prints, np.uint64)
    label = list(range(len(x)))
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= radius):
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if v in (a, b) else v for v in label]
    return label


def removed_bytes(docs: list[tuple], length: int = 100) -> list[tuple]:
    """(bytes, removed, spans, hash of the rest) of distinct (id, text) rows in id order."""
    first: dict[bytes, tuple] = {}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] if d[0] is not None else 0))
    for key, text in order:
        b = (text or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], (key, text, p))
    out = []
    for key, text in docs:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            k, t, q = first[b[p : p + length]]
            earlier = q < p if (k, t) == (key, text) else k != key
            if earlier or b.find(b[p : p + length]) < p:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
