"""Compression classifier: two Zstandard dictionaries, one calibrated score.

A dictionary is trained on good and one on bad labelled text. A text is cut into
pieces of ``piece_bytes``, so that the dictionaries matter however long it is, and
all pieces are compressed with each. The difference of the compressed sizes, over the
text's bytes and over the sizes' sum, and the size under the good dictionary over the
bytes, go through a logistic calibration fitted on labelled rows of its own and
weighted to the share of good rows among all labels.

Fitting sees a bounded sample: of each class ``dictionary_rows`` rows for the
dictionary and ``calibration_rows`` further rows, by a hash of the id, leaving out
texts over ``sample_bytes``. Scoring covers every whole text. Rows whose id has a
CRC-32 (as text) of 2 modulo 4 are held out of fitting.

Defined results: null and empty texts score the share of good labels; so does every
text where one class has no labelled row (0.5 without any label). Of several labels of
one id the lowest counts, of several texts the first in byte order; null labels are
ignored. Rows are kept as often as they
occur; a null id is not held out. An empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL = 3
THRESHOLD = 0.7


def pieces(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def dictionary(texts: list[bytes], piece_bytes: int, dictionary_bytes: int) -> bytes:
    """A trained dictionary; of too few samples their own bytes, the last ones."""
    samples = [p for t in texts for p in pieces(t, piece_bytes)]
    try:
        return zstandard.train_dictionary(dictionary_bytes, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-dictionary_bytes:]


class Sizes:
    """Compressed bytes of a text under the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes, piece_bytes: int):
        self.piece_bytes = piece_bytes
        self.compressors = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (good, bad)]

    def features(self, data: bytes) -> tuple[float, float, float]:
        cut = pieces(data, self.piece_bytes)
        good, bad = (sum(len(c.compress(p)) for p in cut) for c in self.compressors)
        return (bad - good) / len(data), (bad - good) / (bad + good), good / len(data)


def calibrate(features: np.ndarray, label: np.ndarray, share: float, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, scale, coefficients) of a logistic fit weighted to ``share`` good rows."""
    centre, scale = features.mean(0), features.std(0) + 1e-9
    x = np.column_stack([np.ones(len(features)), (features - centre) / scale])
    weight = np.where(label == 1, share / max(label.mean(), 1e-9), (1 - share) / max(1 - label.mean(), 1e-9))
    penalty = ridge * len(label) * np.diag([0.0] + [1.0] * features.shape[1])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        curve = weight * np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve(x.T @ (x * curve[:, None]) + penalty, x.T @ (weight * (label - p)) - penalty @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return centre, scale, b


def is_held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, piece_bytes: int, dictionary_bytes: int, dictionary_rows: int, calibration_rows: int, sample_bytes: int
) -> tuple[float, tuple | None]:
    """(share of good labels, model or None)."""
    known = labels.select(labels[key].cast("long").alias("_doc"), labels[label].cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & F.col("_doc").isNotNull() & ~is_held_out(F.col("_doc")))
    known = known.groupBy("_doc").agg(F.min("_label").alias("_label"))
    rows = dictionary_rows + calibration_rows
    counts = known.agg(F.count("*").alias("n"), F.avg("_label").alias("share")).first()
    share = float(counts.share) if counts.n else 0.5
    order = [F.xxhash64("_doc", F.lit("sample")), F.col("_doc")]
    chosen = known.where("_label = 1").orderBy(*order).limit(rows).unionAll(known.where("_label = 0").orderBy(*order).limit(rows))
    texts = docs.select(docs[key].cast("long").alias("_doc"), docs[text].alias("_text")).where((F.octet_length("_text") <= sample_bytes) & (F.octet_length("_text") > 0))
    # at most 2 x rows ids, a bound set by the parameters
    found = texts.join(F.broadcast(chosen), "_doc").groupBy("_doc").agg(F.min("_label").alias("_label"), F.min("_text").alias("_text")).orderBy(*order).collect()
    good, bad = ([r._text.encode() for r in found if r._label == c] for c in (1, 0))
    if not good or not bad:
        return share, None
    trained = [dictionary(c[: max(1, min(dictionary_rows, len(c) // 2))], piece_bytes, dictionary_bytes) for c in (good, bad)]
    sizes = Sizes(*trained, piece_bytes)
    rest = [c[min(dictionary_rows, len(c) // 2) :] for c in (good, bad)]
    features = np.array([sizes.features(t) for c in rest for t in c])
    label_of = np.repeat([1, 0], [len(c) for c in rest])
    return share, (*trained, *calibrate(features, label_of, share))


def score_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", piece_bytes: int = 1024, dictionary_bytes: int = 65_536, dictionary_rows: int = 600,
    calibration_rows: int = 900, sample_bytes: int = 32_768,
) -> DataFrame:
    """key, held_out, score (0 to 1, higher: good is likelier), predicted of every document."""
    share, model = fit(docs, labels, key, text, label, piece_bytes, dictionary_bytes, dictionary_rows, calibration_rows, sample_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is not None:
            good, bad, centre, scale, b = shared.value
            sizes = Sizes(good, bad, piece_bytes)
        for batch in batches:
            score = np.full(batch.num_rows, share)
            for i, x in enumerate(batch.column(1)) if shared.value is not None else ():
                data = x.as_buffer().to_pybytes() if x.is_valid else b""
                if data:
                    z = b[0] + ((np.array(sizes.features(data)) - centre) / scale) @ b[1:]
                    score[i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["_doc", "score"])

    scored = docs.select(docs[key].cast("long").alias("_doc"), docs[text].alias("_text")).mapInArrow(run, "_doc long, score double")
    return scored.select(F.col("_doc").alias(key), is_held_out(F.col("_doc")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
