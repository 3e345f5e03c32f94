"""Token ids in length-delimited binary records, with an offset index.

A record file is a run of frames, in ascending id order over the files' numbers:

    8 bytes  payload length, little-endian unsigned
    4 bytes  masked CRC-32 of these 8 bytes
    payload  8 bytes id (signed), 1 byte flags (1: the id is null), 1 byte id width,
             then the token ids, little-endian unsigned, 2 or 4 bytes each
    4 bytes  masked CRC-32 of the payload
    1 byte   line feed

A mask rotates the checksum right by 15 bits and adds a constant, so that a checksum
of data that holds checksums stays sound. Spark's text sink writes the frames, so the
files are committed as any other output: a lost executor's part is written again and
only whole attempts are kept. The index (file, offset, length, id) is a Parquet table
beside them for shuffled reads, made from the files as they were written.

Words without white space are encoded once and reused: this tokenizer's normaliser
and splitter never join text across white space. Of a pure Latin-1 word the case is
folded and trailing stops and commas are split off first, as the tokenizer does.

Defined results: a null text is empty and has the end id only. Null ids come first;
rows that share an id are ordered by the key of their text. Rows are kept as often as
they occur. An empty table gives an empty result.
"""

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfield.llm.common import text_key

MASK_ADD = 0xA282EAD8  # fixed value of the record format
HEAD, PAYLOAD_HEAD, TAIL = 12, 10, 5
LATIN_1_END = "Ā"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_ADD) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    payload = (doc_id or 0).to_bytes(8, "little", signed=True) + bytes([doc_id is None, ids.dtype.itemsize]) + ids.tobytes()
    length = len(payload).to_bytes(8, "little")
    return b"".join((length, masked_crc(length).to_bytes(4, "little"), payload, masked_crc(payload).to_bytes(4, "little"), b"\n"))


def frames(data: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, frame length, id, token ids) of a file's frames; checksums are held."""
    at, view = 0, memoryview(data)
    while at < len(data):
        length = bytes(view[at : at + 8])
        n = int.from_bytes(length, "little")
        if masked_crc(length) != int.from_bytes(view[at + 8 : at + HEAD], "little"):
            raise ValueError(f"broken record length at byte {at}")
        payload = bytes(view[at + HEAD : at + HEAD + n])
        if masked_crc(payload) != int.from_bytes(view[at + HEAD + n : at + HEAD + n + 4], "little"):
            raise ValueError(f"broken record at byte {at}")
        doc_id = None if payload[8] else int.from_bytes(payload[:8], "little", signed=True)
        yield at, HEAD + n + TAIL, doc_id, np.frombuffer(payload, f"<u{payload[9]}", offset=PAYLOAD_HEAD)
        at += HEAD + n + TAIL


# The steps before merging under which a text's ids are those of its words.
WORD_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


class WordEncoder:
    """Token ids of texts through a cache of words; bounded, and exact."""

    def __init__(self, path: str, most_words: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.most_words = most_words
        steps = json.loads(self.tokenizer.to_str())
        self.by_word = steps["model"]["dropout"] is None and all(steps[k] == v for k, v in WORD_STEPS.items())
        # how the byte-level splitter spells each Latin-1 letter
        letters = [chr(c) for c in range(0x100) if chr(c).isalpha()] if self.by_word else []
        self.spelling = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}
        self._clear()

    def _clear(self) -> None:
        self.new: list[str] = []
        self.words = _Places(self.new)
        self.cores: dict[str, bytes] = {}
        self.ids, self.filled = np.empty(1 << 16, self.kind), 0
        # of each known word: where its ids start, and how many there are
        self.start, self.count, self.known = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32), 0

    def _whole(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _packed(self, word: str) -> bytes:
        """Ids of a word, packed; its letters and its trailing stops are looked up alone."""
        core = word.rstrip(".,")
        plain = core.isascii()
        if not core.isalpha() or not (plain or max(core) < LATIN_1_END):
            return array(self.code, self._whole(word)).tobytes()
        name = core.lower()
        ids = self.cores.get(name)
        if ids is None:
            spelled = name if plain else name.translate(self.spelling)
            ids = self.cores[name] = array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()
        if len(core) == len(word):
            return ids
        stops = word[len(core) :]
        tail = self.cores.get(stops)
        if tail is None:
            tail = self.cores[stops] = array(self.code, self._whole(stops)).tobytes()
        return ids + tail

    def _learn(self) -> None:
        found = list(map(self._packed, self.new))
        count = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        start = self.filled + np.cumsum(count) - count
        end, known = self.filled + int(count.sum()), self.known + len(found)
        self.ids = _room(self.ids, end)
        self.start, self.count = _room(self.start, known), _room(self.count, known)
        self.ids[self.filled : end] = np.frombuffer(b"".join(found), self.kind)
        self.start[self.known : known], self.count[self.known : known] = start, count
        self.filled, self.known = end, known
        self.new.clear()

    def encode(self, texts: list[str | None], end_id: int | None = None) -> list[np.ndarray]:
        """Token ids of each text; new words of the whole batch are learned at once.

        Words stand for themselves only in a tokenizer whose steps are ``WORD_STEPS``;
        any other encodes each text whole.
        """
        if not self.by_word:
            end = [] if end_id is None else [end_id]
            return [np.array([*self._whole(t or ""), *end], self.kind) for t in texts]
        if len(self.words) > self.most_words:
            self._clear()
        tail = np.array([] if end_id is None else [end_id], self.kind)
        # Python takes these four controls for white space, the tokenizer does not
        odd = [any(c in t for c in "\x1c\x1d\x1e\x1f") if t else False for t in texts]
        words = [t.split() if t and not o else [] for t, o in zip(texts, odd, strict=True)]
        sizes = [len(w) for w in words]
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(words)), np.int64, sum(sizes))
        if self.new:
            self._learn()
        count = self.count[at]
        upto = np.concatenate([[0], np.cumsum(count)])
        where = np.repeat(self.start[at] - upto[:-1], count) + np.arange(upto[-1])
        flat, ends = self.ids[where], upto[np.cumsum(sizes)].tolist()
        begins = [0, *ends[:-1]]
        out = [np.concatenate([flat[a:b], tail]) for a, b in zip(begins, ends, strict=True)]
        for i, o in enumerate(odd):
            if o:
                out[i] = np.concatenate([np.array(self._whole(texts[i]), self.kind), tail])
        return out


def _room(x: np.ndarray, size: int) -> np.ndarray:
    """``x``, or a copy with twice the room until ``size`` fits."""
    while len(x) < size:
        x = np.concatenate([x, np.empty_like(x)])
    return x


class _Places(dict):
    """Word to its place; a new word is noted and gets the next one."""

    def __init__(self, new: list[str]):
        super().__init__()
        self.new_words = new

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new_words.append(word)
        return at


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_records(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 2, file_bytes: int = 32 << 20) -> None:
    """Encode every text and write record files of about ``file_bytes`` of text each."""
    flat = docs.select(docs[key].cast("long").alias("_doc"), docs[text].alias("_text"))
    size = flat.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    files = max(1, -(-size // file_bytes))
    ordered = flat.repartitionByRange(files, F.col("_doc").asc_nulls_first()).sortWithinPartitions(F.col("_doc").asc_nulls_first(), text_key(F.col("_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(public_tokenizers.path(tokenizer)).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                done = [frame(d, ids)[:-1] for d, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist(), end_id), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], names=["frame"])

    ordered.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read_records(docs_path: str, spark) -> DataFrame:
    """file, offset, length, doc_id, n_tokens, ids_crc32, before (ids before it in the file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                rows, before = [], 0
                for offset, length, doc_id, ids in frames(data.as_py()):
                    rows.append((offset, length, doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), before))
                    before += len(ids)
                if rows:
                    columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows)), *columns], names=["file", "offset", "length", "doc_id", "n_tokens", "ids_crc32", "before"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(docs_path).select("path", "content")
    return files.mapInArrow(run, "file string, offset long, length long, doc_id long, n_tokens long, ids_crc32 long, before long")


def with_starts(index: DataFrame, group: int = 1_024) -> DataFrame:
    """``start``, the ids in all records before, in place of ``before``, those in the file.

    Files go by the number in their name, not by the name: it has five digits, or more.
    Running totals are taken inside groups of files and over the groups.
    """
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("_all")).select("file", "_all", number.alias("_n"), F.floor(number / group).alias("_g"))
    inside = files.withColumn("_in", F.expr("sum(_all) OVER (PARTITION BY _g ORDER BY _n ROWS UNBOUNDED PRECEDING) - _all"))
    groups = files.groupBy("_g").agg(F.sum("_all").alias("_a")).select("_g", F.expr("sum(_a) OVER (ORDER BY _g ROWS UNBOUNDED PRECEDING) - _a").alias("_before"))
    starts = inside.join(groups.hint("merge"), "_g").select("file", (F.col("_in") + F.col("_before")).alias("_start"))
    return index.join(starts.hint("merge"), "file").withColumn("start", F.col("_start") + F.col("before")).drop("_start", "before")


def export(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the files and their index; return the index with each record's ``start``."""
    spark = docs.sparkSession
    write_records(docs, f"{path}/records", **options)
    read_records(f"{path}/records", spark).write.parquet(f"{path}/index")
    return with_starts(spark.read.parquet(f"{path}/index"))
