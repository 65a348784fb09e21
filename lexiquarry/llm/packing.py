"""Packing by power-of-two decomposition.

A document's ids (those of a public tokenizer, then one that ends the document) are cut into
pieces of ``context`` ids as long as they last, and what remains into pieces of falling powers
of two, as its length is written in binary. Each piece is a sequence of its own, so none
crosses documents and none needs padding. Sequences of one length form a bucket, from which
a trainer takes batches; a bucket's sequences have consecutive ids.

Ids are those of the whole text: the tokenizer cuts at white space, and between letters and
signs, so such a unit gives the same ids wherever it stands. Units are cut and told apart in
numpy and Arrow; those seen before come from a memory of bounded size, new ones go to the
tokenizer together. A text is read in parts of a few megabytes, whatever its length.

No text is shuffled. Numbers of sequences come from counts by task and length.

Defined results: null or empty text is the end id alone, one sequence of length 1; repeated
rows and rows of one doc_id are documents of their own; a null doc_id is kept as null; other
columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiquarry.llm import textcore as tc
from lexiquarry.llm.common import bounded_batches, stored

CONTEXT = 4096
END_ID = 2

#: Units that a memory holds before they become its older half, and bytes of a unit that it keeps.
MEMORY = 500_000
UNIT_BYTES = 64
#: Bytes of text looked at together.
_SLICE = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_OTHER = re.compile(rb"['0-9\x00-\x1f\x7f]")
#: Classes of bytes: space 0, letters 1, signs 2, others (digits, apostrophes, control characters) 3.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[ord(c) for c in string.ascii_letters]] = 1
_CLASS[[ord(c) for c in string.punctuation if c != "'"]] = 2
_CLASS[tc.SPACE] = 0
_FOREIGN = _CLASS.copy()
_FOREIGN[128:] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _letter(c: str) -> bool:
    """Whether it is letters alone as the tokenizer sees it: composed, then in lower case."""
    return unicodedata.normalize("NFC", c).lower().isalpha()


def _values(column: pa.Array) -> list[bytes]:
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    raw = data.to_pybytes()
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


class Encoder:
    """The ids of texts, by unit. A unit is a word, or a run of letters or of signs in a word
    that has nothing else: the tokenizer never joins these."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        size = self.tokenizer.get_vocab_size()
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.marks = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.units: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, raw: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")

    def _learn(self, units: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new units. Those of one class go to the tokenizer together, and are told
        apart by their word ends."""
        plain = [u for u in units if not _OTHER.search(u)]
        ids = self._ids(b" ".join(plain))
        ends = np.flatnonzero(self.closes[ids]) + 1
        out = {}
        if len(plain) and len(ends) == len(plain) and ends[-1] == len(ids):
            raw = ids.tobytes()
            out = {u: raw[4 * a : 4 * b] for u, a, b in zip(plain, [0, *ends[:-1].tolist()], ends.tolist(), strict=True)}
        return out | {u: self._ids(u).tobytes() for u in units if u not in out}

    def look_up(self, units: list[bytes]) -> list[bytes]:
        """Ids of each of these distinct units."""
        found = list(map(self.units.get, units))
        miss = [k for k, v in enumerate(found) if v is None]
        if miss:
            for k in miss:
                found[k] = self.older.get(units[k])
            new = self._learn([units[k] for k in miss if found[k] is None])
            for k in miss:
                u = units[k]
                if found[k] is None:
                    found[k] = new[u]
                if len(u) <= UNIT_BYTES:
                    self.units[u] = found[k]
            if len(self.units) >= MEMORY:
                self.older, self.units = self.units, {}
        return found

    def _units(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes without space, where units start in them (and the end), units before each row."""
        raw = data.tobytes()
        kinds = _CLASS
        foreign = data[data >= 128].tobytes().decode("utf-8", "replace")
        if foreign and all(map(_letter, set(foreign))):
            kinds = _FOREIGN
        low = raw.lower()
        marked = any(m in low for m in self.marks)
        starts, ends, first = tc.word_spans(data, offs)
        kind = kinds[data]
        ink = kind > 0
        at = np.flatnonzero((kind[1:] != kind[:-1]) & ink[1:] & ink[:-1]) + 1
        word = np.searchsorted(starts, at, "right") - 1
        others = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind == 3, out=others[1:])
        mixed = others[ends] > others[starts]
        inside = ~mixed[word] & (at > starts[word]) & (not marked)
        begin = np.sort(np.concatenate([starts, at[inside]]))
        rows = np.searchsorted(begin, offs)
        packed = np.zeros(len(data) + 1, np.int32)
        np.cumsum(ink, out=packed[1:])
        return (data if marked else _LOWER[data])[ink], np.append(packed[begin], packed[-1]), rows

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and each row's offset in them. ``offs`` starts at 0."""
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(offs), np.int64)
        body, edges, rows = self._units(data, offs)
        column = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(body)])
        coded = column.dictionary_encode()
        index = coded.indices.to_numpy()
        found = self.look_up(_values(coded.dictionary))
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(found), "<u4")
        counts = lengths[index]
        stops = np.concatenate([[0], np.cumsum(counts)])
        return flat[np.repeat(begins[index] - stops[:-1], counts) + np.arange(stops[-1])], stops[rows]

    def encode_text(self, data: np.ndarray) -> np.ndarray:
        """Ids of one long text, cut at spaces into parts."""
        raw, out, at = data.tobytes(), [], 0
        while at < len(raw):
            m = _SPACE.search(raw, at + _SLICE)
            end = m.start() if m else len(raw)
            out.append(self.encode(data[at:end], np.array([0, end - at]))[0])
            at = end
        return np.concatenate(out)


_ENCODERS: dict[str, Encoder] = tc._Cache()


def _encoder(definition: str) -> Encoder:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def piece_lengths(n: int, context: int = CONTEXT) -> list[int]:
    """Lengths of the pieces of n ids: whole contexts, then falling powers of two."""
    rest = n % context
    return [context] * (n // context) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("nth", pa.int64()), ("ids", pa.list_(pa.int32()))]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, nth long"


def _pieces(docs: DataFrame, tokenizer: str, context: int, end_id: int, with_ids: bool) -> DataFrame:
    """Pieces with their task and their place among the task's pieces of their length."""
    if context & (context - 1) or context < 1:
        raise ValueError("context must be a power of two")
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()
    fields = FIELDS if with_ids else FIELDS[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition.value)
        seen: dict[int, int] = {}
        for b in batches:
            raw, offs = tc.utf8(b.column(1))
            doc_ids = b.column(0).to_pylist()
            for i, j in tc.slices(offs, _SLICE):
                data = raw[offs[i] : offs[j]]
                if len(data) > _SLICE:
                    ids = encoder.encode_text(data)
                    at = np.array([0, len(ids)])
                else:
                    ids, at = encoder.encode(data, offs[i : j + 1] - offs[i])
                out: list[tuple] = []
                for r in range(i, j):
                    doc_id, coded = doc_ids[r], ids[at[r - i] : at[r - i + 1]].tobytes() + end
                    n, start = len(coded) // 4, 0
                    for length in piece_lengths(n, context):
                        nth = seen[length] = seen.get(length, -1) + 1
                        part = coded[4 * start : 4 * (start + length)]
                        row = (doc_id, start, length, zlib.crc32(part), n, nth)
                        out.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if with_ids else row)
                        start += length
                    if len(out) >= 4096:
                        yield _batch(out, fields)
                        out = []
                if out:
                    yield _batch(out, fields)

    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids).withColumn("task", F.spark_partition_id())


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def pack_documents(docs: DataFrame, tokenizer: str, context: int = CONTEXT, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """The sequences of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (always 0) and, unless left out, ids. ``tokenizer`` is the path of a
    definition whose units end at white space and whose last id of a unit ends in ``</w>``."""
    pieces = stored(_pieces(docs, tokenizer, context, end_id, with_ids))
    before = W.partitionBy(F.lit(0)).orderBy("length", "task").rowsBetween(W.unboundedPreceding, -1)
    # One row for each task and power of two.
    starts = pieces.groupBy("length", "task").agg(F.count("*").alias("n")).select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(starts.hint("shuffle_hash") if with_ids else starts, ["length", "task"])
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")]
    return numbered.select(*columns, *["ids"] * with_ids)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes sequences with their ids, a folder for each length."""
    packed.write.mode("overwrite").partitionBy("length").parquet(path)
