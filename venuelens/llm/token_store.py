"""Token ids as binary shards: one array of ids, document boundaries in Elias-Fano code.

Format of a shard (numbers little-endian): HEADER, the Elias-Fano code of the document ids (less the first), that of
the documents' ends in the id array, the id array. A file may have bytes after these. Shards follow each other by
(part, number); a manifest, a Parquet table beside them, has the number of ids before each.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from venuelens.llm import tokens

MAGIC = b"VLIDS\x00\x00\x01"
# magic, part, number, documents, documents without id, first document id, ids, bytes of an id, length of both codes
HEADER = "<8sIIQQqQIQQ"
HEADER_BYTES = struct.calcsize(HEADER)
SHARD_IDS = 1 << 22   # a shard ends with the document that reaches so many ids
END_ID = 0
RANK_WORDS = 8        # words of 64 bits between two counts of the select structure
TOGETHER = 1 << 21    # bytes of the texts whose words are told apart together


@dataclass
class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers in 2 + log2(largest / length) bits each and a count of
    32 bits per 512 high bits. The low ``low_bits`` of each number are packed; the rest is written in unary: number
    i sets bit (value >> low_bits) + i of the high bits."""

    n: int
    low_bits: int
    low: np.ndarray    # bytes
    high: np.ndarray   # 64-bit words
    ranks: np.ndarray  # set bits before every RANK_WORDS words, 32-bit

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        planes = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(planes.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        words = -(-(int(ones[-1]) + 1 if n else 0) // (64 * RANK_WORDS)) * RANK_WORDS
        flags = np.zeros(words * 64, np.uint8)
        flags[ones] = 1
        return cls(n, bits, low, np.packbits(flags, bitorder="little").view("<u8"), cls._ranks(flags))

    @staticmethod
    def _ranks(flags: np.ndarray) -> np.ndarray:
        per = flags.reshape(-1, 64 * RANK_WORDS).sum(axis=1, dtype=np.uint32)
        return np.concatenate([np.zeros(1, np.uint32), np.cumsum(per, dtype=np.uint32)])

    def to_bytes(self) -> bytes:
        head = struct.pack("<QIQQ", self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.astype("<u8").tobytes() + self.ranks.astype("<u4").tobytes()

    @classmethod
    def read(cls, raw: memoryview) -> EliasFano:
        n, bits, n_low, n_high = struct.unpack_from("<QIQQ", raw)
        at = struct.calcsize("<QIQQ")
        low = np.frombuffer(raw, np.uint8, n_low, at)
        high = np.frombuffer(raw, "<u8", n_high, at + n_low)
        ranks = np.frombuffer(raw, "<u4", n_high // RANK_WORDS + 1, at + n_low + 8 * n_high)
        return cls(n, bits, low, high, ranks)

    def _lows(self, places: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(places), np.uint64)
        at = places.astype(np.int64)[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """Number ``i``: a binary search among the counts, then at most RANK_WORDS words."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.ranks, i, side="right")) - 1
        words = self.high[block * RANK_WORDS:(block + 1) * RANK_WORDS]
        ones = np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))
        place = block * RANK_WORDS * 64 + int(ones[i - int(self.ranks[block])])
        return ((place - i) << self.low_bits) | int(self._lows(np.array([i]))[0])

    def all(self) -> np.ndarray:
        """Every number: one pass over the high bits."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(np.arange(self.n))


@dataclass
class Shard:
    """One file, opened: sections are views of its bytes."""

    part: int
    number: int
    n_null: int
    first_id: int
    n_ids: int
    doc_ids: EliasFano
    ends: EliasFano
    ids: np.ndarray

    @classmethod
    def read(cls, content: bytes) -> Shard:
        magic, part, number, _, n_null, first, n_ids, width, n_docs_code, n_ends = struct.unpack_from(HEADER, content)
        if magic != MAGIC:
            raise ValueError("no shard of token ids")
        raw, at = memoryview(content), HEADER_BYTES
        return cls(part, number, n_null, first, n_ids, EliasFano.read(raw[at:]), EliasFano.read(raw[at + n_docs_code:]),
                   np.frombuffer(raw, f"<u{width}", n_ids, at + n_docs_code + n_ends))

    def bounds(self, i: int) -> tuple[int, int]:
        """Where the ids of document ``i`` begin and end: two selects."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def names(self) -> list[int | None]:
        known = self.doc_ids.all().view(np.int64) + np.int64(self.first_id)  # wraps back to the signed id
        return [None] * self.n_null + known.tolist()


def shard_bytes(part: int, number: int, doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    known = np.array([d for d in doc_ids if d is not None], np.int64)  # ascending, after the null ones
    first = int(known[0]) if len(known) else 0
    names = EliasFano.of((known - np.int64(first)).view(np.uint64)).to_bytes()
    ends = EliasFano.of(np.cumsum(np.array(lengths, np.uint64))).to_bytes()
    return struct.pack(HEADER, MAGIC, part, number, len(doc_ids), len(doc_ids) - len(known), first, len(ids) // width, width,
                       len(names), len(ends)) + names + ends + ids


@lru_cache(maxsize=2)
def _encoder(raw: bytes, width: int) -> tokens.Table:
    """Ids of runs as packed bytes; one table per worker process. A task has one core, so the library starts no threads."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

    def compute(missing: list[str]) -> Iterator[tuple[str, bytes]]:
        runs, ids, counts = tokens.encode_runs(raw, missing)
        packed, ends = ids.astype(f"<u{width}").tobytes(), (np.cumsum(counts) * width).tolist()
        return zip(runs, (packed[a:b] for a, b in zip([0, *ends], ends)))

    return tokens.Table(compute)


def encoded(texts: list[str] | pa.Array, raw: bytes, width: int) -> Iterator[bytes]:
    """The packed ids of each text; null is empty."""
    table, at = _encoder(raw, width), 0
    texts = (pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())).fill_null("")
    total = np.cumsum(pc.binary_length(texts).to_numpy())
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + TOGETHER, side="right")))
        found, bounds = tokens.pieces(texts.slice(at, to - at), raw)
        packed = pa.array(table.of(found.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(found.indices)
        ends = np.frombuffer(packed.buffers()[1], np.int64, len(packed) + 1)[bounds].tolist()
        ids = memoryview(packed.buffers()[2] or b"")
        for start, end in zip(ends, ends[1:]):
            yield bytes(ids[start:end])
        at = to


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of ``docs`` (doc_id, text) below ``path``: ``shards``, real binary files in ascending doc_id order,
    and ``manifest``, a row per shard.

    Whole texts are encoded, strings of special tokens as the library's default has it, with ``end_id`` after each
    document. Null text is empty: only the end id. Null ids come first; rows of one id follow each other by a hash of
    their text, equal rows in any order. A document is never split over shards. Other columns are not read. An empty
    table gives an empty manifest. The range sort breaks ties by text and row, so no id fills one task. Spark's own
    committer writes the files (a row of raw bytes each), so lost or doubled tasks leave no trace."""
    spark = docs.sparkSession
    vocab = tokens.file_bytes(spark, vocabulary)
    width = 2 if tokens.byte_bpe(vocab.value).get_vocab_size() <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = int(end_id).to_bytes(width, "little")
        part, number = TaskContext.get().partitionId(), 0
        names, lengths, held, size = [], [], [], 0

        def shard() -> pa.RecordBatch:
            raw = shard_bytes(part, number, names, lengths, b"".join(held), width)
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["value"])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1), vocab.value, width)):
                names.append(doc_id)
                lengths.append(len(ids) // width + 1)
                held += [ids, end]
                size += lengths[-1]
                if size >= shard_ids:
                    yield shard()
                    number += 1
                    names, lengths, held, size = [], [], [], 0
        if names:
            yield shard()

    keys = ("doc_id", "_text", "_row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.xxhash64(F.col("text").cast("string")).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    (placed.select("doc_id", "text").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).text(f"{path}/shards"))
    _manifest(spark, path).write.parquet(f"{path}/manifest")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{path}/shards")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, part, number, documents, ids, start: from the headers. Parts are as many as range partitions, a part's
    shards are summed by themselves, so neither window sees more than that."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [struct.unpack(HEADER, c.as_py()) for c in batch.column(1)]
            columns = [pa.array([h[i] for h in heads], pa.int64()) for i in (1, 2, 3, 6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["file", "part", "number", "documents", "ids"])

    shards = _files(spark, path).select("path", F.substring("content", 1, HEADER_BYTES)).mapInArrow(
        run, "file string, part long, number long, documents long, ids long")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("ids").alias("n")).select(
        F.col("part").alias("_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return (shards.withColumn("_inside", F.coalesce(F.sum("ids").over(inside), F.lit(0)))
            .join(parts, F.col("part") == F.col("_part"))
            .select("file", "part", "number", "documents", "ids", (F.col("_before") + F.col("_inside")).alias("start")))


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the shards below ``path``, from the files: doc_id, start (ids of all documents before it),
    n_tokens (with the end id), ids_crc32 (unsigned, of its ids as unsigned 32-bit numbers), and with ``with_ids`` ids.
    An empty store gives no rows; repeated documents give a row each."""
    manifest = spark.read.schema("file string, part long, number long, documents long, ids long, start long").parquet(f"{path}/manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                shard = Shard.read(content.as_py())
                ends = shard.ends.all().astype(np.int64)
                starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
                wide = shard.ids.astype("<u4")
                crc = [zlib.crc32(wide[s:e].tobytes()) for s, e in zip(starts, ends)]
                columns = [pa.array([file.as_py()] * len(ends), pa.string()), pa.array(shard.names(), pa.int64()), pa.array(starts),
                           pa.array(ends - starts), pa.array(crc, pa.int64())]
                if with_ids:
                    offsets = np.concatenate([starts, ends[-1:]]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(offsets, wide.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, names=["file", "doc_id", "local", "n_tokens", "ids_crc32", "ids"][:len(columns)])

    schema = "file string, doc_id long, local long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    rows = _files(spark, path).select("path", "content").mapInArrow(run, schema)
    return rows.join(manifest.select("file", F.col("start").alias("base")), "file").select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
