"""Token-id files: a concatenated id array with Elias-Fano document boundaries.

A file set is a Parquet folder whose rows are blocks of consecutive documents, ordered by (part, block). A block holds

* ``ids``: all ids of the block, little-endian, 2 or 4 bytes each (``width``);
* ``low``, ``high``, ``samples``: the ends of its documents in the id array as an Elias-Fano sequence;
* ``doc_ids``: the documents' numbers, ``start``: ids before the block inside its part.

Spark's own writer commits the blocks, so a lost executor leaves no half-written file and any file system will do.
An end costs 2 + log2(ids per document) bits instead of 64. ``select`` answers "where does document i end" from a
sampled position and one scan of at most ``SAMPLE`` documents, without expanding the sequence. Both readers work by
``select``: ``read_token_files`` over every document, ``read_documents`` for the ids of given ones.

Defined cases: a null or empty text is a document of its end id alone; equal doc_ids follow each other in order of a
text hash; a null doc_id comes first; an empty table gives an empty file set; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import work_folder
from .pieces import encoder
from .tasks import ship, texts

SAMPLE = 64
BLOCK_IDS = 1 << 18
BLOCKS = (
    "part int, block int, start long, n_docs int, n_tokens long, doc_ids array<bigint>, ids binary, width int, "
    "low_bits int, low binary, high binary, samples array<bigint>"
)
DOCUMENTS = "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence of numbers below 2^63 in 2 + log2(last / count) bits each, with sampled select."""

    def __init__(self, low_bits: int, low: bytes, high: bytes, samples: list[int], count: int):
        self.low_bits, self.low, self.high, self.samples, self.count = low_bits, low, high, samples, count

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, b"", b"", [], 0)
        low_bits = max(0, int(values[-1] // n).bit_length() - 1)
        # bit j of value i lies at i * low_bits + j
        lows = (values[:, None] >> np.arange(low_bits)) & 1
        low = np.packbits(lows.astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return cls(low_bits, low, np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].tolist(), n)

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        last = first + self.low_bits
        window = int.from_bytes(self.low[first // 8 : (last + 7) // 8], "little")
        return (window >> (first % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value i: the sampled one-bit before it, then whole bytes of ones up to it."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        at, seen = self.samples[i // SAMPLE], i - i % SAMPLE
        byte = at // 8
        word = self.high[byte] & (0xFF << at % 8)
        while seen + word.bit_count() <= i:
            seen += word.bit_count()
            byte += 1
            word = self.high[byte]
        for _ in range(i - seen):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        return ((one - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        """Every value, for scans that need all of them anyway."""
        if not self.count:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.count]
        high = (ones - np.arange(self.count)) << self.low_bits
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.count * self.low_bits]
        lows = bits.reshape(self.count, self.low_bits).astype(np.int64) << np.arange(self.low_bits)
        return high + lows.sum(axis=1)


def _block(part: int, block: int, start: int, doc_ids: list, chunks: list[bytes], width: int) -> dict:
    ends = np.cumsum([len(c) // 4 for c in chunks])
    ends_ef = EliasFano.of(ends)
    ids = np.frombuffer(b"".join(chunks), "<u4")
    return {
        "part": part, "block": block, "start": start, "n_docs": len(doc_ids), "n_tokens": int(ends[-1]),
        "doc_ids": doc_ids, "ids": ids.astype(f"<u{width}").tobytes(), "width": width, "low_bits": ends_ef.low_bits,
        "low": ends_ef.low, "high": ends_ef.high, "samples": ends_ef.samples,
    }


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Encode every document, append ``end_id`` and write the file set in ascending doc_id order."""
    ship(docs.sparkSession)
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], BLOCKS).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        width = 2 if max(encode.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = np.asarray([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        block = start = held = 0
        doc_ids, chunks = [], []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_block(part, block, start, doc_ids, chunks, width)], schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                packed = encode.encode(text.as_py()) + end
                if held and held + len(packed) // 4 > BLOCK_IDS:
                    yield close()
                    block, start = block + 1, start + held
                    doc_ids, chunks, held = [], [], 0
                doc_ids.append(doc_id)
                chunks.append(packed)
                held += len(packed) // 4
        if chunks:
            yield close()

    rows = texts(docs).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    ordered.mapInArrow(run, BLOCKS).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the stored blocks alone.

    ``start`` counts the ids of all documents before it. The running total goes over one row per part (task)."""
    ship(spark)
    schema = to_arrow_schema(spark.createDataFrame([], DOCUMENTS).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                select = _ends(row).select
                ends = np.asarray([select(i) for i in range(row["n_docs"])], np.int64)
                starts = np.concatenate(([0], ends[:-1]))
                raw = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4").tobytes()
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([row["part"]] * len(ends), pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "local_start": pa.array(starts + row["start"], pa.int64()),
                        "n_tokens": pa.array(ends - starts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()),
                    },
                    schema=schema,
                )

    blocks = spark.read.schema(BLOCKS).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    bases = bases.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    rows = blocks.mapInArrow(run, DOCUMENTS).join(bases, "part")
    return rows.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def _ends(row: dict) -> EliasFano:
    return EliasFano(row["low_bits"], row["low"], row["high"], row["samples"], row["n_docs"])


def read_documents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents that ``wanted`` (doc_id) names; the column is an array of longs.

    First the places of the wanted documents, from the ``doc_ids`` column alone; then only blocks that hold one are
    joined with their positions, and two selects cut each document out of its block."""
    ship(spark)
    schema = "doc_id long, ids array<bigint>"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    listed = blocks.select("part", "block", F.posexplode("doc_ids").alias("at", "doc_id"))
    asked = wanted.select(F.col("doc_id").cast("long")).distinct()
    places = listed.join(asked, listed["doc_id"].eqNullSafe(asked["doc_id"]), "left_semi")
    places = places.groupBy("part", "block").agg(F.collect_list("at").alias("places"))  # at most a block's documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                select = _ends(row).select
                raw = np.frombuffer(row["ids"], f"<u{row['width']}")
                spans = [(select(at - 1) if at else 0, select(at)) for at in row["places"]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([row["doc_ids"][at] for at in row["places"]], pa.int64()),
                        "ids": pa.array([raw[a:b].astype(np.int64) for a, b in spans], pa.list_(pa.int64())),
                    },
                    schema=arrow,
                )

    return blocks.join(places, ["part", "block"]).mapInArrow(run, schema)


def token_files(docs: DataFrame, vocabulary: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write the file set and read it back."""
    path = path or work_folder(docs.sparkSession, "token-files")
    write_token_files(docs, path, vocabulary, end_id)
    return read_token_files(docs.sparkSession, path)
