"""Token-id shards: a concatenated id array whose document boundaries are Elias-Fano coded.

A shard is `ids | document ids | boundaries | footer`. Ids take two bytes where every id of the shard's vocabulary
fits, else four. Boundaries (and the ascending document ids) are kept as an Elias-Fano sequence: the low bits of each
value packed, the high bits in unary, and the place of every STRIDE-th one bit in 32 bits, so that select needs no
64-bit table. Offsets within a shard plus the shard's base give the start in the whole corpus.

Cases: a null text has only the end id; rows without a document id come first; repeated document ids keep their rows,
ordered by text; an empty table gives no shard and no rows; further columns are left out.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.bpe import LibraryWords, encoder
from tidewake.llm.common import Work, chunks, file_system, text_chunks

MAGIC = b"TWIDEF01"
FOOTER = "<QQQQQB7x"  # rows, rows without an id, ids, bytes of the document ids' part, of the boundaries' part, bytes an id
STRIDE = 256
#: Rows whose boundaries are decoded at a time, and ids that are read at a time (or those of one longer document).
READ_ROWS, READ_IDS = 2048, 1 << 18


class EliasFano:
    """A non-decreasing sequence of non-negative integers in about 2 + log2(most / n) bits each."""

    HEAD = struct.Struct("<QQBQQ")  # n, first value, low bits, bytes of low bits, bytes of high bits

    def __init__(self, n: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.low_bits, self.low, self.high, self.samples = n, base, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        base = int(values[0]) if n else 0
        rest = (values.astype(np.int64) - base).astype(np.uint64)
        most = int(rest[-1]) if n else 0
        low_bits = max(0, (most // max(n, 1)).bit_length() - 1)
        bits = np.zeros((n, low_bits), np.uint8)
        for k in range(low_bits):
            bits[:, k] = (rest >> np.uint64(k)) & np.uint64(1)
        places = (rest >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((most >> low_bits) + n + 1, np.uint8)
        unary[places] = 1
        return cls(n, base, low_bits, np.packbits(bits.ravel(), bitorder="little"), np.packbits(unary, bitorder="little"), places[::STRIDE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.base & (1 << 64) - 1, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, base, low_bits, a, b = cls.HEAD.unpack_from(raw)
        at, data = cls.HEAD.size, np.frombuffer(raw, np.uint8)
        return cls(n, base - (1 << 64) * (base >> 63), low_bits, data[at : at + a], data[at + a : at + a + b], np.frombuffer(raw, "<u4", -(-n // STRIDE), at + a + b))

    def select(self, a: int, b: int) -> np.ndarray:
        """Values a .. b - 1: from the sample before a, the places of the one bits less their number are the high parts."""
        if a >= b:
            return np.zeros(0, np.int64)
        first = a // STRIDE
        begin = int(self.samples[first]) // 8
        end = int(self.samples[-(-b // STRIDE)]) // 8 + 1 if -(-b // STRIDE) < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little")) + 8 * begin
        ones = ones[np.searchsorted(ones, int(self.samples[first])) :][a - first * STRIDE : b - first * STRIDE]
        out = (ones - np.arange(a, b)) << self.low_bits
        if self.low_bits:
            begin, end = a * self.low_bits, b * self.low_bits
            bits = np.unpackbits(self.low[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :][: end - begin]
            out = out + bits.reshape(b - a, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out + self.base


def write_shards(docs: DataFrame, path: str, work: Work, end_id: int = 0) -> DataFrame:
    """Encode every text, append the end id, write shards in ascending doc_id order; returns the manifest.

    Texts are dealt by ranges of doc_id and encoded after the shuffle, so ids are never shuffled. A task streams its ids
    into one new file; only files of tasks that succeeded are in the manifest, so a retry leaves no double rows.
    """
    folder = work.path("shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(LibraryWords, path)
        files, root = file_system(folder)
        files.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{root}/{part:06d}-{uuid.uuid4().hex}.ids"
        ends, keys, missing, total, out = [np.zeros(1, np.int64)], [], 0, 0, None
        kind = np.dtype("<u2") if coder.words.library.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else np.dtype("<u4")
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1)):
                ids, before = coder.chunk(data, offsets)
                out = out or files.open_output_stream(name)
                out.write(np.insert(ids.astype(kind), before[1:], end_id).tobytes())
                ends.append(total + before[1:] + np.arange(1, b - a + 1))
                total = int(ends[-1][-1])
                some = batch.column(0).slice(a, b - a)
                missing += some.null_count
                keys.append(some.drop_null().to_numpy(zero_copy_only=False))
        if out is None:
            return
        ids_part, ends_part = EliasFano.of(np.concatenate(keys)).to_bytes(), EliasFano.of(np.concatenate(ends)).to_bytes()
        rows = sum(map(len, keys)) + missing
        out.write(ids_part + ends_part + struct.pack(FOOTER, rows, missing, total, len(ids_part), len(ends_part), kind.itemsize) + MAGIC)
        out.close()
        yield pa.RecordBatch.from_pydict({"shard": [part], "file": [name.rpartition("/")[2]], "rows": [rows], "n_ids": [total]})

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return work.save(ordered.mapInArrow(run, "shard bigint, file string, rows bigint, n_ids bigint"), "manifest")


class Shard:
    """Random access to one file."""

    def __init__(self, folder: str, name: str):
        files, root = file_system(folder)
        self.file = files.open_input_file(f"{root}/{name}")
        size = self.file.size()
        tail = self.file.read_at(struct.calcsize(FOOTER) + len(MAGIC), size - struct.calcsize(FOOTER) - len(MAGIC))
        if tail[struct.calcsize(FOOTER) :] != MAGIC:
            raise ValueError(f"{name} is not a complete shard")
        self.rows, self.missing, self.n_ids, a, b, width = struct.unpack(FOOTER, tail[: struct.calcsize(FOOTER)])
        at = size - struct.calcsize(FOOTER) - len(MAGIC) - a - b
        self.kind = np.dtype(f"<u{width}")
        self.doc_ids, self.ends = EliasFano.from_bytes(self.file.read_at(a, at)), EliasFano.from_bytes(self.file.read_at(b, at + a))

    def offsets(self, a: int, b: int) -> np.ndarray:
        """Where rows a .. b - 1 start, and where the last ends."""
        return self.ends.select(a, b + 1)

    def ids(self, start: int, end: int) -> np.ndarray:
        w = self.kind.itemsize
        return np.frombuffer(self.file.read_at((end - start) * w, start * w), self.kind)

    def keys(self, a: int, b: int) -> list[int | None]:
        return [None] * max(0, min(b, self.missing) - a) + self.doc_ids.select(max(a - self.missing, 0), max(b - self.missing, 0)).tolist()


def read_shards(manifest: DataFrame, work: Work) -> DataFrame:
    """A row per document from the files: doc_id, start in the whole corpus, n_tokens and the ids' checksum.

    The manifest has a row per file, so its running sum on the driver grows with the number of files only.
    """
    folder, spark = work.path("shards"), manifest.sparkSession
    found = sorted(manifest.collect(), key=lambda r: r["shard"])
    base, tasks = 0, []
    for r in found:
        tasks.append((r["file"], base))
        base += r["n_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(folder, name)
                for a in range(0, shard.rows, READ_ROWS):
                    b = min(a + READ_ROWS, shard.rows)
                    at, sums = shard.offsets(a, b), []
                    for x, y in chunks(at - at[0], READ_IDS):
                        raw = memoryview(shard.ids(int(at[x]), int(at[y])).astype("<u4")).cast("B")
                        cut = (4 * (at[x : y + 1] - at[x])).tolist()
                        sums += [zlib.crc32(raw[i:j]) for i, j in zip(cut, cut[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.keys(a, b), pa.int64()), pa.array(first + at[:-1]), pa.array(np.diff(at)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    plan = spark.createDataFrame(tasks, "file string, base bigint").repartition(max(1, len(tasks)))
    return plan.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def boundaries(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Write the shards of a table and return what its files say about each document."""
    work = Work(docs.sparkSession, "token-ids")
    return read_shards(write_shards(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), path, work, end_id), work)
