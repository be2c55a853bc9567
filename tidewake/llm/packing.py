"""Hierarchical packing of documents into sequences of several context sizes.

Each document's ids and an end id fill whole windows of the largest size first; what is left is routed to the
smallest tier (1024, 512, 256, 128) that holds it. From the largest tier down, each routed piece opens a window of its
tier, and the window's gap is filled from the shorter tiers: the longest piece that fits, and at the end a cut piece.
Windows are thus full, and a tier's sequences, all of one length, are dealt into step groups of equal tokens. What does
not fill a window waits for the next block of the partition; its last block ends in sequences at powers of two.

Work stays where the texts are read: no shuffle, and a worker holds one block of waiting pieces. A partition's sequences
have ids of their own range.

Cases: a null or empty text is its end id alone; repeated rows are packed each; an empty table gives no rows; other
columns are left out.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidewake.llm.bpe import LibraryWords, encoder
from tidewake.llm.common import text_chunks

TIERS = (1024, 512, 256, 128)
#: Waiting ids at which a block is packed.
BLOCK_IDS = 1 << 19
#: Ids of a step group: sequences of one tier whose lengths add up to it.
STEP_IDS = 1 << 16
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
SCHEMA = "{}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint"


class Waiting:
    """Pieces by length: the longest of at most a given length comes out first."""

    def __init__(self):
        self.lengths: list[int] = []
        self.by_length: dict[int, list] = {}
        self.ids = 0

    def put(self, piece: tuple) -> None:
        n = len(piece[2])
        if n not in self.by_length:
            bisect.insort(self.lengths, n)
            self.by_length[n] = []
        self.by_length[n].append(piece)
        self.ids += n

    def take(self, at: int) -> tuple:
        n = self.lengths[at]
        held = self.by_length[n]
        piece = held.pop()
        if not held:
            del self.by_length[n], self.lengths[at]
        self.ids -= n
        return piece

    def fitting(self, most: int) -> tuple | None:
        at = bisect.bisect_right(self.lengths, most) - 1
        return self.take(at) if at >= 0 else None


class Packer:
    """Packs the documents of one partition. A piece is (document, its start there, ids, the document's ids)."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, step_ids: int = STEP_IDS):
        self.first, self.count, self.tiers, self.step_ids = partition << 36, 0, tiers, step_ids
        self.waiting, self.of_tier = Waiting(), {}
        self.rows: list[list] = [[] for _ in NAMES]

    def add(self, doc, ids: np.ndarray) -> None:
        n, most = len(ids), self.tiers[0]
        full = n - n % most
        for a in range(0, full, most):
            self.emit([(doc, a, ids[a : a + most], n)], most)
        if n > full:
            self.waiting.put((doc, full, ids[full:].copy(), n))
        if self.waiting.ids >= BLOCK_IDS:
            self.pack()

    def emit(self, pieces: list[tuple], tier: int) -> None:
        k = self.of_tier[tier] = self.of_tier.get(tier, -1) + 1
        group = self.first + (k // max(1, self.step_ids // tier) << 11) + tier
        offset, sequence = 0, self.first + self.count
        self.count += 1
        for doc, start, ids, n in pieces:
            for column, value in zip(self.rows, (doc, start, len(ids), zlib.crc32(ids.astype("<u4")), n, sequence, offset, tier, group)):
                column.append(value)
            offset += len(ids)

    def pack(self) -> None:
        """Full windows of every tier from what waits; the rest waits on."""
        w = self.waiting
        for tier, below in zip(self.tiers, (*self.tiers[1:], 0)):
            while w.lengths and below < w.lengths[-1] <= tier and w.ids >= tier:
                window = [w.take(len(w.lengths) - 1)]
                gap = tier - len(window[0][2])
                while gap:
                    piece = w.fitting(gap)
                    if piece is None:
                        doc, start, ids, n = w.take(0)
                        piece = (doc, start, ids[:gap], n)
                        w.put((doc, start + gap, ids[gap:], n))
                    window.append(piece)
                    gap -= len(piece[2])
                self.emit(window, tier)

    def end(self) -> None:
        """The last pieces of the partition, in windows at powers of two."""
        self.pack()
        w, window = self.waiting, []
        while w.ids:
            tier = min(self.tiers[0], 1 << w.ids.bit_length() - 1)
            window, gap = [], tier
            while gap:
                doc, start, ids, n = w.take(len(w.lengths) - 1)
                window.append((doc, start, ids[:gap], n))
                if len(ids) > gap:
                    w.put((doc, start + gap, ids[gap:], n))
                gap -= min(gap, len(ids))
            self.emit(window, tier)

    def batch(self, kinds: list[pa.DataType]) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.rows, kinds)], NAMES)
        self.rows = [[] for _ in NAMES]
        return out


def pack(docs: DataFrame, path: str, end_id: int = 0, tiers: tuple[int, ...] = TIERS, step_ids: int = STEP_IDS) -> DataFrame:
    """A row per piece: which ids of which document lie where in which sequence, its tier and step group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer, kinds = encoder(LibraryWords, path), Packer(TaskContext.get().partitionId(), tiers, step_ids), None
        for batch in batches:
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 6, pa.int32(), pa.int64()]
            for a, b, data, offsets in text_chunks(batch.column(1)):
                ids, before = coder.chunk(data, offsets)
                ids = np.insert(ids, before[1:], end_id)
                cut = (before + np.arange(len(before))).tolist()
                for doc, x, y in zip(batch.column(0).slice(a, b - a).to_pylist(), cut, cut[1:]):
                    packer.add(doc, ids[x:y])
                yield packer.batch(kinds)
        if kinds:
            packer.end()
            yield packer.batch(kinds)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA.format(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"))
