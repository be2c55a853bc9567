"""Repeated word windows by recompression: rounds that name runs and pairs of symbols alike everywhere.

Words are the first symbols. A round splits the symbols into left and right ones by a bit of their name and names every
pair of a left one before a right one; the first round names runs of equal words before that. A name is a 64-bit
fingerprint of what it stands for, so tasks agree on names without a dictionary. Whether a symbol stands where it does
depends on few words around it, which every round carries along: a symbol's reach. Equal windows hold the same symbols
of which the reach lies inside. Each window takes, at the highest level that has such symbols, the one of least mixed
name as its anchor; windows in a row with one anchor are a segment.

The words in the anchor's reach are the segment's key. Only keys that occur twice can hold a repeated window. Segments
of equal words repeat as a whole; of other segments with a common key, one of each wording is compared window by window.
Fingerprints of compared words have 128 bits.

Cases: null or empty texts and texts shorter than a window keep every word; a window may overlap its earlier copy; each row
is a document of its own, also rows that share an id or have none: rows come in the order of their ids, those without one
last, and rows of one id in the order of their texts' SHA-256; equal rows are told apart, so one of them keeps its words; an
empty table gives no rows; other columns pass untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import BASES, MIX, Work, chunks, few, mix, span_hashes, text_bytes, unused

ROUNDS = 2
#: Bytes of text whose words are named at a time.
SPAN_BYTES = 1 << 18
#: A missing doc_id, in comparisons.
LAST = (1 << 63) - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of many texts, and the first word of each text."""
    inside = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begin[cut], end[cut - 1] = inside[cut], inside[cut - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def levels(names: np.ndarray, rounds: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(names, begin of reach, end of reach) of the symbols of each level, words first."""
    lo = np.arange(len(names))
    hi = lo + 1
    out = [(names, lo, hi)]
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else lo
    count = np.diff(np.append(first, len(names)))
    last = first + count - 1
    names, lo, hi = np.where(count > 1, mix(names[first] + count.astype(np.uint64) * np.uint64(MIX[0])), names[first]), lo[np.maximum(first - 1, 0)], hi[np.minimum(last + 1, len(hi) - 1)] if len(hi) else hi
    for k in range(rounds):
        right = (mix(names + np.uint64((2 * k + 1) * BASES[1] & (1 << 64) - 1)) >> np.uint64(63)).astype(bool)
        merged = np.zeros(len(names), bool)  # symbol i is the left one of a pair
        merged[:-1] = ~right[:-1] & right[1:]
        head = np.ones(len(names), bool)
        head[1:] = ~merged[:-1]
        at = np.flatnonzero(head)
        pair = merged[at]
        after = np.minimum(at + 1, len(names) - 1)
        before = np.maximum(at - 1, 0)
        new_lo = np.where(right[at] & ~pair, lo[before], lo[at])
        new_hi = np.where(pair | ~right[at], hi[after], hi[at])
        names = np.where(pair, mix(names[at] * np.uint64(BASES[0]) + mix(names[after]) + np.uint64(k + 1)), names[at])
        lo, hi = new_lo, new_hi
        out.append((names, lo, hi))
    return out


def segments(names: np.ndarray, ends: np.ndarray, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, begin and end of the anchor's reach of every segment.

    names has a separator before the first and after each text, ends the place of the separator that ends each place's text.
    """
    s = np.flatnonzero(np.arange(len(names)) + window <= ends)
    lo_of, hi_of = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    left = s
    for symbols, lo, hi in reversed(levels(names, rounds)):
        if not len(left):
            break
        a = np.searchsorted(lo, left)
        b = np.searchsorted(hi, left + window, "right")
        found = b > a
        here, a, b = left[found], a[found], b[found]
        if len(here):
            order = mix(symbols ^ np.uint64(MIX[1]))
            best, least = a.copy(), order[a]
            for k in range(1, int((b - a).max())):
                at = np.minimum(a + k, len(order) - 1)
                better = (a + k < b) & (order[at] < least)
                best, least = np.where(better, at, best), np.where(better, order[at], least)
            lo_of[here], hi_of[here] = lo[best], hi[best]
        left = left[~found]
    if not len(s):
        return s, s, s, s
    new = np.ones(len(s), bool)
    new[1:] = (np.diff(s) != 1) | (lo_of[s[1:]] != lo_of[s[:-1]]) | (hi_of[s[1:]] != hi_of[s[:-1]])
    at = np.flatnonzero(new)
    return s[at], np.diff(np.append(at, len(s))), lo_of[s[at]], hi_of[s[at]]


class Words:
    """The words of a chunk of texts as two kinds of names, with a separator before the first and after each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.stops, self.first = words(data, offsets)
        self.count = np.diff(self.first)
        texts = len(self.count)
        place = np.arange(len(self.starts)) + np.repeat(np.arange(texts), self.count) + 1
        self.begin = self.first[:-1] + np.arange(texts) + 1  # place of a text's first word
        size = len(self.starts) + texts + 1
        self.names, self.other = np.empty(size, np.uint64), np.empty(size, np.uint64)
        separators = np.append(self.begin + self.count, 0)
        self.names[separators] = self.other[separators] = mix(np.arange(texts + 1, dtype=np.uint64) + np.uint64(BASES[1]))
        self.names[place], self.other[place] = span_hashes(data, self.starts, self.stops), span_hashes(data, self.starts, self.stops, BASES[1])
        self.ends = np.append(0, np.repeat(separators[:-1], self.count + 1))
        self.text = np.append(0, np.repeat(np.arange(texts), self.count + 1))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two fingerprints of the words of each span."""
        return span_hashes(self.names, starts, ends), span_hashes(self.other, starts, ends, BASES[1])


def chunked(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(column))
        for a, b in chunks(offsets, SPAN_BYTES):
            yield batch.slice(a, b - a), Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def sliced(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows in batches of CHUNK_BYTES of text, or one longer text."""
    for batch in batches:
        for a, b in chunks(text_bytes(batch.column(column))[1]):
            yield batch.slice(a, b - a)


def keyed(docs: DataFrame, work: Work, doc: str = "doc", tie: str = "tie") -> DataFrame:
    """The documents with a key of their own, (doc, tie): tie is 0 but in rows that share an id or have none.

    Those rows are dealt out by ranges of (doc, digest of the text), equal ones by chance, and numbered in that order. The
    numbers are written, so every plan that reads them finds the same.
    """
    shared = work.save(docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select("doc_id"), "shared_ids")
    at = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))
    plain = docs.withColumns({doc: at, tie: F.lit(0).cast("bigint")})
    if shared.isEmpty():
        return plain
    known = few(shared.filter("doc_id IS NOT NULL"))
    named, digest, chance = docs.filter("doc_id IS NOT NULL"), unused("digest", docs.columns), unused("chance", docs.columns)
    odd = docs.filter("doc_id IS NULL").unionAll(named.join(known, "doc_id", "left_semi").select(docs.columns))
    odd = odd.withColumns({doc: at, digest: F.sha2("text", 256), chance: F.rand()}).repartitionByRange(doc, digest, chance).sortWithinPartitions(doc, digest, chance)
    odd = work.save(odd.withColumn(tie, F.monotonically_increasing_id() + 1).drop(digest, chance), "shared_rows")
    return plain.filter("doc_id IS NOT NULL").join(known, "doc_id", "left_anti").select(odd.columns).unionAll(odd)


def places(batch: pa.RecordBatch, text: np.ndarray) -> list[pa.Array]:
    """Keys (doc, tie), the first two columns, of the texts with these numbers."""
    return [batch.column(k).take(pa.array(text)) for k in (0, 1)]


def anchors(docs: DataFrame, window: int, full: bool) -> DataFrame:
    """The segments of every text (doc, tie, text): key, and with full their words' fingerprints c1 and c2, place and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in chunked(batches, 2):
            s, n, lo, hi = segments(w.names, w.ends, window)
            out = [pa.array(span_hashes(w.names, lo, hi).view(np.int64))]
            if full:
                c1, c2 = w.spans(s, s + n - 1 + window)
                text = w.text[s]
                out += [pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), *places(batch, text), pa.array((s - w.begin[text]).astype(np.int32)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, ["key", "c1", "c2", "doc", "tie", "start", "n"][: len(out)])

    return docs.select("doc", "tie", "text").mapInArrow(run, "key bigint" + ", c1 bigint, c2 bigint, doc bigint, tie bigint, start int, n int" * full)


def windows(marked: DataFrame, window: int) -> DataFrame:
    """(w1, w2, doc, tie, start) of every window of the segments `spans` of (doc, tie, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in chunked(batches, 2):
            spans = batch.column(3).fill_null([]) if batch.column(3).null_count else batch.column(3)
            text = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
            flat = spans.flatten()
            start, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            row = np.repeat(np.arange(len(n)), n)
            at = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            place = w.begin[text[row]] + at
            w1, w2 = w.spans(place, place + window)
            yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), *places(batch, text[row]), pa.array(at.astype(np.int32))], ["w1", "w2", "doc", "tie", "start"])

    return marked.select("doc", "tie", "text", "spans").mapInArrow(run, "w1 bigint, w2 bigint, doc bigint, tie bigint, start int")


#: Where a segment or window stands, in the order of documents.
PLACE = ("doc", "tie", "start")


def _later(rows: DataFrame, by: list[str]) -> DataFrame:
    """Those of the rows whose place is not the first of their group.

    Groups are reduced before the shuffle, and their rows are joined on one key more, so a large group can be split.
    """
    place = F.struct(*PLACE)
    first = rows.groupBy(by).agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1").select(*by, "first")
    key = F.xxhash64(*by)
    return rows.withColumn("k", key).join(first.withColumn("k", key), ["k", *by]).filter(place > F.col("first"))


def _spans(rows: DataFrame, name: str) -> DataFrame:
    """One row per document with its (start, n) spans: as many as the document has segments at most."""
    return rows.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n")).alias(name))


def marked(docs: DataFrame, window: int = 20, name: str = "spans") -> DataFrame:
    """The documents with a column of (start, n) for windows start .. start + n - 1 that repeat an earlier window."""
    doc = unused("doc", docs.columns)
    tie = unused("tie", docs.columns)
    work = Work(docs.sparkSession, "recompression")
    whole = keyed(docs, work, doc, tie)
    texts = whole.select(F.col(doc).alias("doc"), F.col(tie).alias("tie"), "text")
    keys = work.save(anchors(texts, window, full=False).groupBy("key").count().filter("count > 1").select("key"), "keys")
    near = work.save(anchors(texts, window, full=True).join(keys, "key"), "segments")
    work.drop("keys")
    place = F.struct(*PLACE)
    wordings = work.save(near.groupBy("key", "c1", "c2", "n").agg(F.min(place).alias("first"), F.count("*").alias("times")), "wordings")
    several = wordings.groupBy("key").count().filter("count > 1").select("key")
    compared = wordings.withColumn("k", F.xxhash64("key")).join(several.withColumn("k", F.xxhash64("key")), ["k", "key"]).select("first.*", "n")
    compared = work.save(_spans(compared, "spans"), "compared")
    repeated = near.join(wordings.filter("times > 1").select("key", "c1", "c2", "n", "first"), ["key", "c1", "c2", "n"]).filter(place > F.col("first")).select(*PLACE, "n")
    pieces = work.save(windows(texts.join(compared, ["doc", "tie"]), window), "windows")
    found = work.save(_spans(repeated.unionAll(_later(pieces, ["w1", "w2"]).select(*PLACE, F.lit(1).alias("n"))), name), "spans")
    work.keep("spans", "shared_rows", "shared_ids")
    return whole.join(found.withColumnsRenamed({"doc": doc, "tie": tie}), [doc, tie], "left").drop(doc, tie)


def covered(count: int, starts: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which of a text's words lie in a window of the spans."""
    edge = np.zeros(count + 1, np.int64)
    np.add.at(edge, np.minimum(starts, count), 1)
    np.add.at(edge, np.minimum(starts + n - 1 + window, count), -1)
    return np.cumsum(edge[:-1]) > 0


def kept_words(text: str | None, spans: list[dict] | None, window: int) -> tuple[list[bytes], int]:
    """The words of a text that no marked window covers, and the number of all its words."""
    found = (text or "").encode().split()
    if not spans:
        return found, len(found)
    starts, n = (np.array([x[k] for x in spans], np.int64) for k in ("start", "n"))
    gone = covered(len(found), starts, n, window)
    return [x for x, g in zip(found, gone.tolist()) if not g], len(found)


def without_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """The documents with repeated windows cut out of their text: white space between kept words stays as it was.

    A text without repeats passes unchanged; n_chars, where there is such a column, follows the new text.
    """
    columns = docs.columns

    def cut(texts: pa.Array, spans: pa.Array) -> list[str | None]:
        out = []
        for text, marks in zip(texts.to_pylist(), spans.to_pylist()):
            if text and marks:
                raw = text.encode()
                data = np.frombuffer(raw, np.uint8)
                begin, end, _ = words(data, np.array([0, len(data)]))
                starts, n = (np.array([x[k] for x in marks], np.int64) for k in ("start", "n"))
                gone = np.flatnonzero(covered(len(begin), starts, n, window))
                edge = np.zeros(len(data) + 1, np.int64)  # a cut word goes with the white space after it
                np.add.at(edge, begin[gone], 1)
                np.add.at(edge, np.append(begin, len(data))[gone + 1], -1)
                text = data[np.cumsum(edge[:-1]) == 0].tobytes().decode()
            out.append(text)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, columns.index("text")):
            data = {c: batch.column(k) for k, c in enumerate(columns)}
            data["text"] = pa.array(cut(data["text"], batch.column(len(columns))), pa.string())
            if "n_chars" in data:
                import pyarrow.compute as pc

                data["n_chars"] = pc.if_else(pc.is_valid(batch.column(len(columns))), pc.utf8_length(data["text"]).cast(data["n_chars"].type), data["n_chars"])
            yield pa.RecordBatch.from_arrays([data[c] for c in columns], columns)

    spans = unused("spans", columns)
    return marked(docs, window, spans).select(*columns, spans).mapInArrow(run, docs.schema)
