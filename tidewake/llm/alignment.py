"""Alignment of two tokenizers: tokens of a byte-level BPE beside pieces of a sentence-piece model, by common ends.

Each tokenizer's cumulative ends are the keys of a dictionary to token numbers. Ends are byte offsets, so the dictionary is
a table with a place for each offset; the offsets that both have, in order, cut both id lists into slices. All ids of a
slice are linked with all on the other side. Long slices are not expanded pair by pair: equal ids of one side are counted
first, and so many links are one weighted pair.

Ids are made once and written; one pass over them counts for each id pair the documents that hold it, another looks the
counts up. The most frequent pairs, at most MOST_PAIRS, are read by the tasks themselves; if there are more, rarer ones are
joined by a shuffle, which has no hot keys then.

Cases: a text that is null or empty, or whose joined bytes on either side are not a blank and the text, has no tokens, zeros
and an empty string; special tokens' strings are plain text; rows are documents, whatever their ids; ties for the highest
count are all best; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.bpe import Encoder, LibraryWords, byte_alphabet
from tidewake.llm.common import Work, chunks, file_system, gather, text_bytes

#: Pairs whose counts a task reads; rarer ones beyond them are joined.
MOST_PAIRS = 4_000_000
#: Bytes of text that are encoded at a time, and of ids that are aligned at a time.
TEXT_BYTES, ID_BYTES = 1 << 20, 1 << 19
#: Pairs of a slice up to which it is expanded as it is, and pairs that are made at a time.
PLAIN, EXPANDED = 64, 1 << 20
#: Different pairs that a task holds before it passes their counts on.
HELD = 2_000_000
KEY_BITS = 32


class PlainWords(LibraryWords):
    """A byte-level vocabulary; the strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        self.special = b""
        alphabet, vocab = byte_alphabet(), self.library.get_vocab()
        self.entries = [b""] * (max(vocab.values()) + 1)
        for sign, i in vocab.items():
            self.entries[i] = bytes(alphabet[c] for c in sign) if all(c in alphabet for c in sign) else sign.encode()


class PieceWords:
    """A sentence-piece model that puts a blank before a text: blanks and what follows them are encoded on their own.

    No piece goes on after a sign other than a blank with a blank, so merges never cross such a place.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece has a blank after another sign: texts cannot be cut at blanks")
        self.entries = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.model.piece_to_id("▁")

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        begin = data == 0x20
        begin[1:] &= data[:-1] != 0x20
        begin[offsets[:-1][offsets[:-1] < len(data)]] = True
        return np.flatnonzero(begin)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [x or [self.blank] for x in self.model.encode([w[1:].decode() for w in words], num_threads=1)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum())), lengths


class Side:
    """One tokenizer of a worker: its encoder, and the bytes of its entries."""

    def __init__(self, words):
        self.coder = Encoder(words)
        self.size = np.array([len(e) for e in words.entries], np.int64)
        self.pool, self.at = np.frombuffer(b"".join(words.entries), np.uint8), np.cumsum(self.size) - self.size
        digits = max(1, len(str(len(words.entries) - 1)))
        self.decimals = np.frombuffer(b"".join(str(i).encode().ljust(digits, b"\0") for i in range(len(words.entries))), np.uint8).reshape(-1, digits)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, where each text's begin, and whether they stand for exactly the text's bytes."""
        ids, at = self.coder.chunk(data, offsets)
        made = np.concatenate([[0], np.cumsum(self.size[ids])])[at]
        right = np.diff(made) == np.diff(offsets)
        whole = gather(self.pool, self.at[ids], self.size[ids])
        if right.all():
            differ = np.flatnonzero(whole != data)
            right[np.searchsorted(offsets, differ, "right") - 1] = False
        else:
            for k in np.flatnonzero(right).tolist():
                right[k] = bool((whole[made[k] : made[k + 1]] == data[offsets[k] : offsets[k + 1]]).all())
        return ids, at, right


@cache
def side(kind: type, path: str) -> Side:
    return Side(kind(path))


def led(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a blank before each."""
    return np.insert(data, offsets[:-1], 0x20), offsets + np.arange(len(offsets))


def _binary(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """Lists of ids as binary values."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * ids.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, a, b): the ids of each text, as unsigned 16-bit numbers, or nothing if a side does not give the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = side(PlainWords, path_a), side(PieceWords, path_b)
        if max(len(a.size), len(b.size)) > 1 << 16:
            raise ValueError("vocabularies of over 65,536 entries need wider ids")
        for batch in batches:
            whole, at = text_bytes(batch.column(1))
            for x, y in chunks(at, TEXT_BYTES):
                data, offsets = led(whole[at[x] : at[y]], at[x : y + 1] - at[x])
                (ids_a, at_a, right_a), (ids_b, at_b, right_b) = a.encode(data, offsets), b.encode(data, offsets)
                kept = right_a & right_b & (np.diff(offsets) > 1)
                out = []
                for ids, begin in ((ids_a, at_a), (ids_b, at_b)):
                    count = np.where(kept, np.diff(begin), 0)
                    out.append(_binary(gather(ids, begin[:-1], count).astype("<u2"), np.concatenate([[0], np.cumsum(count)])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), *out], ["doc_id", "a", "b"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, a binary, b binary")


class Slices:
    """The slices of a chunk of documents: a and b are ids, a_at and b_at where each document's begin."""

    def __init__(self, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
        self.a, self.a_at, self.b, self.b_at = a.astype(np.int64), a_at, b.astype(np.int64), b_at
        docs = len(a_at) - 1
        ends = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        places = int(ends[0][-1]) + 1 if len(a) else 1
        number = np.full((2, places), -1, np.int64)  # end to index, for each side
        for side_, e in enumerate(ends):
            number[side_, e] = np.arange(len(e))
        common = np.flatnonzero((number >= 0).all(axis=0))
        self.a_last, self.b_last = number[0, common], number[1, common]
        self.a_first, self.b_first = (np.concatenate([[0], x[:-1] + 1])[: len(common)] for x in (self.a_last, self.b_last))
        self.n_a, self.n_b = self.a_last - self.a_first + 1, self.b_last - self.b_first + 1
        self.doc = np.repeat(np.arange(docs), np.diff(a_at))[self.a_first] if len(a) else np.zeros(0, np.int64)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, links) of the different pairs of each document, sorted; a pair is a << KEY_BITS / 2 | b."""
        half = KEY_BITS // 2
        plain = self.n_a * self.n_b <= PLAIN
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for some in (np.flatnonzero(plain), np.flatnonzero(~plain)):
            if not len(some):
                continue
            a, a_n, a_times = self._ids(self.a, self.a_first[some], self.n_a[some], some[0:0] if plain[some[0]] else some)
            b, b_n, b_times = self._ids(self.b, self.b_first[some], self.n_b[some], some[0:0] if plain[some[0]] else some)
            b_begin = np.cumsum(b_n) - b_n
            group = np.repeat(np.arange(len(some)), a_n)
            width = b_n[group]  # partners of each id of side a
            until = np.concatenate([[0], np.cumsum(width)])
            x = 0
            while x < len(a):
                y = max(x + 1, int(np.searchsorted(until, until[x] + EXPANDED, "right")) - 1)
                w = width[x:y]
                at = np.repeat(b_begin[group[x:y]] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))
                code = np.repeat(self.doc[some][group[x:y]] << KEY_BITS | a[x:y] << half, w) | b[at]
                if a_times is None:
                    code.sort()
                    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                    parts.append((code[first], np.diff(np.append(first, len(code)))))
                else:
                    parts.append(_summed(code, np.repeat(a_times[x:y], w) * b_times[at]))
                x = y
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        code, n = parts[0] if len(parts) == 1 else _summed(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
        return code >> KEY_BITS, code & ((1 << KEY_BITS) - 1), n

    @staticmethod
    def _ids(ids: np.ndarray, first: np.ndarray, n: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Ids of slices, how many each slice has, and how often each occurs: counted slices have every id once."""
        flat = gather(ids, first, n)
        if not len(counted):
            return flat, n, None
        code, times = np.unique(np.repeat(np.arange(len(n)), n) << KEY_BITS | flat, return_counts=True)
        return code & ((1 << KEY_BITS) - 1), np.bincount(code >> KEY_BITS, minlength=len(n)), times

    def written(self, a: Side, b: Side) -> list[str]:
        """For each document the SHA-256 of its slices as a1,a2|b1;a3|b2,b3; an empty string without tokens."""
        digits = max(a.decimals.shape[1], b.decimals.shape[1])
        out = np.zeros((len(self.a) + len(self.b), digits + 1), np.uint8)
        out[:, digits] = ord(",")
        group_a, group_b = (np.repeat(np.arange(len(n)), n) for n in (self.n_a, self.n_b))
        out[np.arange(len(self.a)) + self.b_first[group_a], : a.decimals.shape[1]] = a.decimals[self.a]
        out[np.arange(len(self.b)) + self.a_last[group_b] + 1, : b.decimals.shape[1]] = b.decimals[self.b]
        out[self.a_last + self.b_first, digits] = ord("|")
        out[self.a_last + self.b_last + 1, digits] = ord(";")
        begin = self.a_at + self.b_at
        ends = begin[1:][np.diff(begin) > 0]
        out[ends - 1, digits] = 0
        kept = out.ravel() != 0
        at = np.concatenate([[0], np.cumsum(kept)])[begin * (digits + 1)].tolist()
        text = memoryview(out.ravel()[kept].tobytes())
        return [hashlib.sha256(text[x:y]).hexdigest() if y > x else "" for x, y in zip(at, at[1:])]


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(n, first)


def _id_chunks(batch: pa.RecordBatch, column: int, a: Side, b: Side) -> Iterator[tuple[int, int, Slices]]:
    """Slices of the rows x .. y - 1 of a batch, whose ids a and b are in two columns from `column`."""
    flat, at = zip(*(_flat(batch.column(column + k)) for k in (0, 1)))
    for x, y in chunks(2 * at[0], ID_BYTES):
        yield x, y, Slices(*(z for f, t in zip(flat, at) for z in (f[t[x] : t[y]], t[x : y + 1] - t[x])), a.size, b.size)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of binary values, and where each value's begin."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return np.frombuffer(raw[offsets[0] : offsets[-1]].tobytes(), "<u2"), (offsets - offsets[0]) // 2


def pair_counts(ids: DataFrame, path_a: str, path_b: str, held: int = HELD) -> DataFrame:
    """(key, n): parts of the number of documents that hold each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = side(PlainWords, path_a), side(PieceWords, path_b)
        known, count = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(known), pa.array(count)], ["key", "n"])

        for batch in batches:
            for _, _, slices in _id_chunks(batch, 0, a, b):
                key, n = np.unique(slices.links()[1], return_counts=True)
                known, count = _summed(np.concatenate([known, key]), np.concatenate([count, n])) if len(known) + len(key) else (known, count)
                if len(known) > held:
                    yield told()
                    known, count = known[:0], count[:0]
        yield told()

    return ids.select("a", "b").mapInArrow(run, "key bigint, n bigint")


@lru_cache(maxsize=1)
def _table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that this worker looks up: keys in order, counts, and whether they are their id's highest."""
    fs, root = file_system(path)
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet")]
    found = [pq.read_table(f, filesystem=fs, columns=["key", "n", "best"]) for f in sorted(files)]
    key, n, best = (np.concatenate([np.asarray(t[c]) for t in found] or [np.zeros(0, np.int64)]) for c in ("key", "n", "best"))
    order = np.argsort(key)
    return key[order], n[order].astype(np.int64), best[order].astype(np.int64)


def _frequent(counts: DataFrame, most: int) -> int:
    """The least count of the pairs that tasks look up: a bound of which at most `most` pairs are not under it."""
    level = F.floor(F.log2("n") * 8).cast("int")
    rows = counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs"), F.min("n").alias("n")).orderBy(F.desc("level")).collect()
    taken, least = 0, (1 << 63) - 1
    for r in rows:
        taken += r["pairs"]
        if taken > most:
            break
        least = r["n"]
    return least


def align(docs: DataFrame, path_a: str, path_b: str, most_pairs: int = MOST_PAIRS, held: int = HELD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    work = Work(docs.sparkSession, "alignment")
    ids = work.save(encoded(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "ids")
    counts = work.save(pair_counts(ids, path_a, path_b, held).groupBy("key").agg(F.sum("n").alias("n")), "counts")
    first = F.shiftright("key", KEY_BITS // 2).alias("first")
    highest = counts.groupBy(first).agg(F.max("n").alias("highest"))
    marked = counts.select("key", "n", first).join(highest, "first").select("key", "n", (F.col("n") == F.col("highest")).alias("best"))
    marked = work.save(marked, "pairs")
    least = _frequent(marked, most_pairs)
    work.save(marked.filter(F.col("n") >= least), "frequent")
    rare = marked.filter(F.col("n") < least)
    some = not rare.isEmpty()
    path, kind = work.path("frequent"), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = side(PlainWords, path_a), side(PieceWords, path_b)
        keys, n, best = _table(path)
        for batch in batches:
            for x, y, slices in _id_chunks(batch, 2, a, b):
                doc, pair, links = slices.links()
                at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
                known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
                count, top = (np.where(known, v[at], 0) if len(keys) else np.zeros(len(pair), np.int64) for v in (n, best))
                edge = np.searchsorted(doc, np.arange(y - x + 1))
                total = [np.diff(np.concatenate([[0], np.cumsum(v)])[edge]) for v in (links, links * top, links * count)]
                rest = np.flatnonzero(~known)
                open_ = pa.StructArray.from_arrays([pa.array(pair[rest]), pa.array(links[rest])], ["key", "links"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rest, edge).astype(np.int32)), open_)
                groups = np.bincount(slices.doc, minlength=y - x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(x, y - x), batch.column(1).slice(x, y - x), *[pa.array(v.astype(np.int64)) for v in (np.diff(slices.a_at), np.diff(slices.b_at), groups, *total)], pa.array(slices.written(a, b), pa.string()), lists],
                    ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "rest"],
                )

    out = ids.select("doc_id", "row", "a", "b").mapInArrow(run, f"doc_id {kind}, row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, rest array<struct<key: bigint, links: bigint>>")
    if some:
        out = work.save(out, "partial")
        met = out.select("row", F.explode("rest").alias("x")).select("row", "x.*").join(rare, "key")
        more = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
        out = out.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
