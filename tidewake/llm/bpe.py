"""Byte-level BPE of whole texts: vectorised pre-tokens, distinct pre-tokens encoded once, and the segment-tree encoder.

A byte-level BPE encodes each pre-token on its own, so a worker keeps the ids of the pre-tokens that it has met, with
their bytes, and asks an encoder only for new ones. Two encoders give the same ids: `LibraryWords` asks the tokenizers library, and
`SegmentTreeWords` keeps the ranks of adjacent pairs in a segment tree whose root is the leftmost lowest-rank merge.

Cases: a null text has no ids and decodes to the empty text; the text of a special token inside a text becomes that
token's id, as the library does by default; ties of rank go to the leftmost pair; other columns pass untouched.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewake.llm.common import gather, span_hashes, text_chunks

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Distinct pre-tokens whose ids a worker keeps, and bytes of their text; beyond either the store starts anew. Longer
#: pre-tokens than LONG_WORD bytes are encoded each time and not kept. All three bound memory, not results.
KEPT_WORDS, KEPT_BYTES, LONG_WORD = 2_000_000, 24 << 20, 1024

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other, as the tokenizers library has them.

    Two Unicode databases are at hand, of other versions than the library's; where they differ the library is asked.
    """
    global _classes
    if _classes is None:
        points = [*range(0xD800), *range(0xE000, 0x110000)]
        every, at = "".join(map(chr, points)), np.array(points)
        one, two = np.full(0x110000, OTHER, np.uint8), np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                one[at[m.start() : m.end()]] = kind
        two[at] = [{"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER) for c in every]
        two[one == SPACE] = SPACE
        doubtful = np.flatnonzero(one != two)
        one[doubtful] = asked_classes(doubtful)
        _classes = one
    return _classes


def asked_classes(points: np.ndarray) -> np.ndarray:
    """Classes of code points by how the library cuts: a sign joins one of its own class and no other."""
    from tokenizers.pre_tokenizers import ByteLevel

    cut, out = ByteLevel(add_prefix_space=False, use_regex=True), np.full(len(points), SPACE, np.uint8)
    for kind, lead in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
        for a in range(0, len(points), 20_000):
            some = points[a : a + 20_000]
            text = "".join(f"\n\n{lead}{chr(c)}" for c in some)
            starts = np.zeros(len(text), bool)
            starts[[where[0] for _, where in cut.pre_tokenize_str(text)]] = True
            out[a : a + 20_000][~starts[3::4]] = kind
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offset and code point of every character of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    if len(at) == len(data):
        return at, lead
    cp, ext = lead.copy(), np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32) & 0x3F
    for least, most, mask, more in ((0xC0, 0xDF, 0x1F, 1), (0xE0, 0xEF, 0x0F, 2), (0xF0, 0xFF, 0x07, 3)):
        who = np.flatnonzero((lead >= least) & (lead <= most))
        value = lead[who] & mask
        for k in range(1, more + 1):
            value = (value << 6) | ext[at[who] + k]
        cp[who] = value
    return at, cp


def pre_tokens(data: np.ndarray, offsets: np.ndarray, special: bytes = b"") -> np.ndarray:
    """Byte offsets at which the pre-tokens of many texts start, ascending.

    The rules are those of the byte-level pattern of the public vocabulary: contractions of seven forms, one optional
    blank before a run of letters, numbers or other signs, and white space without its last sign before a word.
    `special` is taken out as a pre-token of its own before the rules apply.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    at, cp = code_points(data)
    n = len(at)
    kind = classes()[cp]
    fresh = np.zeros(n + 1, bool)  # a text or a piece beside a special token starts here
    fresh[np.searchsorted(at, offsets)] = True
    inside = []
    if special:
        raw, here = data.tobytes(), 0
        while (here := raw.find(special, here)) >= 0:
            end = here + len(special)
            if np.searchsorted(offsets, here, "right") == np.searchsorted(offsets, end - 1, "right"):
                a, b = np.searchsorted(at, (here, end))
                fresh[a] = fresh[b] = True
                inside.append((a, b))
                here = end
            else:
                here += 1
    fresh[n] = True
    starts = fresh[:n].copy()
    joined = ~fresh[1:n]  # character i + 1 belongs to the piece of character i
    starts[1:] |= kind[1:] != kind[:-1]
    starts[1:] &= ~(joined & (kind[1:] != SPACE) & (cp[:-1] == 0x20))  # a blank leads the word
    starts[:-1] |= joined & (kind[:-1] == SPACE) & (kind[1:] != SPACE)
    for i in np.flatnonzero((cp == 0x27) & starts):
        if i + 1 < n and not fresh[i + 1] and kind[i + 1] == LETTER:
            c = chr(cp[i + 1])
            more = 2 if c in "stmd" else 0
            if not more and i + 2 < n and not fresh[i + 2] and c + chr(cp[i + 2]) in ("re", "ve", "ll"):
                more = 3
            if more:
                starts[i + 1 : i + more] = False
                if i + more < n:
                    starts[i + more] = True
    for a, b in inside:
        starts[a + 1 : b] = False
    return at[starts]


class LibraryWords:
    """Ids of pre-tokens from the tokenizers library."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special, self.special_id = special_of(path)
        vocab = self.library.get_vocab()
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each id: a byte is one sign of its text
        for sign, i in vocab.items():
            self.size[i] = len(sign)

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return pre_tokens(data, offsets, self.special)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words with a leading blank go to the library in rows, which it cuts at the blanks; the ids' sizes tell them apart."""
        texts = [w.decode() for w in words]
        rowed = [k for k, t in enumerate(texts) if t[0] == " " and not t[-1].isspace() and words[k] != self.special]
        alone = sorted({*range(len(texts))}.difference(rowed))
        rows = ["".join([texts[k] for k in rowed[a : a + 500]]) for a in range(0, len(rowed), 500)] + [texts[k] for k in alone]
        found = [x.ids for x in self.library.encode_batch_fast(rows, add_special_tokens=False)]
        ids = np.fromiter((i for x in found for i in x), np.uint32, sum(map(len, found)))
        order = np.array(rowed + alone, np.int64)
        bounds = np.concatenate([[0], np.cumsum(np.array([len(w) for w in words], np.int64)[order])])
        at = np.searchsorted(np.concatenate([[0], np.cumsum(self.size[ids])]), bounds)
        lengths = np.empty(len(words), np.int64)
        lengths[order] = np.diff(at)
        starts = np.empty(len(words), np.int64)
        starts[order] = at[:-1]
        return gather(ids, starts, lengths), lengths


def special_of(path: str) -> tuple[bytes, int]:
    """Text and id of the vocabulary's special token; empty text if it has none."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    return (added[0]["content"].encode(), added[0]["id"]) if added else (b"", -1)


def byte_alphabet() -> dict[str, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary: itself, or the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class SegmentTreeWords:
    """Ids of pre-tokens by a segment tree over the ranks of adjacent pairs.

    Leaf i holds rank * width + i of the pair that starts at symbol i, an inner node the least of its two children.
    The root is therefore the leftmost pair of the lowest rank. A merge changes three leaves (the merged pair, the
    symbol that vanished, the pair to the left) and the nodes above them. Words of up to SHORT bytes run together, one
    tree a row; longer ones run one by one.
    """

    SHORT = 64

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        vocab, alphabet = made["model"]["vocab"], byte_alphabet()
        self.special, self.special_id = special_of(path)
        self.first = np.zeros(256, np.int64)
        for sign, b in alphabet.items():
            self.first[b] = vocab[sign]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in made["model"]["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.made_of = np.array([vocab[a + b] for a, b in pairs] + [0], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.by_key = dict(zip(key.tolist(), range(len(key))))
        self.none = len(pairs)
        texts: list[bytes] = [b""] * (max(max(vocab.values()), self.special_id) + 1)
        for sign, i in vocab.items():
            texts[i] = bytes(alphabet[c] for c in sign)
        if self.special:
            texts[self.special_id] = self.special
        lengths = np.array([len(t) for t in texts], np.int64)
        self.bytes, self.bytes_at, self.bytes_len = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or `none` where it does not merge or a side is missing (negative)."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], self.none)

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return pre_tokens(data, offsets, self.special)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        for width in (4, 8, 16, 32, self.SHORT):
            who = np.flatnonzero((sizes > (0 if width == 4 else width // 2)) & (sizes <= width))
            for a in range(0, len(who), 20_000):
                some = who[a : a + 20_000]
                for i, ids in zip(some.tolist(), self.together([words[i] for i in some], sizes[some], width)):
                    out[i] = ids
        for i in np.flatnonzero(sizes > self.SHORT).tolist():
            out[i] = self.alone(words[i])
        for i, w in enumerate(words):
            if w == self.special and w:
                out[i] = np.array([self.special_id], np.uint32)
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        return np.concatenate(out or [np.zeros(0, np.uint32)]).astype(np.uint32), lengths

    def together(self, words: list[bytes], sizes: np.ndarray, width: int) -> Iterator[np.ndarray]:
        m = len(words)
        column = np.arange(width)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(m, width)
        symbol = np.where(column < sizes[:, None], self.first[raw], -1)
        after = np.where(column + 1 < sizes[:, None], column + 1, width)  # width: none
        before = np.broadcast_to(column - 1, (m, width)).copy()
        symbol = np.concatenate([symbol, np.full((m, 1), -1)], axis=1)  # column `width` and column -1 hold no symbol
        none = self.none * width
        tree = np.full((m, 2 * width), none, np.int64)
        rank = self.rank(symbol[:, :width], symbol[:, 1:])
        tree[:, width:] = np.where(rank < self.none, rank * width + column, none)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        row = np.flatnonzero(tree[:, 1] < none)
        while len(row):
            root = tree[row, 1]
            i = root % width
            j = after[row, i]
            k = after[row, j]
            p = before[row, i]
            symbol[row, i] = self.made_of[root // width]
            symbol[row, j] = -1
            after[row, i] = k
            inner = k < width
            before[row[inner], k[inner]] = i[inner]
            right = self.rank(symbol[row, i], symbol[row, k])
            tree[row, width + i] = np.where(right < self.none, right * width + i, none)
            tree[row, width + j] = none
            had = p >= 0
            left = self.rank(symbol[row[had], p[had]], symbol[row[had], i[had]])
            tree[row[had], width + p[had]] = np.where(left < self.none, left * width + p[had], none)
            for leaf in (width + i, width + j, width + np.maximum(p, 0)):
                node = leaf >> 1
                while node[0]:
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                    node = node >> 1
            row = row[tree[row, 1] < none]
        kept = symbol[:, :width] >= 0
        ids = symbol[:, :width][kept].astype(np.uint32)
        yield from np.split(ids, np.cumsum(kept.sum(axis=1))[:-1])

    def alone(self, word: bytes) -> np.ndarray:
        n = len(word)
        width = 1 << (n - 1).bit_length()
        symbol = [int(self.first[b]) for b in word]
        after, before, ranks, made, none = [*range(1, n), -1], [*range(-1, n - 1)], self.by_key, self.made_of.tolist(), self.none * width
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = ranks.get(symbol[i] << 20 | symbol[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, value: int) -> None:
            node = width + leaf
            if tree[node] == value:
                return
            tree[node] = value
            while node := node >> 1:
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    return
                tree[node] = least

        while (root := tree[1]) < none:
            i = root % width
            j = after[i]
            symbol[i], symbol[j], after[i] = made[root // width], -1, after[j]
            put(j, none)
            value = none
            if (k := after[i]) >= 0:
                before[k] = i
                if (r := ranks.get(symbol[i] << 20 | symbol[k])) is not None:
                    value = r * width + i
            put(i, value)
            if (p := before[i]) >= 0:
                r = ranks.get(symbol[p] << 20 | symbol[i])
                put(p, none if r is None else r * width + p)
        return np.array([s for s in symbol if s >= 0], np.uint32)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and how many each id has."""
        lengths = self.bytes_len[ids]
        return gather(self.bytes, self.bytes_at[ids], lengths), lengths


class Encoder:
    """Ids of whole texts; keeps the ids of the pre-tokens that this worker has met."""

    def __init__(self, words):
        self.words = words
        self.forget()

    def forget(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.count, self.pool, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint16), 0
        self.text_at, self.text_len, self.text, self.text_used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint8), 0

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and the number of ids before each text and after the last.

        Pre-tokens are looked up by a fingerprint, and their bytes are compared with those of the one that is kept under
        it; one that differs is encoded on its own.
        """
        starts = self.words.cut(data, offsets)
        if not len(starts):
            return np.zeros(0, self.pool.dtype), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        who = np.flatnonzero(ends - starts <= LONG_WORD)
        keys, first, which = np.unique(span_hashes(data, starts[who], ends[who]), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, keys)
        new = np.ones(len(keys), bool)
        held = at < len(self.known)
        new[held] = self.known[at[held]] != keys[held]
        if new.any():
            bytes_ = int((ends - starts)[who[first[new]]].sum())
            if (len(self.known) + int(new.sum()) > KEPT_WORDS or self.text_used + bytes_ > KEPT_BYTES) and len(self.known):
                self.forget()
                at, new = np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
            self._keep(data, starts[who[first[new]]], ends[who[first[new]]], at[new], keys[new])
            at = np.searchsorted(self.known, keys)
        slot = self.slot[at][which]
        count, begin = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        count[who], begin[who], pool = self.count[slot], self.at[slot], self.pool
        other = np.ones(len(starts), bool)
        other[who] = self._others(data, starts[who], ends[who], slot)
        if other.any():
            ids, more = self._ids(data, starts[other], ends[other])
            pool = np.concatenate([pool[: self.used], ids])
            count[other], begin[other] = more, self.used + np.cumsum(more) - more
        before = np.concatenate([[0], np.cumsum(count)])
        return gather(pool, begin, count), before[np.searchsorted(starts, offsets)]

    def _keep(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, keys: np.ndarray) -> None:
        """Encode new pre-tokens and keep them under their keys, which come before the known ones at `at`."""
        ids, count = self._ids(data, starts, ends)
        if len(ids) and int(ids.max()) > 0xFFFF and self.pool.dtype == np.uint16:
            self.pool = self.pool.astype(np.uint32)
        self.pool = _extended(self.pool, self.used, ids)
        slots = len(self.at) + np.arange(len(starts))
        self.at = np.concatenate([self.at, self.used + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.used += len(ids)
        size = ends - starts
        self.text = _extended(self.text, self.text_used, gather(data, starts, size))
        self.text_at = np.concatenate([self.text_at, self.text_used + np.cumsum(size) - size])
        self.text_len = np.concatenate([self.text_len, size])
        self.text_used += int(size.sum())
        self.known, self.slot = np.insert(self.known, at, keys), np.insert(self.slot, at, slots)

    def _ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        return self.words.encode([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())])

    def _others(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Which pre-tokens have other bytes than those kept in their slot."""
        size = ends - starts
        out = size != self.text_len[slot]
        same = np.flatnonzero(~out)
        size = size[same]
        mine = data[starts[0] :] if len(same) and int(size.sum()) == len(data) - starts[0] else gather(data, starts[same], size)
        differ = np.flatnonzero(gather(self.text, self.text_at[slot[same]], size) != mine)
        out[same[np.searchsorted(np.cumsum(size), differ, "right")]] = True
        return out


def _extended(pool: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """The pool with more written behind its used part; doubled as often as that needs."""
    while used + len(more) > len(pool):
        pool = np.concatenate([pool, np.zeros_like(pool)])
    pool[used : used + len(more)] = more
    return pool


_encoders: dict[tuple[type, str], Encoder] = {}


def encoder(kind: type, path: str) -> Encoder:
    """The encoder of this worker for a vocabulary file; workers are reused, so it outlives a task."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = Encoder(kind(path))
    return _encoders[kind, path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, number of ids, the ids (binary, little-endian unsigned 32 bits) and the decoded text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(SegmentTreeWords, path)
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1)):
                ids, before = coder.chunk(data, offsets)
                text, lengths = coder.words.decode(ids)
                until = np.concatenate([[0], np.cumsum(lengths)])[before]
                raw, out = ids.astype("<u4").tobytes(), text.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(before)), pa.array([raw[4 * x : 4 * y] for x, y in zip(before, before[1:])], pa.binary()), pa.array([out[x:y] for x, y in zip(until, until[1:])], pa.binary())], ["id", "n_tokens", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, number of ids, SHA-256 of the ids and of the decoded text, taken where the ids are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(SegmentTreeWords, path)
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1)):
                ids, before = coder.chunk(data, offsets)
                text, lengths = coder.words.decode(ids)
                until = np.concatenate([[0], np.cumsum(lengths)])[before]
                raw, out, before_, until_ = memoryview(ids.astype("<u4").tobytes()), memoryview(text.tobytes()), (4 * before).tolist(), until.tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(before)), pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(before_, before_[1:])], pa.string()), pa.array([hashlib.sha256(out[x:y]).hexdigest() for x, y in zip(until_, until_[1:])], pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
