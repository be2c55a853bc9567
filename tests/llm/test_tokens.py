"""BPE, shards and packing against the tokenizers library, and their odd cases."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewake.llm import bpe, eliasfano, packing
from tidewake.llm.common import table, text_chunks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def encoded(coder, texts):
    out = []
    for _, _, data, offsets in text_chunks(pa.array(texts, pa.string())):
        ids, before = coder.chunk(data, offsets)
        out += [ids[a:b].tolist() for a, b in zip(before, before[1:])]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abstmdrelv'’ \n\t.!?<|>0१éß漢😀\x1c\x85 "), st.characters(codec="utf-8")), max_size=60), max_size=8))
def test_both_encoders_equal_the_library(vocabulary, library, texts):
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for kind in (bpe.SegmentTreeWords, bpe.LibraryWords):
        assert encoded(bpe.encoder(kind, vocabulary), texts) == wanted


def test_code_points_are_classed_as_the_library_does():
    """Every thirteenth code point of the whole range, and all up to U+3000."""
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 13 == 0)])
    assert (bpe.asked_classes(points) == bpe.classes()[points]).all()


def test_special_tokens_long_words_and_a_full_store(vocabulary, library, monkeypatch):
    texts = ["<|endoftext|>a <|endoftext|><|endoftext|>", "ab" * 4000, "x" * 300 + " hi", "", "  x", "'s's 'll"]
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    for kind in (bpe.SegmentTreeWords, bpe.LibraryWords):
        coder = bpe.Encoder(kind(vocabulary))
        for _ in range(3):
            assert [encoded(coder, [t])[0] for t in texts] == wanted


def test_long_words_are_not_kept(vocabulary, library):
    texts = ["漢" * 40_000 + str(k) for k in range(3)] + ["short words " * 9, "é" * 500 + "x", "é" * 512 + "x"]
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for kind in (bpe.LibraryWords, bpe.SegmentTreeWords):
        coder = bpe.Encoder(kind(vocabulary))
        for _ in range(2):
            assert encoded(coder, texts) == wanted and coder.text_used < 4 * bpe.LONG_WORD


def test_the_store_of_words_is_bounded_by_bytes(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_BYTES", 5000)
    coder = bpe.Encoder(bpe.LibraryWords(vocabulary))
    for k in range(30):
        text = " ".join(f"{chr(97 + k % 26)}{'word' * 100}{chr(97 + j)}" for j in range(10))
        assert encoded(coder, [text])[0] == library.encode(text, add_special_tokens=False).ids
        assert coder.text_used <= 5000


def thue_morse(a, b, n):
    """Words that collide in every polynomial hash modulo 2**64 from 1,024 letters on."""
    one, two = a, b
    while len(one) < n:
        one, two = one + two, two + one
    return one, two


@pytest.mark.parametrize("letters", [1024, 4096])
def test_words_that_collide_modulo_a_power_of_two(vocabulary, library, letters):
    texts = list(thue_morse("a", "b", letters))
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for kind in (bpe.SegmentTreeWords, bpe.LibraryWords):
        assert encoded(bpe.Encoder(kind(vocabulary)), texts) == wanted


def test_equal_fingerprints_do_not_mix_words(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "span_hashes", lambda data, starts, ends: np.minimum(ends - starts, 3).astype(np.uint64))
    texts = ["one two three", "four five sixteen one", "a b c dd eee", "one two three"]
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for kind in (bpe.SegmentTreeWords, bpe.LibraryWords):
        coder = bpe.Encoder(kind(vocabulary))
        for _ in range(2):
            assert encoded(coder, texts) == wanted and encoded(coder, texts[::-1]) == wanted[::-1]


def digests_of(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_digests(spark, odd, vocabulary, library):
    for docs in (table(spark, SF, "documents"), odd):
        wanted = sorted((r.doc_id or -1, *digests_of(library, r.text)) for r in docs.select("doc_id", "text").collect())
        got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, vocabulary).collect())
        assert got == wanted
    r = bpe.encode_decode(odd.filter("doc_id = 4"), vocabulary).first()
    assert bytes(r.decoded).decode() == "naïve café – 漢字 😀" and len(r.ids) == 4 * r.n_tokens


def test_shards_hold_all_documents_in_order(spark, odd, vocabulary, library):
    for docs in (table(spark, SF, "documents"), odd):
        rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
        wanted, start = [], 0
        for r in rows:
            ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            wanted.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert sorted(map(tuple, eliasfano.boundaries(docs, vocabulary).collect()), key=lambda r: r[1]) == wanted


def test_shards_of_an_empty_table(spark, odd, vocabulary):
    assert eliasfano.boundaries(odd.filter("false"), vocabulary).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=900), st.integers(-1000, 1000), st.data())
def test_elias_fano_round_trip(steps, base, data):
    values = np.cumsum(np.array([0, *steps])) + base
    coded = eliasfano.EliasFano.from_bytes(eliasfano.EliasFano.of(values).to_bytes())
    a = data.draw(st.integers(0, len(values)))
    b = data.draw(st.integers(a, len(values)))
    assert coded.select(a, b).tolist() == values[a:b].tolist()
    if len(values) > 400:
        bits = 8 * (len(coded.low) + len(coded.high) + 4 * len(coded.samples)) / len(values)
        assert bits < 4 + np.log2(max(2, (values[-1] - values[0]) / len(values)))


def check_packing(rows, counts):
    """Every id in one piece, sequences gapless from 0, full or at a power of two."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padded = 0
    for doc, n in counts.items():
        at = 0
        for start, length in sorted(by_doc.pop(doc)):
            assert start == at and length > 0
            at += length
        assert at == n
    assert not by_doc
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
        padded += 0 if at & (at - 1) == 0 else 1024 - at
    return padded


def test_packer_on_many_mixtures(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_IDS", 5000)
    rng = np.random.default_rng(0)
    for _ in range(150):
        p = packing.Packer(3)
        sizes = [int(x) for x in rng.choice([1, 5, 60, 127, 128, 129, 300, 512, 513, 700, 1023, 1024, 1025, 3000], rng.integers(0, 80))]
        for d, n in enumerate(sizes):
            p.add(d, np.arange(n).astype("u2"))
        p.end()
        rows = [dict(zip(packing.NAMES, r)) for r in zip(*p.rows)]
        assert check_packing(rows, dict(enumerate(sizes))) == 0
        groups = {}
        for r in rows:
            groups.setdefault(r["step_group"], set()).add((r["sequence_id"], r["tier"]))
        assert all(len({t for _, t in g}) == 1 and sum(t for _, t in g) <= packing.STEP_IDS for g in groups.values())


def test_packed_documents(spark, odd, vocabulary, library):
    for docs in (table(spark, SF, "documents"), odd.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        ids = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in docs.collect()}
        rows = [r.asDict() for r in packing.pack(docs, vocabulary).collect()]
        assert check_packing(rows, {d: len(x) for d, x in ids.items()}) == 0
        for r in rows:
            assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert packing.pack(odd.filter("false"), vocabulary).count() == 0
    twice = packing.pack(odd.filter("doc_id = 7"), vocabulary).collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens
