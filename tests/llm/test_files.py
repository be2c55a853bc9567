"""Archives with damage, media round trips, and their odd cases."""

from __future__ import annotations

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm import media, q_files, warc
from tidewake.llm.common import Work, file_system, table

SF = "/root/testdata/sf0.001"


class Bytes:
    def __init__(self, raw):
        self.raw = raw

    def size(self):
        return len(self.raw)

    def read_at(self, n, offset):
        return self.raw[offset : offset + n]


def salvaged(raw):
    return list(warc.Salvage(Bytes(raw)).records())


def members(n=5, packed=True):
    rng = random.Random(2)
    out = [warc.response(k, f"http://x/{k}", bytes(rng.randrange(256) for _ in range(400 * k))) for k in range(n)]
    return [warc.member(r) if packed else r for r in out]


@pytest.mark.parametrize("packed", [True, False])
def test_whole_archives_read_back(packed):
    found = salvaged(b"".join(members(packed=packed)))
    assert [r.fields["warc-record-id"] for r in found] == [f"<urn:page:{k}>" for k in range(5)]
    assert [len(r.payload) for r in found] == [400 * k for k in range(5)]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("damage", ["flip", "cut", "junk", "drop", "length"])
def test_later_records_survive_damage(packed, damage):
    parts = members(packed=packed)
    bad = parts[2]
    if damage == "flip":
        at = len(bad) - 60
        parts[2] = bad[:at] + bytes([bad[at] ^ 255]) + bad[at + 1 :]
    elif damage == "cut":
        parts[2] = bad[: len(bad) // 2]
    elif damage == "junk":
        parts[2] = b"\x1f\x8b\x08junk WARC/1.1\r\nnot a record" * 3
    elif damage == "drop":
        parts[2] = bad[20:]
    else:
        parts[2] = bad.replace(b"Content-Length: 8", b"Content-Length: 9") if not packed else bad[:-4] + b"\0\0\0\0"
    found = salvaged(b"".join(parts))
    ids = [r.fields["warc-record-id"] for r in found if isinstance(r, warc.Record)]
    gaps = [r for r in found if isinstance(r, warc.Gap)]
    assert ids == [f"<urn:page:{k}>" for k in (0, 1, 3, 4)]
    assert len(gaps) == 1 and gaps[0].offset == sum(map(len, parts[:2])) and gaps[0].length == len(parts[2]) and gaps[0].reason


@pytest.mark.parametrize("held", [8 << 20, 500])
def test_records_inside_a_whole_member_are_salvaged(monkeypatch, held):
    """Of five records in one member only the damaged third is lost; a long content is read in pieces."""
    monkeypatch.setattr(warc, "HELD", held)
    monkeypatch.setattr(warc, "BLOCK", max(64, held // 5))
    parts = members(packed=False)
    bad = bytearray(parts[2])
    bad[-30] ^= 255
    whole = b"".join([*parts[:2], bytes(bad), *parts[3:]])
    lone = warc.member(warc.response(9, "http://x/9", b"after"))
    found = salvaged(warc.member(whole) + lone)
    assert [r.fields["warc-record-id"] if isinstance(r, warc.Record) else "gap" for r in found] == [*(f"<urn:page:{k}>" for k in (0, 1)), "gap", *(f"<urn:page:{k}>" for k in (3, 4, 9))]
    assert f"bytes {len(b''.join(parts[:2]))} to {len(b''.join(parts[:3]))} " in found[2].reason and found[2].offset == 0
    salvage = warc.Salvage(Bytes(warc.member(bytes(bad) + parts[3]) + warc.member(b"no record") + lone))
    assert [type(r).__name__ for r in salvage.records()] == ["Gap", "Record", "Gap", "Record"] and len(salvage.gaps) == 2
    assert [r.payload for r in salvaged(warc.member(b"".join(parts)))] == [r.payload for r in salvaged(b"".join(parts))]


def test_damage_at_the_ends_and_nothing_at_all():
    assert salvaged(b"") == []
    (gap,) = salvaged(b"no archive at all" * 9)
    assert (gap.offset, gap.length) == (0, 153)
    parts = members()
    found = salvaged(b"xx" + b"".join(parts) + parts[0][:30])
    assert [type(r).__name__ for r in found] == ["Gap", *["Record"] * 5, "Gap"]


def test_query_equals_sql(spark, duck):
    got = sorted(map(repr, (tuple(r) for r in q_files.op1_warc(spark, SF).collect())))
    assert got == sorted(map(repr, duck.execute(q_files.ORACLE_SQL["op1_warc"]).fetchall()))


def test_revisits_and_odd_pages(spark, tmp_path):
    big, small = "é" * 600, "same"
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", big), (4, "u", small), (5, "u", small), (6, "u", None), (None, "u", big), (7, "u", ""), (7, "u", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS size", "'d' AS digest")
    work = Work(spark, "t")
    manifest = warc.write(pages, work)
    got = warc.read(manifest, work.path("archives")).filter("record_type in ('response', 'revisit')").collect()
    of = {(r.record_id, r.record_type): r for r in got}
    assert len(got) == 9
    for k in (1, 2):
        r = of[f"<urn:page:{k}>", "revisit"]
        assert r.refers_to == "<urn:page:3>" and r.payload_bytes == 1200 and r.payload_digest == hashlib.sha1(big.encode()).hexdigest()
    assert bytes(of["<urn:page:3>", "response"].payload).decode() == big and bytes(of["<urn:page:none>", "response"].payload).decode() == big
    assert of["<urn:page:6>", "response"].payload_bytes == 0 and of["<urn:page:5>", "response"].payload_digest == hashlib.sha1(b"same").hexdigest()
    files, root = file_system(work.path("archives"))
    for f in files.get_file_info(__import__("pyarrow").fs.FileSelector(root)):  # a broken file gives a gap and its other records
        raw = files.open_input_file(f.path).read()
        with files.open_output_stream(f.path) as out:
            out.write(raw[: len(raw) // 2] + b"\0" * 40 + raw[len(raw) // 2 + 40 :])
    again = warc.read(manifest, work.path("archives")).collect()
    assert sum(r.record_type == "gap" for r in again) >= 1 and len(again) >= 3
    assert warc.archive(pages.filter("false")).count() == 0


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (24, 24), (3, 8)])
def test_pictures_round_trip(shape):
    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, shape).astype(np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(media.encode_bmp(grey)) == grey).all()
    plain = b"P2 # a note\n%d %d\n255\n" % (shape[1], shape[0]) + b" ".join(b"%d" % v for v in grey.ravel())
    assert (media.decode(plain) == grey).all()
    bits = grey & 1
    assert (media.decode(b"P4\n%d %d\n" % (shape[1], shape[0]) + np.packbits(1 - bits, axis=1).tobytes()) == bits).all()
    assert (media.decode(b"P1\n%d %d\n" % (shape[1], shape[0]) + b"".join(b"%d" % v for v in (1 - bits).ravel())) == bits).all()
    colour = rng.integers(0, 256, (*shape, 3)).astype(np.uint8)
    assert (media.decode(b"P6 %d %d 255\n" % (shape[1], shape[0]) + colour.tobytes()) == colour).all()
    deep = rng.integers(0, 65536, shape).astype(">u2")
    assert (media.decode(b"P5 %d %d 65535\n" % (shape[1], shape[0]) + deep.tobytes()) == deep).all()


def few_colours():
    """A BMP whose palette has fewer colours than its pixels ask for."""
    raw = bytearray(media.encode_bmp(np.full((4, 4), 200, np.uint8)))
    raw[46:50] = (7).to_bytes(4, "little")
    return bytes(raw)


@pytest.mark.parametrize("raw", [b"", b"GIF89a", b"P5\n3 3\n255\nab", b"P5\nx", b"P5 0 5 255\n", b"BM123", media.encode_bmp(np.zeros((4, 4), np.uint8))[:-3], b"P3 2 2 255 1 2 3", b"P2 2 1 255 -5 300", b"P2 1 1 255 300", b"P2 1 1 255 99999999999999999999999999", b"P2 99999999999999999999 9999999999999999999 255 1", b"P5 1 1 100\n\xff", b"P1 2 1 1 7", b"P2 1 1 255 x", few_colours()])
def test_broken_pictures(raw):
    with pytest.raises(ValueError):
        media.decode(raw)


@pytest.mark.parametrize("strip", [1, 100, 1 << 19])
def test_area_resize_is_the_mean_of_cells(monkeypatch, strip):
    monkeypatch.setattr(media, "STRIP", strip)
    rng = np.random.default_rng(2)
    colour = rng.integers(0, 256, (48, 30, 3))
    assert np.allclose(media.area_resize(colour, 8, 6), colour.reshape(8, 6, 6, 5, 3).mean(axis=(1, 3)))
    x = rng.integers(0, 256, (48, 30)).astype(np.uint8)
    assert np.allclose(media.area_resize(x, 8, 6), x.reshape(8, 6, 6, 5).mean(axis=(1, 3)))
    wide = np.kron(x, np.ones((7, 11)))  # a cell of any size: cells of the enlarged picture are whole pixels
    assert np.allclose(media.area_resize(x, 7, 11), wide.reshape(7, 48, 11, 30).mean(axis=(1, 3)))
    assert media.difference_hash(np.tile(np.arange(24, dtype=np.uint8), (24, 1))) == "ff" * 8
    assert media.difference_hash(np.zeros((24, 24), np.uint8)) == "00" * 8


def test_media_of_documents(spark, odd):
    for docs in (table(spark, SF, "documents"), odd):
        text = sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
        rows = sorted(media.media_table(docs).collect(), key=lambda r: (r.doc_id or -1, r.n_bytes))
        same = {}
        for (d, t), r in zip(text, rows):
            raw = t.encode()
            payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
            assert (r.doc_id or -1, r.n_bytes, r.payload_bytes) == (d, len(raw), len(payload))
            assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
            assert same.setdefault(t, (r.media_sha256, r.feature, r.media_bytes)) == (r.media_sha256, r.feature, r.media_bytes)
            assert np.load(io.BytesIO(r.tile)).shape == (8, 8)
    broken = spark.createDataFrame([(1, 5, bytearray(b"nonsense")), (2, 5, None)], "doc_id bigint, n_bytes bigint, media binary")
    assert [r.feature for r in media.features(broken).collect()] == [None, None]
    assert media.media_table(odd.filter(F.lit(False))).count() == 0
