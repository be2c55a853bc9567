"""Media columns: Netpbm and BMP pictures as numpy arrays, area resizing by integral images, NPY tiles and hashes.

`decode` reads PBM, PGM, PPM (plain and raw, also 16-bit) and uncompressed BMP (8, 24 and 32 bits). `area_resize` takes
the mean over each target cell, with parts of pixels, from one integral image. `difference_hash` compares neighbouring
cells of a 9 x 8 thumbnail. `encode_payloads` and `features` are the two ends of a media column: bytes become one grey
picture a row, stored in a table of the shared folder, and the stored picture is decoded, resized and hashed.

Cases: a null or empty text is one tile of padding; broken or unknown pictures raise ValueError in `decode` and give a
row with null features in `features`; equal payloads give equal rows; other columns pass untouched.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidewake.llm.common import Work, chunks, text_bytes

#: A picture is SIDE columns wide; a payload is padded to whole tiles of SIDE x SIDE samples.
SIDE = 24
TILE = SIDE * SIDE
PAD = 255
#: Last bytes of a payload that have a checksum of their own.
TAIL = 32
#: Sides of the thumbnail that is kept as an NPY tile.
THUMB = 8
#: Samples whose sums are made at a time.
STRIP = 1 << 19


def encode_pgm(samples: np.ndarray) -> bytes:
    """Raw PGM of a two-dimensional array of bytes."""
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey BMP, bottom row first, rows padded to four bytes."""
    h, w = samples.shape
    rows = np.zeros((h, -(-w // 4) * 4), np.uint8)
    rows[:, :w] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4)
    palette[:, 3] = 0
    at = 14 + 40 + 1024
    return struct.pack("<2sIHHI", b"BM", at + rows.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + palette.tobytes() + rows.tobytes()


def decode(raw: bytes) -> np.ndarray:
    """Height x width (grey) or height x width x 3 array of a Netpbm or BMP picture."""
    if raw[:2] == b"BM":
        return _decode_bmp(raw)
    if raw[:1] == b"P" and raw[1:2] in b"123456" and len(raw) > 2:
        return _decode_netpbm(raw)
    raise ValueError("neither Netpbm nor BMP")


def _decode_netpbm(raw: bytes) -> np.ndarray:
    kind, at, head = raw[1] - 48, 2, []
    while len(head) < (2 if kind in (1, 4) else 3):
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(raw, at)
        if not m:
            raise ValueError("broken header")
        head.append(int(m[1]))
        at = m.end()
    w, h, most = head[0], head[1], head[2] if len(head) > 2 else 1
    shape = (h, w, 3) if kind in (3, 6) else (h, w)
    n = w * h * (3 if kind in (3, 6) else 1)
    if not 0 < most < 65536 or n == 0:
        raise ValueError("empty picture or wrong range")
    if n > len(raw) * (8 if kind == 4 else 1):
        raise ValueError("picture is cut short")
    if kind == 1:  # digits may touch
        bits = np.frombuffer(re.sub(rb"\s|#[^\n]*", b"", raw[at:]), np.uint8)[:n] - np.uint8(48)
        if (bits > 1).any():
            raise ValueError("a bit is neither 0 nor 1")
        flat = 1 - bits
    elif kind in (2, 3):
        found = re.sub(rb"#[^\n]*", b"", raw[at:]).split()[:n]
        if not all(x.isdigit() and len(x) < 9 for x in found):
            raise ValueError("a sample is no number in range")
        flat = np.array(found, np.int64)
    elif kind == 4:
        rows = np.frombuffer(raw, np.uint8, offset=at + 1)
        wide = -(-w // 8)
        if rows.size < wide * h:
            raise ValueError("picture is cut short")
        flat = 1 - np.unpackbits(rows[: wide * h].reshape(h, wide), axis=1)[:, :w].ravel()
    else:
        size = 1 if most < 256 else 2
        if len(raw) - at - 1 < n * size:
            raise ValueError("picture is cut short")
        flat = np.frombuffer(raw, np.uint8 if size == 1 else ">u2", n, at + 1)
    if flat.size < n:
        raise ValueError("picture is cut short")
    if int(flat.max()) > most:
        raise ValueError("a sample is out of range")
    return np.asarray(flat).astype(np.uint8 if most < 256 else np.uint16, copy=False).reshape(shape)


def _decode_bmp(raw: bytes) -> np.ndarray:
    if len(raw) < 54:
        raise ValueError("broken header")
    at = struct.unpack_from("<I", raw, 10)[0]
    size, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", raw, 14)
    if packed != 0 or bits not in (8, 24, 32) or w <= 0 or h == 0:
        raise ValueError("only plain 8, 24 and 32 bits")
    wide = -(-w * bits // 32) * 4
    if len(raw) < at + wide * abs(h):
        raise ValueError("picture is cut short")
    rows = np.frombuffer(raw, np.uint8, wide * abs(h), at).reshape(abs(h), wide)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        n = struct.unpack_from("<I", raw, 46)[0] or 256
        if int(rows.max()) >= n:
            raise ValueError("a pixel has no colour in the palette")
        palette = np.frombuffer(raw, np.uint8, 4 * n, 14 + size).reshape(n, 4)[:, 2::-1]
        grey = (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all()
        return palette[rows][..., 0] if grey else palette[rows]
    return rows.reshape(abs(h), w, bits // 8)[..., 2::-1]


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each of height x width equal cells; a pixel on an edge counts by its share."""
    h, w = samples.shape[:2]
    y, x = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    a, b = np.minimum(y.astype(int), h - 1), np.minimum(x.astype(int), w - 1)
    sums = _integral_rows(samples, np.concatenate([a, a + 1]))
    fy, fx = (y - a).reshape(-1, *[1] * (samples.ndim - 1)), (x - b).reshape(1, -1, *[1] * (samples.ndim - 2))
    rows = sums[: len(a)] * (1 - fy) + sums[len(a) :] * fy
    at = rows[:, b] * (1 - fx) + rows[:, b + 1] * fx
    return np.diff(np.diff(at, axis=0), axis=1) / (h / height * (w / width))


def _integral_rows(samples: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rows of the integral image: the sums over all samples above and to the left. It is made in strips of STRIP samples."""
    h, w = samples.shape[:2]
    out = np.zeros((len(wanted), w + 1, *samples.shape[2:]))
    above, strip = np.zeros(out.shape[1:]), max(1, STRIP // max(1, samples[0].size))
    for top in range(0, h, strip):
        sums = np.cumsum(np.cumsum(samples[top : top + strip], axis=0, dtype=np.float64), axis=1)
        here = np.flatnonzero((wanted > top) & (wanted <= top + len(sums)))
        out[here] = above
        out[here, 1:] += sums[wanted[here] - top - 1]
        above[1:] += sums[-1]
    return out


def difference_hash(samples: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 cells is darker than the next to its right."""
    small = area_resize(samples, 8, 9)
    small = small if small.ndim == 2 else small.mean(axis=2)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-9).tobytes().hex()


def npy(samples: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, samples, allow_pickle=False)
    return out.getvalue()


def encode_payloads(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes, padded to whole tiles, as a raw PGM of SIDE columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets):
                media = []
                for x, y in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist()):
                    samples = np.full(max(TILE, -(-(y - x) // TILE) * TILE), PAD, np.uint8)
                    samples[: y - x] = data[x:y]
                    media.append(encode_pgm(samples.reshape(-1, SIDE)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


FEATURES = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, tile binary"


def features(stored: DataFrame) -> DataFrame:
    """Of each stored picture: digests of its samples and of itself, difference hash, and an 8 x 8 thumbnail as NPY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FEATURES.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            size = batch.column(2).fill_null(b"")
            for a, b in chunks(np.concatenate([[0], np.cumsum(pc.binary_length(size).to_numpy(zero_copy_only=False).astype(np.int64))])):
                part, rows = batch.slice(a, b - a), []
                for raw in part.column(2):
                    raw = raw.as_py()
                    try:
                        samples = decode(raw) if raw is not None else None
                    except ValueError:
                        samples = None
                    if samples is None:
                        rows.append((None,) * len(names))
                        continue
                    payload = samples.tobytes()
                    thumb = np.rint(area_resize(samples, THUMB, THUMB)).astype(np.uint8)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(raw), hashlib.sha256(raw).hexdigest(), difference_hash(samples), npy(thumb)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], ["doc_id", "n_bytes", *names])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, {FEATURES}")


def media_table(docs: DataFrame) -> DataFrame:
    """Store the pictures of all texts, then read them back with their features."""
    return features(Work(docs.sparkSession, "media").save(encode_payloads(docs), "pictures"))
