"""Helpers that the operators of this subpackage share: the shared work folder, tables in it, and views on Arrow text."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; it bounds a Python worker's memory. A longer text is a step of its own.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where that is unset a temporary folder takes its place, in local mode (tests) only: executors elsewhere cannot see it.
    """
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not (root := spark.sparkContext.getCheckpointDir()):
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidewake-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


#: Settings while a table is written: its shuffle files go when it is done, and Python workers get small batches.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


class Work:
    """A folder of one run below the shared root, for tables that cut lineage and for files that tasks write."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.live: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of df, written once and read back: later plans start from files that any executor can read."""
        before = {key: self.spark.conf.get(key, None) for key in WRITING}
        for key, value in WRITING.items():
            self.spark.conf.set(key, value)
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        finally:
            for key, value in before.items():
                self.spark.conf.set(key, value) if value is not None else self.spark.conf.unset(key)
        self.live.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            self.live.discard(name)

    def keep(self, *names: str) -> None:
        """Delete all tables of this folder but these."""
        self.drop(*sorted(self.live.difference(names)))


#: Rows of ids up to which a join may send them to all executors.
FEW_IDS = 250_000


def few(ids: DataFrame, most: int = FEW_IDS) -> DataFrame:
    """Ids that a join with whole texts sends to the texts if they are at most so many; else Spark shuffles both sides."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def unused(name: str, columns: list[str]) -> str:
    """The name, or with underscores before it if the columns have it already."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder, as a task opens them."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:/") and not uri.startswith("file://"):
            uri = "file://" + uri[5:]
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and its n + 1 offsets; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES, step: int = 1):
    """Row ranges (a, b), of whole steps of rows, whose texts hold at most limit bytes, or one step that is longer."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + step, (int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1) // step * step)
        yield a, min(b, n)
        a = min(b, n)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES, step: int = 1):
    """(a, b, bytes, offsets) for the row ranges of chunks(); offsets start at 0."""
    data, offsets = text_bytes(column)
    for a, b in chunks(offsets, limit, step):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


#: Bases of the polynomial hashes and odd factors of the final mixing; fixed values.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
#: The polynomials are taken modulo the prime 2**61 - 1: modulo a power of two, texts exist that collide for every base.
PRIME = (1 << 61) - 1
#: Values that a running sum adds up before it is reduced.
SUMMED = 1 << 22
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    out = x & np.uint64(PRIME)
    out += x >> np.uint64(61)
    np.subtract(out, np.uint64(PRIME), out=out, where=out >= np.uint64(PRIME))
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME of values below it, from products of their halves."""
    half, low, quarter = np.uint64(31), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    middle = al * bh
    middle += ah * bl
    out = ah * bh
    out += out
    out += middle >> np.uint64(30)
    middle &= quarter
    middle <<= half
    out += middle
    out += al * bl
    return fold(out)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n of a base modulo PRIME, and their inverses."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = -(-(n + 1) // (1 << 18)) << 18
        made = []
        for b in (base % PRIME, pow(base, -1, PRIME)):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                more = times(out[: size - len(out)], np.uint64(pow(b, len(out), PRIME)))
                out = np.concatenate([out, more])
            made.append(out)
        have = _powers[base] = made[0], made[1]
    return have


def running(x: np.ndarray) -> np.ndarray:
    """Sums of the values before each place, whose differences are right modulo PRIME after adding it."""
    out = np.zeros(len(x) + 1, np.uint64)
    if len(x) <= SUMMED:
        np.cumsum(x, out=out[1:])
        return out
    for a in range(0, len(x), SUMMED):
        here = slice(a + 1, a + 1 + len(x[a : a + SUMMED]))
        out[here] = fold(np.cumsum(x[a : a + SUMMED]) + out[a])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(MIX[0])
    x ^= x >> np.uint64(33)
    x = x * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(33))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """64-bit fingerprints of values[start:end] for many spans at once, by running sums of a polynomial modulo PRIME."""
    up, down = powers(base, len(values))
    up, half, low = up[: len(values)], np.uint64(31), np.uint64((1 << 31) - 1)
    if values.dtype == np.uint8:
        v = values.astype(np.uint64) + np.uint64(1)
        parts = v * (up & low), v * (up >> half)  # below 2**40
    else:
        term = times(fold(values.astype(np.uint64)), up)
        parts = term & low, term >> half
    more = np.uint64(PRIME if len(values) > SUMMED else 0)
    lows, highs = (fold(s[ends] + more - s[starts]) for s in map(running, parts))
    h = times(fold(lows + times(highs, np.uint64(1 << 31))), down[starts])
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(MIX[1]))


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[start : start + length] of all spans, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
