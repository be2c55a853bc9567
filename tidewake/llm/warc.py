"""WARC archives: a writer of compressed response and revisit records, and a reader that salvages damaged files.

Every record is a gzip member of its own. Tasks stream their records into new files of the shared folder and roll over
to the next file at FILE_BYTES; the manifest lists the files of tasks that succeeded.

The reader checks each member's checksum, the header's form, the block's length, the blank lines after it and the
payload's digest. After a failed check it looks for the next member or version line that reads well, goes on from
there, and reports the bytes in between as a gap with its reason. Plain and compressed files are read alike. A record that
fails inside a whole member of several records is a gap of its own; a member that fails its checksum is one gap.

Cases: a null html is an empty payload, a null url leaves the address out, a row without a page_id is a response of its
own; rows of one page_id and equal payload are all responses if theirs is the largest; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import Work, file_system

#: Payloads of at least so many bytes are stored once.
LEAST_SHARED = 1000
FILE_BYTES = 64 << 20
LEVEL = 4
#: Bytes that the reader fetches at a time.
BLOCK = 1 << 18
#: Bytes of a member's content that are kept; a longer content is inflated once to check it and again to read it.
HELD = 8 << 20
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
#: A date for records whose time of capture is not known; fixed so that equal rows give equal records.
DATE = "1970-01-01T00:00:00Z"


def base32_digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def header(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record: version line, fields, block and the two blank lines after it."""
    lines = "".join(f"{k}: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', v)}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def response(page_id: int | None, url: str | None, payload: bytes) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), *([("WARC-Target-URI", url)] if url else []), ("WARC-Payload-Digest", f"sha1:{base32_digest(payload)}"), ("WARC-Block-Digest", f"sha1:{base32_digest(http + payload)}"), ("Content-Type", "application/http; msgtype=response")]
    return header(fields, http + payload)


def revisit(page_id: int | None, url: str | None, digest: bytes, size: int, kept: int) -> bytes:
    """A record without the payload; its length is an extension field, as the standard has none for it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), *([("WARC-Target-URI", url)] if url else []), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(kept)), ("WARC-Payload-Digest", f"sha1:{base64.b32encode(digest).decode()}"), ("X-Payload-Length", str(size)), ("Content-Type", "application/http; msgtype=response")]
    return header(fields, http)


def write(pages: DataFrame, work: Work) -> DataFrame:
    """Write all pages; returns the manifest (file, records).

    Digests of large payloads are counted first; only those that occur more than once join the pages, so the join has
    one small side, and a payload that very many pages share can be split over tasks.
    """
    digest, size = F.sha1(F.coalesce("html", F.lit(""))), F.octet_length(F.coalesce("html", F.lit(""))).cast("bigint")
    page_id = F.col("page_id").cast("bigint")
    keyed = pages.select(page_id.alias("page_id"), digest.alias("digest"), size.alias("size"))
    shared = keyed.filter((F.col("size") >= LEAST_SHARED) & F.col("page_id").isNotNull()).groupBy("digest", "size").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1").select("digest", "size", "kept")
    shared = work.save(shared, "shared-payloads")
    rows = pages.select(page_id.alias("page_id"), "url", "html", digest.alias("digest"), size.alias("size")).join(shared, ["digest", "size"], "left").select("page_id", "url", "html", "digest", "size", "kept")
    folder = work.path("archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(folder)
        files.create_dir(root, recursive=True)
        out, name, count, size_now = None, "", 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, digest_, n, kept = (c[i].as_py() for c in batch.columns)
                raw = response(page, url, (html or "").encode()) if kept is None or page is None or page == kept else revisit(page, url, bytes.fromhex(digest_), n, kept)
                if out is None:
                    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, count = files.open_output_stream(f"{root}/{name}", compression=None), 0
                    info = member(header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    out.write(info)
                    size_now = len(info)
                packed = member(raw)
                out.write(packed)
                count, size_now = count + 1, size_now + len(packed)
                if size_now >= FILE_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"file": [name], "records": [count]})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [count]})

    return work.save(rows.mapInArrow(run, "file string, records bigint"), "manifest")


class Damaged(ValueError):
    """What a failed check says."""


@dataclass
class Record:
    """One record of an archive; offset and length are those of its bytes in the file."""

    offset: int
    length: int
    fields: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        if self.fields.get("content-type", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


@dataclass
class Gap:
    """Bytes that no record could be read from."""

    offset: int
    length: int
    reason: str


@dataclass
class Salvage:
    """Reads records from a source of bytes with size() and read_at(n, offset)."""

    source: object
    gaps: list[Gap] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.size, self.held, self.at = self.source.size(), b"", 0

    def bytes_at(self, offset: int, n: int) -> bytes:
        """Up to n bytes from offset, through one block that is kept."""
        if not (self.at <= offset and offset + n <= self.at + len(self.held)):
            self.at, self.held = offset, self.source.read_at(min(max(n, BLOCK), max(0, self.size - offset)), offset) if offset < self.size else b""
        return self.held[offset - self.at : offset - self.at + n]

    def records(self) -> Iterator[Record | Gap]:
        at, bad, reason = 0, None, ""
        while at < self.size:
            try:
                found, end = self.read(at)
            except Damaged as e:
                if bad is None:
                    bad, reason = at, str(e)
                at = self.search(at + 1)
                continue
            if bad is not None:
                yield self.gap(bad, at, reason)
                bad = None
            for r in found:
                if isinstance(r, Gap) and r not in self.gaps:
                    self.gaps.append(r)
                yield r
            at = end
        if bad is not None:
            yield self.gap(bad, self.size, reason)

    def gap(self, begin: int, end: int, reason: str) -> Gap:
        self.gaps.append(Gap(begin, end - begin, reason))
        return self.gaps[-1]

    def search(self, at: int) -> int:
        """The next place at which a member or a version line starts."""
        return search(self.bytes_at, at, self.size, MEMBER)

    def read(self, at: int) -> tuple[Iterator[Record | Gap], int]:
        start = self.bytes_at(at, 12)
        if start.startswith(MEMBER):
            content = Content(self.bytes_at, at, self.size)
            inside = self.inside(at, content)
            first = [r for r in [next(inside, None)] if r]
            if first and isinstance(first[0], Gap):
                first += [r for r in [next(inside, None)] if r]
            if not first or isinstance(first[-1], Gap):
                raise Damaged(first[0].reason if first else "empty member")
            return chain(first, inside), content.end
        if VERSION.match(start):
            fields, block, size = parse(self.bytes_at, at, self.size)
            return iter([Record(at, size, fields, block)]), at + size
        raise Damaged("neither a member nor a version line")

    def inside(self, at: int, content: Content) -> Iterator[Record | Gap]:
        """Records of a member that is whole; one that fails its checks is a gap up to the next good version line."""
        here, bad, reason, length = 0, None, "", content.end - at
        while here < content.size or bad is not None:
            try:
                found = parse(content.bytes_at, here, content.size) if here < content.size else None
            except Damaged as e:
                if bad is None:
                    bad, reason = here, str(e)
                here = search(content.bytes_at, here + 1, content.size)
                continue
            if bad is not None:
                yield Gap(at, length, f"bytes {bad} to {here} of the member's content: {reason}")
                bad = None
            if found:
                fields, block, size = found
                yield Record(at, length, fields, block)
                here += size


class Content:
    """What a gzip member holds, whose checksum is right: kept, or if it is long inflated again as it is read.

    So a worker holds at most HELD bytes beside the record that it reads, however much a member inflates to.
    """

    def __init__(self, bytes_at, at: int, limit: int):
        self.source, self.begin, self.limit, self.size, self.end, self.held, self.at, self.pieces = bytes_at, at, limit, 0, at, b"", 0, None
        kept: list[bytes] | None = []
        for piece, self.end in self.inflated():
            self.size += len(piece)
            if kept is not None:
                kept.append(piece)
                kept = kept if self.size <= HELD else None
        if kept is not None:
            self.held = b"".join(kept)

    def inflated(self) -> Iterator[tuple[bytes, int]]:
        """Pieces of the content with the place in the file after each."""
        z, here = zlib.decompressobj(31), self.begin
        while not z.eof:
            block = z.unconsumed_tail or (self.source(here, min(1 << 16, self.limit - here)) if here < self.limit else b"")
            if not block:
                raise Damaged("member is cut short")
            here += 0 if z.unconsumed_tail else len(block)
            try:
                piece = z.decompress(block, BLOCK)
            except zlib.error as e:
                raise Damaged(f"member: {e}") from None
            yield piece, here - len(z.unused_data)

    def bytes_at(self, offset: int, n: int) -> bytes:
        """Up to n bytes from offset; a long content is inflated up to there, from its start if that lies behind."""
        n = max(0, min(n, self.size - offset))
        if offset + n > self.at + len(self.held) or offset < self.at:
            if self.pieces is None or offset < self.at:
                self.pieces, self.at, self.held = self.inflated(), 0, b""
            parts, have = [self.held], self.at + len(self.held)
            while have < offset + n:
                piece = next(self.pieces)[0]
                have += len(piece)
                parts.append(piece)
                if have <= offset - BLOCK:
                    self.at, parts = have, []
            self.held = b"".join(parts)
            if offset - self.at > BLOCK:  # what lies further behind is not asked for again, but for a failed record
                cut = offset - self.at - BLOCK
                self.at, self.held = self.at + cut, self.held[cut:]
        return self.held[offset - self.at : offset - self.at + n]


def search(bytes_at, at: int, size: int, member: bytes | None = None) -> int:
    """The next place from `at` with a version line, or the start of a member if that is given; else size."""
    while at < size:
        block = bytes_at(at, min(BLOCK, size - at))
        places = [m.start() for m in [VERSION.search(block)] if m] + ([block.find(member)] if member else [])
        places = [p for p in places if p >= 0]
        if places:
            return at + min(places)
        if at + len(block) >= size:
            return size
        at += len(block) - 12
    return size


def parse(bytes_at, at: int, size: int) -> tuple[dict[str, str], bytes, int]:
    """Fields, block and whole length of the plain record at a place, or Damaged."""
    head, n = bytes_at(at, min(4096, size - at)), 4096
    while (cut := head.find(b"\r\n\r\n")) < 0:
        if len(head) < n or n > 1 << 20:
            raise Damaged("header has no end")
        n *= 4
        head = bytes_at(at, min(n, size - at))
    if not (m := VERSION.match(head)):
        raise Damaged("no version line")
    fields: dict[str, str] = {}
    for line in head[m.end() : cut].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!-9;-~]+", name):
            raise Damaged("broken header field")
        fields[name.lower()] = value.strip()
    if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")) or "warc-type" not in fields or "warc-record-id" not in fields:
        raise Damaged("a needed field is missing")
    begin, length = cut + 4, int(fields["content-length"])
    if at + begin + length + 4 > size:
        raise Damaged("block is cut short")
    block = bytes_at(at + begin, length)
    if bytes_at(at + begin + length, 4) != b"\r\n\r\n":
        raise Damaged("no blank lines after the block")
    check(fields, block)
    return fields, block, begin + length + 4


def check(fields: dict[str, str], block: bytes) -> None:
    """Digests in SHA-1 must fit; a revisit's payload is elsewhere."""
    wanted = fields.get("warc-block-digest", "")
    if wanted.startswith("sha1:") and wanted[5:] not in (base32_digest(block), hashlib.sha1(block).hexdigest()):
        raise Damaged("block digest differs")
    wanted = fields.get("warc-payload-digest", "")
    if wanted.startswith("sha1:") and fields["warc-type"] == "response" and "warc-block-digest" not in fields:
        payload = block.partition(b"\r\n\r\n")[2]
        if wanted[5:] not in (base32_digest(payload), hashlib.sha1(payload).hexdigest()):
            raise Damaged("payload digest differs")


SCHEMA = "file string, offset bigint, length bigint, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, reason string, payload binary"


def read(manifest: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """A row per record and per gap (record_type `gap`, with its reason) of the listed files of a folder.

    payload_bytes and payload_digest (hex SHA-1) are taken from the bytes of responses and from the fields of revisits.
    The list has a row per file, and each file is read by one task.
    """
    names = [r["file"] for r in manifest.select("file").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(folder)
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                for r in Salvage(files.open_input_file(f"{root}/{name}")).records():
                    if isinstance(r, Gap):
                        rows.append((name, r.offset, r.length, "gap", None, None, None, None, None, r.reason, None))
                    else:
                        f, raw = r.fields, r.payload
                        kind, digest = f["warc-type"], f.get("warc-payload-digest", "").removeprefix("sha1:")
                        if kind == "revisit":
                            n, digest = int(f.get("x-payload-length", -1)), base64.b32decode(digest).hex() if len(digest) == 32 else digest
                        else:
                            n, digest = len(raw), hashlib.sha1(raw).hexdigest()
                        rows.append((name, r.offset, r.length, kind, f["warc-record-id"], f.get("warc-target-uri"), f.get("warc-refers-to"), digest, n, None, raw if payload else None))
                        held += len(raw) if payload else 200
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], columns)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], columns)

    spark = manifest.sparkSession
    plan = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, len(names)))
    return plan.mapInArrow(run, SCHEMA)


def archive(pages: DataFrame) -> DataFrame:
    """Write the pages and read the records back, without payloads."""
    work = Work(pages.sparkSession, "warc")
    return read(write(pages, work), work.path("archives"), payload=False)
