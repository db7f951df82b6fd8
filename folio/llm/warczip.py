"""Web archives in ZIP packages: records are written as stored members with an index, and read by ranges, not extracted.

A package is a ZIP file with two stored members: archive/data.warc.gz, whose records are gzip members of their own, and
indexes/index.cdx, a line of JSON for each record with its place. Readers look at a package's end for the directory
(ZIP64 where the plain fields are full), take from it where members begin, and then read the bytes of records only.
Packages of other writers are read too: plain or gzipped archives, with or without such an index, as long as they are
stored.

Equal payloads are kept once: the record with the largest id holds it, the others are revisits that name it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import lookup, new_path, stored, table

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Bytes of payload after which a task begins another package; bytes of records that one range reads, about.
PACKAGE_BYTES, RANGE_BYTES = 1 << 28, 1 << 22
#: Packages whose directories a task reads, ranges that a task reads, about.
PACKAGES_A_TASK, RANGES_A_TASK = 32, 4
#: Rows with payloads, or their bytes, that are handed on at a time.
ROWS, STEP = 256, 1 << 21
#: Fixed values of the ZIP format: signatures and the field that says "see ZIP64".
_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF
#: Fixed value of the archive format: a record that repeats another one's payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


# ---- records


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(value: str) -> str:
    """A value that stays on its line: line ends and other control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple | None, date: str) -> bytes:
    """A response, or a revisit of the record with the id `refers_to[0]`, whose block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if refers_to:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to[0])}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """The named lines of a header, names in lower case."""
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:]) if k}


class Record(NamedTuple):
    """payload is None for revisits; payload_bytes and payload_digest are of the full payload."""

    page_id: int | None
    url: str | None
    record_type: str
    payload: bytes | None
    payload_bytes: int
    payload_digest: str
    refers_to: int | None


def parse(raw: bytes) -> tuple[Record | None, int]:
    """The record that `raw` begins with and its length; None in place of a record of another type. A digest that isn't
    the payload's, or a record that ends too early, raises ValueError."""
    if not raw.startswith(b"WARC/1."):
        raise ValueError("no WARC record here")
    at = raw.index(b"\r\n\r\n")
    named = fields(raw[:at])
    end = at + 4 + int(named["content-length"])
    if raw[end : end + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record ends too early")
    kind = named["warc-type"]
    if kind not in ("response", "revisit"):
        return None, end + 4
    block = raw[at + 4 : end]
    split = block.index(b"\r\n\r\n") + 4
    http, digest = fields(block[: split - 4]), named["warc-payload-digest"].removeprefix("sha1:")
    if kind == "revisit":
        return Record(page_of(named["warc-record-id"]), named.get("warc-target-uri"), kind, None, int(http["content-length"]), digest, page_of(named["warc-refers-to"])), end + 4
    payload = block[split:]
    if payload_digest(payload) != digest:
        raise ValueError(f"{named['warc-record-id']}: the payload isn't what its digest says")
    return Record(page_of(named["warc-record-id"]), named.get("warc-target-uri"), kind, payload, len(payload), digest, None), end + 4


# ---- packages


class Counted:
    """What is written goes on, and is counted; seeking is refused, so that the ZIP writer streams."""

    def __init__(self, to):
        self.to, self.size = to, 0

    def write(self, data: bytes) -> int:
        self.to.write(data)
        self.size += len(data)
        return len(data)

    def flush(self) -> None:
        pass


class PackageWriter:
    """One package, written from front to back: nothing is kept but a line for each record."""

    def __init__(self, path: str):
        where, at = file_system(path)
        where.create_dir(at.rpartition("/")[0], recursive=True)
        self.path, self.out, self.lines = path, where.open_output_stream(at), []
        self.zip = zipfile.ZipFile(Counted(self.out), "w", zipfile.ZIP_STORED, allowZip64=True)
        # sizes aren't known beforehand: ZIP64 fields, so that a member may be of any size
        self.member, self.size, self.payload = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True), 0, 0

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: tuple | None, date: str) -> None:
        packed = zlib.compressobj(6, wbits=31)
        raw = record(page_id, url, payload, refers_to, date)
        data = packed.compress(raw) + packed.flush()
        self.member.write(data)
        self.lines.append(json.dumps({"offset": self.size, "length": len(data), "type": "revisit" if refers_to else "response", "id": record_id(page_id)}))
        self.size += len(data)
        self.payload += len(payload)

    def close(self) -> dict:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            for k in range(0, len(self.lines), 4096):
                f.write("".join(f"{line}\n" for line in self.lines[k : k + 4096]).encode())
        self.zip.close()
        self.out.close()
        return {"path": self.path, "records": len(self.lines), "bytes": self.size}


class Member(NamedTuple):
    name: str
    method: int
    size: int
    packed: int
    header: int


class Package:
    """A package's members by its directory, and their bytes by ranges. `opened` reads at an offset and knows its size."""

    def __init__(self, opened):
        self.file = opened
        self.members = {m.name: m for m in self._directory()}

    @classmethod
    def at(cls, path: str) -> Package:
        where, place = file_system(path)
        return cls(where.open_input_file(place))

    def range(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError("a package ends too early")
        return data

    def _size(self) -> int:
        return self.file.seek(0, 2)

    def _directory(self) -> Iterator[Member]:
        total = self._size()
        # the end record is 22 bytes and a comment of up to 65535
        tail = self.range(max(0, total - 22 - _FULL16), min(total, 22 + _FULL16))
        found = len(tail)
        while (found := tail.rfind(_END, 0, found)) >= 0:
            if found + 22 <= len(tail) and found + 22 + struct.unpack_from("<H", tail, found + 20)[0] == len(tail):
                break
        if found < 0:
            raise ValueError("no ZIP directory")
        count, size, start = struct.unpack_from("<HII", tail, found + 10)
        end = total - len(tail) + found
        if count == _FULL16 or size == _FULL32 or start == _FULL32:
            locator = self.range(end - 20, 20)
            if not locator.startswith(_LOCATOR):
                raise ValueError("no ZIP64 locator where the directory needs one")
            at = struct.unpack_from("<Q", locator, 8)[0]
            end64 = self.range(at, 56)
            if not end64.startswith(_END64):
                raise ValueError("no ZIP64 end record where its locator points")
            count, size, start = struct.unpack_from("<QQQ", end64, 32)
        raw, at = self.range(start, size), 0
        for _ in range(count):
            if raw[at : at + 4] != _ENTRY:
                raise ValueError("the ZIP directory is torn")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            packed, full, name, extra, comment = struct.unpack_from("<IIHHH", raw, at + 20)
            header = struct.unpack_from("<I", raw, at + 42)[0]
            text = raw[at + 46 : at + 46 + name].decode("utf-8" if flags & 0x800 else "cp437")
            if _FULL32 in (packed, full, header):
                wide = iter(self._wide(raw[at + 46 + name : at + 46 + name + extra]))
                full, packed, header = (next(wide) if x == _FULL32 else x for x in (full, packed, header))
            yield Member(text, method, full, packed, header)
            at += 46 + name + extra + comment

    @staticmethod
    def _wide(extra: bytes) -> list[int]:
        """The eight-byte numbers of the ZIP64 field."""
        at = 0
        while at + 4 <= len(extra):
            tag, size = struct.unpack_from("<HH", extra, at)
            if tag == 1:
                return list(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            at += 4 + size
        raise ValueError("no ZIP64 field where the directory needs one")

    def data(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many they are."""
        m = self.members[name]
        if m.method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} isn't stored, so it can't be read by ranges")
        head = self.range(m.header, 30)
        if not head.startswith(_LOCAL):
            raise ValueError(f"no member where the directory has {name}")
        # the local name and extra field have lengths of their own
        return m.header + 30 + sum(struct.unpack_from("<HH", head, 26)), m.packed

    def archives(self) -> list[str]:
        """Members with records; `data` refuses those that aren't stored."""
        return [n for n in self.members if n.startswith("archive/") and n.endswith((".warc", ".warc.gz"))]

    def index(self) -> Iterator[dict]:
        """The lines of the index, a piece at a time."""
        start, size = self.data(INDEX)
        rest = b""
        for a in range(0, size, STEP):
            *lines, rest = (rest + self.range(start + a, min(STEP, size - a))).split(b"\n")
            yield from map(json.loads, lines)
        if rest:
            yield json.loads(rest)

    def ranges(self, range_bytes: int = RANGE_BYTES) -> Iterator[tuple[int, int, bool]]:
        """Offset in the file, length, gzipped: consecutive records of `range_bytes` and the last one's rest at most. An
        archive without an index is one range."""
        names = self.archives()
        if INDEX in self.members and names == [ARCHIVE]:
            start, held, begin = self.data(ARCHIVE)[0], 0, 0
            for line in self.index():
                if held and line["offset"] != begin + held:
                    yield start + begin, held, True
                    held = 0
                if not held:
                    begin = line["offset"]
                held += line["length"]
                if held >= range_bytes:
                    yield start + begin, held, True
                    held = 0
            if held:
                yield start + begin, held, True
        else:
            for name in names:
                start, size = self.data(name)
                if size:
                    yield start, size, name.endswith(".gz")

    def records(self, offset: int, length: int, gzipped: bool) -> Iterator[Record]:
        """The records of a range, read piece by piece: what is held is one record and a piece."""
        place, end, raw = offset, offset + length, b""
        inflate = zlib.decompressobj(wbits=31) if gzipped else None
        while place < end or raw:
            need = needed(raw)
            if need is not None and len(raw) >= need:
                found, used = parse(raw[:need])
                raw = raw[used:]
                if found:
                    yield found
                continue
            if place >= end:
                raise ValueError("a WARC record ends too early")
            piece = self.range(place, min(STEP // 8, end - place))
            place += len(piece)
            if not inflate:
                raw += piece
                continue
            parts = [raw]
            while piece:
                parts.append(inflate.decompress(piece))
                piece = inflate.unused_data
                if inflate.eof:
                    inflate = zlib.decompressobj(wbits=31)
            raw = b"".join(parts)


def needed(raw: bytes) -> int | None:
    """The length of the record that `raw` begins with, None while its header isn't whole."""
    at = raw.find(b"\r\n\r\n")
    return None if at < 0 else at + 8 + int(fields(raw[:at])["content-length"])


# ---- on Spark


def choices(pages: DataFrame, least: int) -> DataFrame:
    """key, keeper (the largest id), _n: of payloads of `least` bytes or more those that several rows have."""
    known = pages.select("page_id", F.sha2(F.col("html"), 256).alias("key")).where(F.octet_length("html") >= least)
    return known.groupBy("key").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("_n")).where("_n > 1")


def write_archives(pages: DataFrame, package_bytes: int = PACKAGE_BYTES, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of `pages` (page_id, url, html; further columns are not read) into packages in the
    shared folder; returns the manifest: path, records, bytes of each.

    Null html is an empty payload, a null url has no target line. Of rows with equal payloads (told by SHA-256) of
    `least` bytes or more that with the largest page_id (null smallest) is a response, the others revisit it; rows that
    share the largest page_id are responses all. Rows are dealt by payload and hash, so a payload that very many rows
    have is spread; each task writes packages of `package_bytes` of payload. A task that is run again writes files of
    other names; the manifest names those of the run that succeeded. An empty table has an empty manifest.
    """
    to = new_path(pages.sparkSession, "packages")
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    chosen = stored(choices(slim, least), "choices")
    keyed = slim.select("page_id", "url", "html", F.sha2("html", 256).alias("key"), F.monotonically_increasing_id().alias("_row"))
    told = lookup(keyed, chosen.select("key", "keeper", F.lit(True).alias("several")), "key", chosen, "left")
    kept = F.col("several").isNull() | F.col("keeper").eqNullSafe(F.col("page_id"))
    names = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                if package is None:
                    package = PackageWriter(f"{to}/{uuid.uuid4().hex}.wacz")
                page_id, url, html, kept, keeper = (c[k].as_py() for c in batch.columns)
                package.add(page_id, url, html.encode(), None if kept else (keeper,), date)
                if package.payload >= package_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_pylist(done, names)

    return stored(told.select("page_id", "url", "html", kept.alias("kept"), "keeper").mapInArrow(run, "path string, records long, bytes long"), "manifest", ROWS)


def locate(packages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, offset, length, gzipped: ranges of records of the `packages` (path), from their directories and indexes."""
    names = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("gzipped", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = [(path, *r) for r in Package.at(path).ranges(range_bytes)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), names)], schema=names)

    return packages.select("path").mapInArrow(run, "path string, offset long, length long, gzipped boolean")


def read_archives(packages: DataFrame, range_bytes: int = RANGE_BYTES, payload: bool = False) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, and with `payload` the payload (binary, null
    for revisits), of every response and revisit of the `packages` (path). Ranges of records are dealt over tasks,
    whichever package they are in."""
    # rows are small and what they stand for isn't, so the number of tasks is told by their number
    ranges = stored(locate(packages.repartition(-(-max(1, packages.count()) // PACKAGES_A_TASK), "path"), range_bytes), "ranges")
    kinds = [("page_id", "long", pa.int64()), ("url", "string", pa.string()), ("record_type", "string", pa.string()), ("payload_bytes", "long", pa.int64()), ("payload_digest", "string", pa.string()), ("refers_to", "long", pa.int64())]
    kinds += [("payload", "binary", pa.binary())] if payload else []
    names = pa.schema([(n, t) for n, _, t in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, opened = [], 0, (None, None)
        for batch in batches:
            for path, *where in zip(*(c.to_pylist() for c in batch.columns)):
                if opened[0] != path:
                    opened = path, Package.at(path)
                for r in opened[1].records(*where):
                    rows.append([getattr(r, n) for n, _, _ in kinds])
                    held += len(r.payload or b"") if payload else 64
                    if held >= STEP:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), names)], schema=names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), names)], schema=names)

    dealt = ranges.repartition(-(-max(1, ranges.count()) // RANGES_A_TASK), "path", "offset")
    return dealt.select("path", "offset", "length", "gzipped").mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in kinds))


def op12_warc(spark, sf_dir):
    """Every page's record as written to packages and read back from them."""
    read = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 by 40 bits: eight letters of five bits each.
OP12_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS x FROM pages
), d AS (
  SELECT page_id, payload_bytes, x, max(page_id) OVER (PARTITION BY x) AS keeper, array_to_string(list_transform(range(32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST((CAST('0x' || x[10 * (i // 8) + 1:10 * (i // 8) + 10] AS UBIGINT) >> CAST(35 - 5 * (i % 8) AS UBIGINT)) & 31 AS INTEGER)]), '') AS payload_digest FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM d
"""
