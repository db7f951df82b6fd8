"""Page geometry of PDF files by ranges of their bytes, and files joined one after the other.

A file is read from its end: cross-reference tables and streams (with what came before them), then only the objects that
lead to the pages. Boxes, rotation and resources are inherited from the page tree's nodes. Where the references are
broken, objects are found by a plain scan. A damaged file is a row with an error. Files are dealt over tasks; a task
holds one file's page tree, or for joining the objects of one output.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.sinks.shared import file_system
from folio.sources.png import PngError, undone

#: Bytes that are read around a place at first; levels of the page tree and links to older references at most.
PIECE, DEEPEST, OLDEST = 4096, 64, 1000
#: Fixed values of the format: white space, delimiters, what a page inherits.
_BLANK, _DELIMITER = b" \t\r\n\f\0", b"()<>[]{}/%"
INHERITED = ("MediaBox", "CropBox", "Rotate", "Resources")
TOKEN = re.compile(rb"[ \t\r\n\f\0]*(?:%[^\r\n]*[ \t\r\n\f\0]*)*(<<|>>|[\[\]]|\(|<[0-9A-Fa-f \t\r\n\f\0]*>|/[^ \t\r\n\f\0()<>\[\]{}/%]*|[^ \t\r\n\f\0()<>\[\]{}/%]+)")


class PdfError(ValueError):
    """What isn't a readable PDF."""


class Name(str):
    """/Name, as it is written."""


class Ref(NamedTuple):
    number: int
    generation: int


class Raw(bytes):
    """A string as it is written, brackets and all."""


class Stream(NamedTuple):
    entries: dict
    data: bytes


# ---- objects


def parse(data: bytes, at: int = 0) -> tuple[object, int]:
    """The object at a place, and the place after it. Too few bytes: PdfError."""
    found = TOKEN.match(data, at)
    if not found:
        raise PdfError("no object here")
    token, at = found[1], found.end()
    if token == b"<<":
        entries: dict = {}
        while True:
            key, at = parse(data, at)
            if key is END_DICT:
                return entries, at
            if not isinstance(key, Name):
                raise PdfError("a dictionary's key is no name")
            entries[str(key)], at = parse(data, at)
    if token == b"[":
        items = []
        while True:
            item, at = parse(data, at)
            if item is END_LIST:
                return items, at
            items.append(item)
    if token == b"(":
        return _string(data, at)
    if token in ENDS:
        return ENDS[token], at
    if token[:1] == b"/":
        return Name(token[1:].decode("latin-1")), at
    if token[:1] == b"<":
        return Raw(token), at
    if at == len(data):
        raise PdfError("an object ends too early")  # a number may go on
    if token.isdigit():
        ref = re.compile(rb"[ \t\r\n\f\0]+(\d+)[ \t\r\n\f\0]+R(?![^ \t\r\n\f\0()<>\[\]{}/%])").match(data, at)
        return (Ref(int(token), int(ref[1])), ref.end()) if ref else (int(token), at)
    try:
        return (float(token) if b"." in token else int(token)), at
    except ValueError:
        return {b"true": True, b"false": False, b"null": None}.get(token, Word(token.decode("latin-1"))), at


class Word(str):
    """obj, stream, R and the like; what ends a dictionary or list."""


END_DICT, END_LIST = Word(">>"), Word("]")
ENDS = {b">>": END_DICT, b"]": END_LIST}


def _string(data: bytes, at: int) -> tuple[Raw, int]:
    start, depth = at - 1, 1
    while depth:
        found = re.compile(rb"\\.|[()]", re.S).search(data, at)
        if not found:
            raise PdfError("a string ends too early")
        depth += {b"(": 1, b")": -1}.get(found[0], 0)
        at = found.end()
    return Raw(data[start:at]), at


def written(value: object) -> bytes:
    if isinstance(value, Stream):
        return written(value.entries | {"Length": len(value.data)}) + b"\nstream\n" + value.data + b"\nendstream"
    if isinstance(value, dict):
        return b"<<" + b" ".join(b"/" + k.encode("latin-1") + b" " + written(v) for k, v in value.items()) + b">>"
    if isinstance(value, list):
        return b"[" + b" ".join(map(written, value)) + b"]"
    if isinstance(value, Ref):
        return b"%d %d R" % value
    if isinstance(value, Raw):
        return bytes(value)
    if isinstance(value, str):
        return b"/" + value.encode("latin-1")
    return {True: b"true", False: b"false", None: b"null"}[value] if value is None or isinstance(value, bool) else str(value).encode()


def unpacked(stream: Stream) -> bytes:
    """A stream's bytes; Flate with PNG predictors, or none."""
    kinds, parameters = stream.entries.get("Filter"), stream.entries.get("DecodeParms")
    kind = kinds[0] if isinstance(kinds, list) and len(kinds) == 1 else kinds
    if not kind:
        return stream.data
    if kind not in ("FlateDecode", "Fl"):
        raise PdfError(f"the filter {kind} isn't read")
    try:
        data = zlib.decompressobj().decompress(stream.data)
    except zlib.error as e:
        raise PdfError(f"a stream is damaged: {e}") from e
    p = (parameters[0] if isinstance(parameters, list) and parameters else parameters) or {}
    if p.get("Predictor", 1) < 10:
        return data
    width = -(-p.get("Columns", 1) * p.get("Colors", 1) * p.get("BitsPerComponent", 8) // 8)
    size, before, out = max(1, p.get("Colors", 1) * p.get("BitsPerComponent", 8) // 8), bytes(width), []
    try:
        for a in range(0, len(data) - width, width + 1):
            before = undone(data[a], data[a + 1 : a + 1 + width], before, size)
            out.append(before)
    except PngError as e:
        raise PdfError(str(e)) from e
    return b"".join(out)


# ---- files


class Pdf:
    """A file's objects by number. `opened` seeks and reads."""

    def __init__(self, opened):
        self.file, self.size = opened, opened.seek(0, 2)
        self.places: dict[int, tuple] = {}
        self.trailer: dict = {}
        self.known: dict[int, object] = {}
        self.packs: dict[int, dict[int, object]] = {}
        try:
            self._references()
            if not isinstance(self.at(self.trailer.get("Root")), dict) or not isinstance(self.at(self.at(self.trailer["Root"]).get("Pages")), dict):
                raise PdfError("no page tree")
        except PdfError:
            self._scan()

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(max(0, at))
        return self.file.read(max(0, min(n, self.size - at)))

    def _parsed(self, at: int, what) -> object:
        """What `what` reads at a place, with as many bytes as it takes."""
        n = PIECE
        while True:
            data = self._read(at, n)
            try:
                return what(data)
            except PdfError:
                if at + n >= self.size:
                    raise
                n *= 4

    def _references(self) -> None:
        tail = self._read(self.size - 1024, 1024)
        found = re.findall(rb"startxref\s+(\d+)", tail)
        if not found:
            raise PdfError("no startxref")
        todo, seen = [int(found[-1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen or len(seen) > OLDEST or at >= self.size:
                raise PdfError("references lead in a circle or nowhere")
            seen.add(at)
            trailer = self._table(at) if self._read(at, 16).lstrip(_BLANK).startswith(b"xref") else self._stream(at)
            self.trailer = trailer | self.trailer
            todo += [x for x in (trailer.get("XRefStm"), trailer.get("Prev")) if isinstance(x, int)]

    def _table(self, at: int) -> dict:
        """A classic table's places and trailer."""

        def read(data: bytes) -> tuple[list, dict]:
            end = data.find(b"trailer")
            if end < 0:
                raise PdfError("a table without a trailer")
            trailer, _ = parse(data, end + 7)
            rows, numbers = [], iter(data[:end].split()[1:])
            for first in numbers:
                for k in range(int(next(numbers))):
                    place, generation, kind = int(next(numbers)), int(next(numbers)), next(numbers)
                    if kind == b"n":
                        rows.append((int(first) + k, place, generation))
            return rows, trailer

        try:
            rows, trailer = self._parsed(at, read)
        except (ValueError, StopIteration, RuntimeError) as e:
            raise PdfError(f"a broken table: {e}") from e
        for number, place, generation in rows:
            self.places.setdefault(number, ("at", place, generation))
        return trailer

    def _stream(self, at: int) -> dict:
        """A cross-reference stream's places and its dictionary."""
        _, stream = self._object(at)
        if not isinstance(stream, Stream) or stream.entries.get("Type") != "XRef":
            raise PdfError("no references where they should be")
        widths, data = stream.entries["W"], unpacked(stream)
        index = stream.entries.get("Index") or [0, stream.entries["Size"]]
        row, k = sum(widths), 0
        for first, n in zip(index[::2], index[1::2]):
            for number in range(first, first + n):
                part, cut, values = data[k : k + row], 0, []
                for w in widths:
                    values.append(int.from_bytes(part[cut : cut + w], "big") if w else None)
                    cut += w
                kind = 1 if values[0] is None else values[0]
                if kind == 1:
                    self.places.setdefault(number, ("at", values[1], values[2] or 0))
                elif kind == 2:
                    self.places.setdefault(number, ("in", values[1], values[2]))
                k += row
        return stream.entries

    def _object(self, at: int, number: int | None = None) -> tuple[int, object]:
        """The number and value of the object at a place."""

        def read(data: bytes) -> tuple[int, object]:
            found = re.match(rb"[ \t\r\n\f\0]*(\d+)[ \t\r\n\f\0]+\d+[ \t\r\n\f\0]+obj", data)
            if not found:
                raise PdfError("no object where one should be")
            value, end = parse(data, found.end())
            after = re.compile(rb"[ \t\r\n\f\0]*(?:%[^\r\n]*[\r\n]+)*(stream\r?\n|endobj|\w)").match(data, end)
            if not after:
                raise PdfError("an object ends too early")
            if not after[1].startswith(b"stream"):
                return int(found[1]), value
            length = self.at(value.get("Length"))
            begin = after.end()
            if not isinstance(length, int) or not re.match(rb"[ \t\r\n\f\0]*endstream", data[begin + length : begin + length + 32]):
                stop = data.find(b"endstream", begin)
                if stop < 0:
                    raise PdfError("a stream ends too early")
                length = len(data[begin:stop].rstrip(b"\r\n")) if not isinstance(length, int) or begin + length > stop else length
            return int(found[1]), Stream(value, data[begin : begin + length])

        own, value = self._parsed(at, read)
        if number is not None and own != number:
            raise PdfError(f"object {own} where {number} should be")
        return own, value

    def at(self, value: object, depth: int = 0) -> object:
        """The value itself, or what it refers to; None for what isn't there."""
        if not isinstance(value, Ref):
            return value
        if depth > DEEPEST or value.number not in self.places:
            return None
        if value.number not in self.known:
            kind, where, nth = self.places[value.number]
            self.known[value.number] = self._object(where, value.number)[1] if kind == "at" else self._packed(where).get(value.number)
        return self.at(self.known[value.number], depth + 1)

    def _packed(self, number: int) -> dict[int, object]:
        """The objects of an object stream."""
        if number not in self.packs:
            self.packs[number] = {}
            stream = self.at(Ref(number, 0))
            if not isinstance(stream, Stream):
                raise PdfError("no object stream where one should be")
            data, n, first = unpacked(stream) + b" ", self.at(stream.entries["N"]), self.at(stream.entries["First"])
            head = [int(x) for x in data[:first].split()]
            self.packs[number] = {head[2 * k]: parse(data, first + head[2 * k + 1])[0] for k in range(n)}
        return self.packs[number]

    def _scan(self) -> None:
        """Objects by the words that begin them, the last of a number; for files whose references are broken."""
        self.places, self.trailer, self.known, self.packs = {}, {}, {}, {}
        data = self._read(0, self.size)
        if b"%PDF-" not in data[:1024]:
            raise PdfError("no PDF")
        for found in re.finditer(rb"(?<![0-9])(\d+)[ \t\r\n\f\0]+(\d+)[ \t\r\n\f\0]+obj(?![a-z])", data):
            self.places[int(found[1])] = ("at", found.start(), int(found[2]))
        for found in re.finditer(rb"trailer", data):
            try:
                value, _ = parse(data, found.end())
            except PdfError:
                continue
            if isinstance(value, dict):
                self.trailer |= value
        for number in list(self.places):
            try:
                value = self.at(Ref(number, 0))
                if isinstance(value, Stream) and value.entries.get("Type") == "ObjStm":
                    for k in self._packed(number):
                        self.places.setdefault(k, ("in", number, 0))
                elif isinstance(value, Stream) and value.entries.get("Type") == "XRef":
                    self.trailer = value.entries | self.trailer
            except (PdfError, KeyError, ValueError, TypeError):
                continue
        if not isinstance(self.at(self.trailer.get("Root")), dict):
            roots = [n for n in self.places if isinstance(v := self.at(Ref(n, 0)), dict) and v.get("Type") == "Catalog"]
            if not roots:
                raise PdfError("no catalog")
            self.trailer["Root"] = Ref(roots[-1], 0)

    def pages(self) -> Iterator[tuple[Ref | None, dict]]:
        """Each page with what it inherits, in order. A node that comes again inside itself ends there."""
        todo = [(self.at(self.trailer["Root"]).get("Pages"), {}, frozenset())]
        while todo:
            ref, above, inside = todo.pop()
            node = self.at(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and ref in inside) or len(inside) > DEEPEST:
                continue
            own = above | {k: node[k] for k in INHERITED if node.get(k) is not None}
            kids = self.at(node.get("Kids"))
            if isinstance(kids, list) and node.get("Type") != "Page":
                todo += [(k, own, inside | {ref} if isinstance(ref, Ref) else inside) for k in reversed(kids)]
            else:
                yield ref if isinstance(ref, Ref) else None, node | own

    def box(self, page: dict, name: str) -> tuple[float, ...] | None:
        values = self.at(page.get(name))
        values = [self.at(v) for v in values] if isinstance(values, list) else []
        if len(values) != 4 or not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
            return None
        return min(values[0], values[2]), min(values[1], values[3]), max(values[0], values[2]), max(values[1], values[3])


#: The box of a page that names none (fixed value).
LETTER = (0.0, 0.0, 612.0, 792.0)


def geometry(pdf: Pdf) -> Iterator[tuple]:
    """page, x1, y1, x2, y2 (the part of the media box that the crop box shows), rotate, width, height as they are seen."""
    for nth, (_, page) in enumerate(pdf.pages()):
        media = pdf.box(page, "MediaBox") or LETTER
        crop = pdf.box(page, "CropBox") or media
        shown = (max(media[0], crop[0]), max(media[1], crop[1]), min(media[2], crop[2]), min(media[3], crop[3]))
        if shown[0] >= shown[2] or shown[1] >= shown[3]:
            shown = media
        turn = pdf.at(page.get("Rotate"))
        turn = int(turn) % 360 if isinstance(turn, (int, float)) and int(turn) % 90 == 0 else 0
        w, h = shown[2] - shown[0], shown[3] - shown[1]
        yield nth, *map(float, shown), turn, *map(float, (h, w) if turn in (90, 270) else (w, h))


PAGES = "path string, page int, x1 double, y1 double, x2 double, y2 double, rotate int, width double, height double, error string"


def page_boxes(files: DataFrame) -> DataFrame:
    """PAGES of `files` (path): a row for each page, or one with an error for a file that can't be read or has no page."""
    names = pa.schema([(c, {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[t]) for c, t in (x.split() for x in PAGES.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    where, at = file_system(path)
                    with where.open_input_file(at) as f:
                        rows = [(path, *r, None) for r in geometry(Pdf(f))] or [(path, *[None] * 8, "no pages")]
                except (PdfError, OSError, KeyError, TypeError, ValueError, IndexError, RecursionError) as e:
                    rows = [(path, *[None] * 8, str(e) or type(e).__name__)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), names)], schema=names)

    return files.select("path").mapInArrow(run, PAGES)


def joined(pages: DataFrame, parts: DataFrame) -> DataFrame:
    """output, n, path, page and geometry: pages of `parts` (output, nth, path) numbered from 0 through each output."""
    rows = parts.join(pages.where("error is null"), "path")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("output").orderBy("nth", "path", "page")) - 1).drop("nth", "error")


def concatenation(files: list[bytes]) -> bytes:
    """The pages of files one after the other as one file: objects that pages lead to are numbered anew, what pages
    inherit is written into them, outlines and other things of a whole file go."""
    import io

    out: list[bytes | None] = [None, None]  # objects 1 and 2 are the catalog and the page tree
    kids = []
    for raw in files:
        pdf, numbers = Pdf(io.BytesIO(raw)), {}
        todo: list[tuple[int, object]] = []

        def number_of(ref: Ref, pdf=pdf, numbers=numbers, todo=todo) -> Ref:
            if ref.number not in numbers:
                out.append(None)
                numbers[ref.number] = len(out)
                todo.append((len(out), pdf.at(ref)))
            return Ref(numbers[ref.number], 0)

        def moved(value: object, number_of=number_of) -> object:
            if isinstance(value, Ref):
                return number_of(value)
            if isinstance(value, Stream):
                return Stream({k: moved(v) for k, v in value.entries.items()}, value.data)
            if isinstance(value, dict):
                return {k: moved(v) for k, v in value.items()}
            return [moved(v) for v in value] if isinstance(value, list) else value

        own = []
        for ref, page in pdf.pages():
            out.append(None)
            own.append((len(out), page))
            if ref is not None:
                numbers.setdefault(ref.number, len(out))
        for number, page in own:
            out[number - 1] = written(moved({k: v for k, v in page.items() if k != "Parent"}) | {"Type": Name("Page"), "Parent": Ref(2, 0)})
            kids.append(Ref(number, 0))
        while todo:
            number, value = todo.pop()
            if isinstance(value, dict) and value.get("Type") in ("Pages", "Catalog"):
                value = None  # a way back to the old tree
            out[number - 1] = written(moved(value))
    if not kids:
        raise PdfError("no pages to join")
    out[0] = written({"Type": Name("Catalog"), "Pages": Ref(2, 0)})
    out[1] = written({"Type": Name("Pages"), "Kids": kids, "Count": len(kids)})
    return assembled([x or b"null" for x in out])


def assembled(objects: list[bytes], root: int = 1) -> bytes:
    """A file of objects 1, 2 and so on with a classic table."""
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
    for k, body in enumerate(objects):
        places.append(len(out))
        out += b"%d 0 obj\n" % (k + 1) + body + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n" + written({"Size": len(objects) + 1, "Root": Ref(root, 0)}) + b"\nstartxref\n%d\n%%%%EOF\n" % at)


def concatenated(parts: DataFrame) -> DataFrame:
    """name, content: the files of each output of `parts` (output, nth, path) joined in order, for the file sink. Where a
    file can't be read its output is left out of the files, and `page_boxes` says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for output, paths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files = []
                for path in paths:
                    where, at = file_system(path)
                    with where.open_input_file(at) as f:
                        files.append(f.read())
                try:
                    content = concatenation(files)
                except (PdfError, KeyError, TypeError, ValueError, IndexError, RecursionError):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([output], pa.string()), pa.array([content], pa.binary())], names=["name", "content"])

    lists = parts.groupBy("output").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "path"))), lambda p: p["path"]).alias("paths"))
    return lists.mapInArrow(run, "name string, content binary")
