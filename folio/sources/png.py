"""PNG images: parts of them decoded line by line, turned, bordered and written again.

Lines are inflated and unfiltered one after the other, and each line's part that a crop wants goes into the crop's array,
so a task holds its crops, two lines and a piece of inflated data, not the page.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.sources.batches import bounded, tasks

# Fixed values of the format: its signature, samples of each colour type, offsets and steps of the seven passes.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
PIECE = 1 << 16


class PngError(ValueError):
    """What isn't a readable PNG."""


class Head(NamedTuple):
    width: int
    height: int
    depth: int
    kind: int
    interlaced: int


# ---- filters, which PDF streams have too


def undone(kind: int, row: bytes, above: bytes, size: int) -> bytes:
    """A row without its filter (none, left, up, mean, Paeth); `size` bytes are a pixel."""
    if kind == 0:
        return row
    if kind == 1:
        pixels = np.frombuffer(row + bytes(-len(row) % size), np.uint8).reshape(-1, size)
        return np.cumsum(pixels, 0, dtype=np.uint8).tobytes()[: len(row)]
    if kind == 2:
        return (np.frombuffer(row, np.uint8) + np.frombuffer(above, np.uint8)).tobytes()
    if kind > 4:
        raise PngError(f"no filter {kind}")
    out = bytearray(len(row))
    for c in range(min(size, len(row))):  # each byte of a pixel by itself, so that the one to the left is the last one
        left, corner, own = 0, 0, []
        if kind == 3:
            for x, up in zip(row[c::size], above[c::size]):
                left = (x + (left + up >> 1)) & 255
                own.append(left)
        else:
            for x, up in zip(row[c::size], above[c::size]):
                p, q = up - corner, left - corner
                a, b, d = abs(p), abs(q), abs(p + q)
                left = (x + (left if a <= b and a <= d else up if b <= d else corner)) & 255
                own.append(left)
                corner = up
        out[c::size] = bytes(own)
    return bytes(out)


def filtered(kind: int, rows: np.ndarray, above: np.ndarray, size: int) -> np.ndarray:
    """Rows (n, bytes) with a filter, each with its mark in front; `above` are the rows over them."""
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    out[:, 0] = kind
    if kind in (0, 2):
        out[:, 1:] = rows - above if kind else rows
        return out
    x, up = rows.astype(np.int16), above.astype(np.int16)
    left, corner = np.zeros_like(x), np.zeros_like(x)
    left[:, size:], corner[:, size:] = x[:, :-size], up[:, :-size]
    if kind == 4:
        a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        less = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    else:
        less = left if kind == 1 else left + up >> 1
    out[:, 1:] = (x - less) & 255
    return out


# ---- reading


def chunks(raw: bytes) -> Iterator[tuple[bytes, memoryview]]:
    """Names and contents, whose checksums must hold."""
    if raw[:8] != SIGNATURE:
        raise PngError("no PNG")
    at, view = 8, memoryview(raw)
    while at + 12 <= len(raw):
        size, name = struct.unpack_from(">I4s", raw, at)
        if at + 12 + size > len(raw):
            break
        if zlib.crc32(view[at + 4 : at + 8 + size]) != struct.unpack_from(">I", raw, at + 8 + size)[0]:
            raise PngError(f"the checksum of {name!r} doesn't hold")
        yield name, view[at + 8 : at + 8 + size]
        if name == b"IEND":
            return
        at += 12 + size
    raise PngError("the image ends too early")


class Png:
    """An image's head, palette and compressed data, which stay where they are."""

    def __init__(self, raw: bytes):
        self.data, palette, clear = [], None, b""
        for name, body in chunks(raw):
            if name == b"IHDR":
                width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", body)
                if kind not in SAMPLES or not width or not height or interlaced > 1:
                    raise PngError("no such image")
                self.head = Head(width, height, depth, kind, interlaced)
            elif name == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif name == b"tRNS":
                clear = bytes(body)
            elif name == b"IDAT":
                self.data.append(body)
        if self.head.kind == 3 and palette is None:
            raise PngError("no palette")
        self.palette, self.clear = palette, clear
        if palette is not None and self.head.kind == 3 and clear:
            alpha = np.full(len(palette), 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
            self.palette = np.column_stack([palette, alpha])

    @property
    def channels(self) -> int:
        if self.head.kind == 3:
            return self.palette.shape[1]
        return SAMPLES[self.head.kind] + (self.head.kind in (0, 2) and bool(self.clear))

    def _inflated(self) -> Iterator[bytes]:
        inflate = zlib.decompressobj()
        try:
            for body in self.data:
                for a in range(0, len(body), PIECE):
                    part = inflate.decompress(body[a : a + PIECE], PIECE)
                    while part or inflate.unconsumed_tail:
                        yield part
                        part = inflate.decompress(inflate.unconsumed_tail, PIECE)
            yield inflate.flush()
        except zlib.error as e:
            raise PngError(f"the data are damaged: {e}") from e

    def _pieces(self) -> Iterator[bytes]:
        """As many bytes as are sent for; first None is sent."""
        source, held = self._inflated(), bytearray()
        size = yield b""
        while True:
            while len(held) < size:
                more = next(source, None)
                if more is None:
                    raise PngError("the image ends too early")
                held += more
            out = bytes(held[:size])
            del held[:size]
            size = yield out

    def lines(self) -> Iterator[tuple[int, slice, np.ndarray]]:
        """y, the x of its pixels, and the pixels (n, channels), of each line of each pass."""
        h, take = self.head, self._pieces()
        next(take)
        bits = h.depth * SAMPLES[h.kind]
        size = max(1, bits // 8)
        for x0, y0, dx, dy in PASSES if h.interlaced else ((0, 0, 1, 1),):
            width = -(-(h.width - x0) // dx)
            if width <= 0 or y0 >= h.height:
                continue
            above = bytes(-(-width * bits // 8))
            for y in range(y0, h.height, dy):
                line = take.send(len(above) + 1)
                above = undone(line[0], line[1:], above, size)
                yield y, slice(x0, None, dx), self._pixels(above, width)

    def _pixels(self, line: bytes, width: int) -> np.ndarray:
        h, n = self.head, SAMPLES[self.head.kind]
        raw = np.frombuffer(line, np.uint8)
        if h.depth == 16:
            own = np.frombuffer(line, ">u2").astype(np.uint16)
        elif h.depth == 8:
            own = raw
        else:
            own = np.unpackbits(raw).reshape(-1, h.depth)
            own = (own << np.arange(h.depth - 1, -1, -1, dtype=np.uint8)).sum(1, dtype=np.uint8)
        own = own[: width * n].reshape(width, n)
        if h.kind == 3:
            if int(own.max()) >= len(self.palette):
                raise PngError("a colour that the palette doesn't have")
            return self.palette[own[:, 0]]
        full = 65535 if h.depth == 16 else 255
        clear = None
        if self.clear and h.kind in (0, 2):
            clear = (own == np.frombuffer(self.clear, ">u2")[:n]).all(1)
        if h.depth < 8:
            own = own * np.uint8(255 // ((1 << h.depth) - 1))
        return own if clear is None else np.column_stack([own, np.where(clear, 0, full).astype(own.dtype)])

    def crops(self, boxes: list[tuple[int, int, int, int]]) -> list[np.ndarray]:
        """Pixels (height, width, channels) of boxes in pixels, cut at the image's edges; a box without a pixel in it is
        one white pixel."""
        kind = np.uint16 if self.head.depth == 16 else np.uint8
        cut = [(max(0, a), max(0, b), min(self.head.width, c), min(self.head.height, d)) for a, b, c, d in boxes]
        out = [np.zeros((max(0, d - b), max(0, c - a), self.channels), kind) for a, b, c, d in cut]
        last = max((d for _, _, _, d in cut), default=0)
        for y, xs, pixels in self.lines() if any(x.size for x in out) else ():
            for (a, b, c, d), own in zip(cut, out):
                if b <= y < d and own.size:
                    first = max(0, -(-(a - xs.start) // xs.step))
                    end = max(first, -(-(c - xs.start) // xs.step))
                    at = xs.start + first * xs.step - a
                    own[y - b, at :: xs.step][: end - first] = pixels[first:end]
            if y + 1 >= last and not self.head.interlaced:
                break
        return [x if x.size else np.full((1, 1, self.channels), np.iinfo(kind).max, kind) for x in out]


def whole(raw: bytes) -> np.ndarray:
    png = Png(raw)
    return png.crops([(0, 0, png.head.width, png.head.height)])[0]


# ---- changing and writing


def turned(pixels: np.ndarray, degrees: int) -> np.ndarray:
    """Turned clockwise by quarters."""
    return np.rot90(pixels, -(degrees // 90) % 4)


def bordered(pixels: np.ndarray, border: int) -> np.ndarray:
    """With a white border."""
    return np.pad(pixels, ((border, border), (border, border), (0, 0)), constant_values=np.iinfo(pixels.dtype).max) if border else pixels


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def encoded(pixels: np.ndarray, filters: tuple[int, ...] = (2,), interlaced: bool = False) -> bytes:
    """A PNG of 8 or 16 bits a sample with the colour type of its channels; lines take `filters` in turn."""
    height, width, n = pixels.shape
    kind, size = {1: 0, 2: 4, 3: 2, 4: 6}[n], n * pixels.dtype.itemsize
    raw, packer, data = pixels.astype(pixels.dtype.newbyteorder(">")), zlib.compressobj(6), []
    for x0, y0, dx, dy in PASSES if interlaced else ((0, 0, 1, 1),):
        part = raw[y0::dy, x0::dx]
        if not part.size:
            continue
        rows = np.frombuffer(part.tobytes(), np.uint8).reshape(len(part), -1)
        above = np.vstack([np.zeros_like(rows[:1]), rows[:-1]])
        lines = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
        for k, f in enumerate(filters[: len(rows)]):
            lines[k :: len(filters)] = filtered(f, rows[k :: len(filters)], above[k :: len(filters)], size)
        data.append(packer.compress(lines.tobytes()))
    head = struct.pack(">IIBBBBB", width, height, 8 * pixels.dtype.itemsize, kind, 0, 0, int(interlaced))
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", b"".join(data) + packer.flush()) + _chunk(b"IEND", b"")


# ---- on Spark


def crop_images(images: DataFrame, crops: DataFrame, border: int = 0) -> DataFrame:
    """token, page, name, width, height, content, error of `crops` (token, page, name, x1, y1, x2, y2 in pixels, turn in
    degrees clockwise) out of `images` (token, page, content: PNG). An image that can't be read gives an error for each
    of its crops; crops without an image give none."""
    box = F.struct("name", *[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2", "turn")])
    n = tasks(images.sparkSession)
    wanted = crops.repartition(n, "token", "page").groupBy("token", "page").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    names = pa.schema([("token", pa.string()), ("page", pa.int32()), ("name", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("content", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                token, page, content, boxes = (c[k].as_py() for c in batch.columns)
                try:
                    found = Png(content or b"").crops([(b["x1"], b["y1"], b["x2"], b["y2"]) for b in boxes])
                except (PngError, AttributeError, struct.error) as e:
                    rows = [(token, page, b["name"], None, None, None, str(e) if isinstance(e, PngError) else "no PNG") for b in boxes]
                else:
                    shown = [bordered(turned(p, b["turn"] or 0), border) for p, b in zip(found, boxes)]
                    rows = [(token, page, b["name"], p.shape[1], p.shape[0], encoded(p), None) for p, b in zip(shown, boxes)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), names)], schema=names)

    bounded(images.sparkSession)
    both = images.select("token", "page", "content").repartition(n, "token", "page").join(wanted, ["token", "page"])
    return both.select("token", F.col("page").cast("int").alias("page"), "content", "boxes").mapInArrow(run, "token string, page int, name string, width int, height int, content binary, error string")
