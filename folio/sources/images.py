"""Kinds and sizes of images from their first bytes, as Column functions over Arrow batches."""

from __future__ import annotations

import base64
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE = "struct<format:string,width:int,height:int>"
#: What each kind begins with (fixed values).
STARTS = (("png", b"\x89PNG\r\n\x1a\n"), ("gif", b"GIF8"), ("jpg", b"\xff\xd8"), ("bmp", b"BM"), ("tiff", b"II*\0"), ("tiff", b"MM\0*"), ("ico", b"\0\0\1\0"))
#: JPEG segments without a body, and those that tell the size.
BARE, FRAMES = {0x01, *range(0xD0, 0xD9)}, {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
#: Base64 characters that are looked at first.
PREFIX = 128


def format_of(raw: bytes) -> str | None:
    if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
        return "webp"
    return next((name for name, start in STARTS if raw.startswith(start)), None)


def _jpeg(raw: bytes) -> tuple[int, int]:
    at = 2
    while True:
        while raw[at] == 0xFF:
            at += 1
        kind = raw[at]
        at += 1
        if kind in BARE:
            continue
        if kind in FRAMES:
            height, width = struct.unpack_from(">HH", raw, at + 3)
            return width, height
        at += struct.unpack_from(">H", raw, at)[0]


def _tiff(raw: bytes) -> tuple[int, int]:
    order = "<" if raw[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", raw, 4)[0]
    found = {}
    for k in range(struct.unpack_from(order + "H", raw, at)[0]):
        tag, kind = struct.unpack_from(order + "HH", raw, at + 2 + 12 * k)
        found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), raw, at + 10 + 12 * k)[0]
    return found[256], found[257]


def _webp(raw: bytes) -> tuple[int, int]:
    kind = raw[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(raw[24:27], "little"), 1 + int.from_bytes(raw[27:30], "little")
    if kind == b"VP8L":
        bits = int.from_bytes(raw[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    width, height = struct.unpack_from("<HH", raw, 26)
    return width & 0x3FFF, height & 0x3FFF


def size_of(raw: bytes) -> tuple[str, int, int] | None:
    """(format, width, height); None for what isn't an image or ends before its size."""
    kind = format_of(raw)
    try:
        if kind == "png":
            return kind, *struct.unpack_from(">II", raw, 16)
        if kind == "gif":
            return kind, *struct.unpack_from("<HH", raw, 6)
        if kind == "bmp":
            old = struct.unpack_from("<I", raw, 14)[0] == 12
            width, height = struct.unpack_from("<HH" if old else "<ii", raw, 18)
            return kind, width, abs(height)
        if kind == "ico":
            return kind, raw[6] or 256, raw[7] or 256
        if kind in ("jpg", "tiff", "webp"):
            return kind, *{"jpg": _jpeg, "tiff": _tiff, "webp": _webp}[kind](raw)
    except (IndexError, KeyError, struct.error):
        pass
    return None


def size_of_base64(text: str) -> tuple[str, int, int] | None:
    """By the first characters, and by all where these don't tell."""
    for part in (text[:PREFIX], text):
        try:
            found = size_of(base64.b64decode(part[: len(part) // 4 * 4]))
        except ValueError:
            continue
        if found:
            return found
    return None


def _probe(values: pd.Series, one) -> pd.DataFrame:
    rows = [(one(v) if v is not None else None) or (None, None, None) for v in values]
    return pd.DataFrame(rows, columns=["format", "width", "height"]).astype({"width": "Int32", "height": "Int32"})


def image_size(content: Column) -> Column:
    """SIZE of a binary; fields are null for what isn't an image."""
    return _udf(size_of)(content)


def image_size_of_base64(text: Column) -> Column:
    return _udf(size_of_base64)(text)


def _udf(one):
    @F.pandas_udf(SIZE)
    def probe(values: pd.Series) -> pd.DataFrame:
        return _probe(values, one)

    return probe


def is_image(content: Column) -> Column:
    """Whether a binary begins like an image: weaker than decoding it."""
    start = F.hex(F.substring(content, 1, 12))
    webp = start.startswith("52494646") & start.endswith("57454250")
    out = webp
    for _, s in STARTS:
        out = out | start.startswith(s.hex().upper())
    return F.coalesce(out, F.lit(False))


def file_kind(path: Column, content: Column) -> Column:
    """pdf by its name, snip for an image by its content, else null."""
    return F.when(F.lower(path).endswith(".pdf"), "pdf").when(is_image(content), "snip")
