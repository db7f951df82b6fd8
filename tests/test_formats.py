"""PDF geometry and joining, PNG crops: against plain scans and slices of arrays."""

import io
import random
import re
import struct
import zlib

import numpy as np
import pytest

from folio.plans.pdfs import pdf_of, streamed
from folio.sources import pdfs, png

# ---- PDF


def geometry(raw):
    return list(pdfs.geometry(pdfs.Pdf(io.BytesIO(raw))))


def by_scan(raw):
    """Boxes and turns of pages whose objects name them, in the order of the file, by patterns over its bytes."""
    out = []
    for own in re.findall(rb"obj\n(<<.*?/Type /Page\b.*?)\nendobj", raw, re.S):
        box = re.search(rb"/MediaBox \[([^\]]*)\]", own)
        turn = int(re.search(rb"/Rotate (-?\d+)", own)[1])
        w, h = (float(x) for x in box[1].split()[2:])
        out.append((turn, *((h, w) if turn % 180 else (w, h))))
    return out


def test_pages_equal_a_plain_scan():
    for d in (0, 4, 8, 3, 7):
        raw = pdf_of(d, "\n".join(f"line {k} endobj (" for k in range(60)))
        assert [(r[5], r[6], r[7]) for r in geometry(raw)] == by_scan(raw)


def test_boxes_are_inherited_cropped_and_turned():
    name, ref = pdfs.Name, pdfs.Ref
    page = lambda up, **k: {"Type": name("Page"), "Parent": ref(up, 0)} | k
    objects = [
        {"Type": name("Catalog"), "Pages": ref(2, 0)},
        {"Type": name("Pages"), "Kids": [ref(3, 0), ref(6, 0), ref(2, 0), ref(99, 0)], "MediaBox": ref(7, 0), "Rotate": 90},
        {"Type": name("Pages"), "Parent": ref(2, 0), "Kids": [ref(4, 0), ref(5, 0)], "Rotate": 0, "CropBox": [0, 0, 50, 700]},
        page(3), page(3, MediaBox=[300, 400, 0, 0], Rotate=450), page(2, CropBox=[900, 900, 950, 950], Rotate=45), [10.5, -20, 110.5, ref(8, 0)], 180,
    ]
    want = [(0, 10.5, 0.0, 50.0, 180.0, 0, 39.5, 180.0), (1, 0.0, 0.0, 50.0, 400.0, 90, 400.0, 50.0), (2, 10.5, -20.0, 110.5, 180.0, 0, 100.0, 200.0)]
    classic = pdfs.assembled([pdfs.written(x) for x in objects])
    for raw in (classic, streamed(objects), classic.replace(b"xref", b"xxxx"), classic[: classic.rindex(b"xref\n")], b"junk\n" + classic):
        assert geometry(raw) == want


def test_older_references_hold_where_newer_do_not_say():
    """An update appends an object and a table that leads to the one before; a page without a box is a letter's."""
    raw = pdf_of(0, "a")
    at = int(re.findall(rb"startxref\s+(\d+)", raw)[-1])
    page = len(raw)
    raw += b"4 0 obj\n<</Type /Page /Parent 2 0 R /Rotate 270 /Contents 3 0 R /Note (a \\) b (c) [ << ) >>\nendobj\n"
    table = len(raw)
    raw += b"xref\n4 1\n%010d 00000 n \ntrailer\n<</Size 5 /Root 1 0 R /Prev %d>>\nstartxref\n%d\n%%%%EOF" % (page, at, table)
    assert geometry(raw) == [(0, 0.0, 0.0, 612.0, 792.0, 270, 792.0, 612.0)]


def test_wrong_files_are_rows_with_an_error(spark, tmp_path):
    circle = pdfs.assembled([b"<</Type /Catalog /Pages 2 0 R>>", b"<</Type /Pages /Kids [2 0 R] /Count 1>>"])
    files = {"text": b"no PDF at all", "empty": b"", "cut": pdf_of(1, "a\n" * 40)[:300], "circle": circle, "good": pdf_of(5, "a\n" * 40)}
    for k, v in files.items():
        (tmp_path / k).write_bytes(v)
    df = spark.createDataFrame([(f"file://{tmp_path}/{k}",) for k in [*files, "missing"]], "path string")
    rows = pdfs.page_boxes(df).collect()
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in rows}
    assert errors["good"] is None and sum(r.path.endswith("good") for r in rows) == 4
    assert all(errors[k] for k in ("text", "empty", "cut", "circle", "missing")) and errors["circle"] == "no pages"


def test_damaged_bytes_never_raise_anything_else():
    r, good = random.Random(4), [pdf_of(d, "some text\n" * 30) for d in range(4)]
    for _ in range(400):
        raw = bytearray(r.choice(good))
        for _ in range(r.randrange(1, 30)):
            raw[r.randrange(len(raw))] = r.randrange(256)
        try:
            geometry(bytes(raw))
        except (pdfs.PdfError, KeyError, TypeError, ValueError, IndexError, RecursionError):
            pass


def test_joined_files_have_all_pages_and_their_contents():
    texts = ["\n".join(f"{d}.{k}" for k in range(25)) for d in range(4)]
    parts = [pdf_of(d, t) for d, t in enumerate(texts)]
    for files in (parts, parts[::-1], parts * 2, [pdfs.concatenation(parts[:2]), pdfs.concatenation(parts[2:])]):
        out = pdfs.concatenation(files)
        assert [g[1:] for g in geometry(out)] == [g[1:] for raw in files for g in geometry(raw)]
        pdf = pdfs.Pdf(io.BytesIO(out))
        shown = "\n".join(pdfs.unpacked(pdf.at(page["Contents"])).decode() for _, page in pdf.pages())
        order = [texts[parts.index(f)] for f in files] if files[0] in parts else texts
        assert shown == "\n".join(order)
    with pytest.raises(pdfs.PdfError):
        pdfs.concatenation([pdfs.assembled([b"<</Type /Catalog /Pages 2 0 R>>", b"<</Type /Pages /Kids [] /Count 0>>"])])


def test_joined_pages_are_numbered_through(spark, tmp_path):
    for d in range(3):
        (tmp_path / f"{d}.pdf").write_bytes(pdf_of(d, "x\n" * 30))
    parts = spark.createDataFrame([("o", d, f"file://{tmp_path}/{d}.pdf") for d in (2, 0, 1)] + [("p", 0, f"file://{tmp_path}/1.pdf")], "output string, nth long, path string")
    rows = pdfs.joined(pdfs.page_boxes(parts.select("path").distinct()), parts).collect()
    assert sorted((r.output, r.n, r.path[-5], r.page) for r in rows) == [("o", 3 * d + p, str(d), p) for d in range(3) for p in range(3)] + [("p", p, "1", p) for p in range(3)]


# ---- PNG


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_crops_equal_slices(channels, kind, interlaced):
    r = np.random.default_rng(channels)
    for h, w in ((1, 1), (3, 5), (17, 23), (40, 33)):
        pixels = r.integers(0, np.iinfo(kind).max, (h, w, channels), endpoint=True).astype(kind)
        raw = png.encoded(pixels, (0, 1, 2, 3, 4), interlaced)
        assert (png.whole(raw) == pixels).all()
        boxes = [(1, 1, w - 1, h - 1), (0, 0, w, 1), (w // 2, h // 3, w + 5, h + 9), (-3, -2, 2, 2), (5, 5, 5, 9), (w + 1, 0, w + 4, 3)]
        for (a, b, c, d), got in zip(boxes, png.Png(raw).crops(boxes)):
            own = pixels[max(0, b) : max(0, d), max(0, a) : max(0, c)]
            assert (got == own).all() if own.size else got.shape == (1, 1, channels) and (got == np.iinfo(kind).max).all()


def image(width, height, depth, kind, lines, more=()):
    """A PNG by hand: lines are packed bytes without a filter."""
    head = png._chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, 0))
    data = zlib.compress(b"".join(b"\0" + x for x in lines))
    half = len(data) // 2
    return png.SIGNATURE + head + b"".join(png._chunk(n, b) for n, b in more) + png._chunk(b"IDAT", data[:half]) + png._chunk(b"IDAT", data[half:]) + png._chunk(b"IEND", b"")


def test_packed_samples_palettes_and_clear_colours():
    assert png.whole(image(5, 2, 1, 0, [b"\xa8", b"\x50"])).tolist() == [[[255], [0], [255], [0], [255]], [[0], [255], [0], [255], [0]]]
    assert png.whole(image(3, 1, 2, 0, [b"\x6c"])).tolist() == [[[85], [170], [255]]]
    assert png.whole(image(3, 1, 4, 0, [b"\x0f\x80"])).tolist() == [[[0], [255], [136]]]
    colours = (b"PLTE", bytes([1, 2, 3, 4, 5, 6, 7, 8, 9]))
    assert png.whole(image(3, 1, 2, 3, [b"\x18"], [colours])).tolist() == [[[1, 2, 3], [4, 5, 6], [7, 8, 9]]]
    assert png.whole(image(3, 1, 8, 3, [b"\0\1\2"], [colours, (b"tRNS", b"\x10\x20")])).tolist() == [[[1, 2, 3, 16], [4, 5, 6, 32], [7, 8, 9, 255]]]
    assert png.whole(image(2, 1, 8, 0, [b"\x07\x08"], [(b"tRNS", b"\0\x07")])).tolist() == [[[7, 0], [8, 255]]]
    for raw in (b"", b"not an image", image(3, 1, 2, 3, [b"\x3f"], [colours]), image(2, 2, 8, 0, [b"\0\0"]), image(2, 1, 8, 0, [b"\0\0"])[:-20], image(1, 1, 8, 9, [b"\0"]), image(2, 1, 8, 0, [b"\0\0"]).replace(b"IDAT", b"IDAX", 1)):
        with pytest.raises((png.PngError, AttributeError)):
            png.whole(raw)


def test_turns_and_borders():
    own = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    assert png.turned(own, 90)[:, :, 0].tolist() == [[3, 0], [4, 1], [5, 2]] and png.turned(own, 450)[:, :, 0].tolist() == [[3, 0], [4, 1], [5, 2]]
    assert png.turned(own, 180)[:, :, 0].tolist() == [[5, 4, 3], [2, 1, 0]] and png.turned(own, -90)[:, :, 0].tolist() == [[2, 5], [1, 4], [0, 3]]
    edge = png.bordered(own, 2)
    assert edge.shape == (6, 7, 1) and (edge[2:4, 2:5] == own).all() and edge.sum() == own.sum() + 255 * (42 - 6) and png.bordered(own, 0) is own


def test_a_crop_does_not_hold_the_page():
    import tracemalloc

    pixels = np.random.default_rng(1).integers(0, 8, (3000, 2000, 3)).astype(np.uint8)
    raw = png.encoded(pixels, (2,))
    tracemalloc.start()
    got = png.Png(raw).crops([(100, 2000, 160, 2040)])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == pixels[2000:2040, 100:160]).all() and peak < 2_000_000 < pixels.nbytes / 8


def test_crops_of_tables(spark):
    pixels = np.random.default_rng(2).integers(0, 255, (20, 30, 3)).astype(np.uint8)
    images = spark.createDataFrame([("a", 0, bytearray(png.encoded(pixels))), ("a", 1, bytearray(b"broken")), ("b", 0, None), ("c", 0, bytearray(png.encoded(pixels)))], "token string, page int, content binary")
    crops = spark.createDataFrame([("a", 0, "one", 2, 3, 10, 9, 90), ("a", 0, "two", 5, 5, 5, 5, None), ("a", 1, "three", 0, 0, 1, 1, 0), ("b", 0, "four", 0, 0, 1, 1, 0), ("d", 0, "five", 0, 0, 1, 1, 0)], "token string, page int, name string, x1 int, y1 int, x2 int, y2 int, turn int")
    got = {r.name: r for r in png.crop_images(images, crops, border=1).collect()}
    assert set(got) == {"one", "two", "three", "four"} and (got["three"].error, got["four"].error) == ("no PNG", "no PNG")
    assert (png.whole(bytes(got["one"].content))[1:-1, 1:-1] == png.turned(pixels[3:9, 2:10], 90)).all() and (got["one"].width, got["one"].height) == (8, 10)
    assert (png.whole(bytes(got["two"].content)) == 255).all() and got["two"].width == 3
    assert png.crop_images(images.limit(0), crops).count() == 0
