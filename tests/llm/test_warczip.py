"""Web archives in ZIP packages: read back, against the standard library's ZIP, with ZIP64 fields, and against SQL."""

import gzip
import hashlib
import io
import random
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from folio.llm import warczip
from folio.llm.common import new_path


def rows():
    r = random.Random(8)
    page = lambda n: "".join(r.choice("<p> abcé漢\r\n") for _ in range(n))
    out = [(k, f"http://x.example/{k}", page(r.choice([1, 30, 3000]))) for k in range(60)]
    out += [(100 + k, "http://copy.example/", out[3][2]) for k in range(50)]
    out += [(200, None, None), (201, "http://e", ""), (None, "http://null.id", "only here"), (None, "http://null.id", out[4][2]), (-7, "http://minus", out[4][2])]
    out += [(300, "http://bad\r\nInjected: yes\x00", "x\r\n\r\nWARC/1.1\r\n\r\n"), (301, "http://long", page(400_000)), out[5], out[5], (302, "", out[5][2])]
    return out


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("warc")
    df = spark.createDataFrame(rows(), "page_id long, url string, html string").select("*", *[F.lit(7).alias(c) for c in ("key", "keeper", "_row", "several", "_n", "path")])
    df.repartition(4).write.parquet(str(path / "pages.parquet"))
    return str(path)


def plain_version():
    by = {}
    for page_id, _, html in rows():
        by.setdefault(html or "", []).append(page_id)
    keeper = {h: max((i for i in ids if i is not None), default=None) for h, ids in by.items()}
    for page_id, url, html in rows():
        raw = (html or "").encode()
        kept = page_id == keeper[html or ""]
        yield page_id, url, "response" if kept else "revisit", len(raw), warczip.payload_digest(raw), None if kept else keeper[html or ""], raw if kept else None


def test_records_come_back(spark, table):
    manifest = warczip.write_archives(spark.read.parquet(f"{table}/pages.parquet"), package_bytes=5000)
    assert manifest.count() > 5 and manifest.agg(F.sum("records")).first()[0] == len(rows())
    want = [(i, u if u is None else warczip.header_value(u), *rest) for i, u, *rest in plain_version()]
    for size in (1, 3000, 1 << 22):
        got = warczip.read_archives(manifest, size, payload=True).collect()
        assert sorted(map(repr, ((*r[:6], None if r.payload is None else bytes(r.payload)) for r in got))) == sorted(map(repr, want))


def test_large_payloads_alone_are_told(spark, table):
    manifest = warczip.write_archives(spark.read.parquet(f"{table}/pages.parquet").where("page_id is not null"), least=2000)
    kinds = {r.page_id: (r.record_type, r.payload_bytes) for r in warczip.read_archives(manifest).collect()}
    assert all(kind == "response" for kind, n in kinds.values() if n < 2000)
    html = {i: h for i, _, h in rows()}
    for k in range(60):
        assert (kinds[k][0] == "revisit") == (kinds[k][1] >= 2000 and any(j is not None and j > k and h == html[k] for j, h in html.items()))


@pytest.mark.parametrize("limit", [None, 10])
def test_packages_are_zip_files(spark, monkeypatch, limit):
    """The standard library reads them; with a low limit they have ZIP64 fields and end records."""
    if limit:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    path = new_path(spark, "one") + "/p.wacz"
    writer = warczip.PackageWriter(path)
    for k in range(300):
        writer.add(k, f"http://x/{k}", bytes([65 + k % 20]) * k, (k + 1,) if k % 7 == 0 else None, "2020-01-01T00:00:00Z")
    writer.close()
    where, at = warczip.file_system(path)
    raw = where.open_input_file(at).read()
    assert (b"PK\6\6" in raw) == bool(limit)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and z.namelist() == [warczip.ARCHIVE, warczip.INDEX]
        whole = gzip.decompress(z.read(warczip.ARCHIVE))
    package = warczip.Package.at(path)
    read = [r for where in package.ranges(500) for r in package.records(*where)]
    assert [r.page_id for r in read] == list(range(300)) and whole.count(b"WARC/1.1\r\n") == 300
    assert all(r.payload_bytes == r.page_id and (r.refers_to == r.page_id + 1 if r.page_id % 7 == 0 else r.payload == bytes([65 + r.page_id % 20]) * r.page_id) for r in read)
    # one record by its index line
    line = next(x for x in package.index() if x["id"] == warczip.record_id(123))
    (one,) = package.records(package.data(warczip.ARCHIVE)[0] + line["offset"], line["length"], True)
    assert one.page_id == 123


class Ranges(io.BytesIO):
    """Counts the bytes that are read."""

    read_bytes = 0

    def read(self, n=-1):
        out = super().read(n)
        self.read_bytes += len(out)
        return out


def test_packages_of_others(monkeypatch):
    """Plain and gzipped archives without an index, a comment, other members, ZIP64 from the library; what can't be read is refused."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    one = [warczip.record(k, None, b"<p>" * k, None, "2020-01-01T00:00:00Z") for k in range(40)]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    raw = Ranges()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("pages/pages.jsonl", "x" * 500_000)
        z.writestr("archive/a.warc", info + b"".join(one[:20]))
        z.writestr("archive/b.warc.gz", b"".join(gzip.compress(x) for x in one[20:]))
        z.writestr("notes.txt", "deflated", zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5\6 in a comment that looks like an end" + b"." * 30
    package = warczip.Package(raw)
    assert package.archives() == ["archive/a.warc", "archive/b.warc.gz"]
    read = [r for where in package.ranges() for r in package.records(*where)]
    assert [(r.page_id, r.payload) for r in read] == [(k, b"<p>" * k) for k in range(40)]
    assert raw.read_bytes < 100_000
    with pytest.raises(ValueError, match="stored"):
        package.data("notes.txt")
    with pytest.raises(ValueError, match="no ZIP directory"):
        warczip.Package(io.BytesIO(b"PK not a package"))
    with pytest.raises(ValueError, match="digest"):
        warczip.parse(one[5].replace(b"<p>", b"<q>", 1))
    broken = io.BytesIO()
    with zipfile.ZipFile(broken, "w") as z:
        z.writestr("archive/a.warc", one[3][:-10])
    with pytest.raises(ValueError, match="too early"):
        list(warczip.Package(broken).records(*next(warczip.Package(broken).ranges())))


def test_query_equals_sql(spark, table):
    con = duckdb.connect()
    for path, pattern in ((table, "/*.parquet"), ("/root/testdata/sf0.01", "")):
        con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{path}/pages.parquet{pattern}'")
        got, want = warczip.op12_warc(spark, path), con.execute(warczip.OP12_SQL)
        assert got.columns == [c[0] for c in want.description]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_empty_table(spark):
    manifest = warczip.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert manifest.collect() == [] and warczip.read_archives(manifest).collect() == []


def test_digests_are_those_of_the_payload():
    assert warczip.payload_digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest() == "da39a3ee5e6b4b0d3255bfef95601890afd80709"
