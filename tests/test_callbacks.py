"""Callbacks: batch against a plain loop, the stream against the batch, and its state after the day is over."""

import hashlib
import hmac
import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folio.operators import viewer
from folio.streaming import callbacks

START = datetime(2024, 1, 1)
CALL = "key string, ts timestamp, attempt int, body binary"


def some_calls():
    r = random.Random(6)
    rows = [(f"k{r.randrange(6)}", START + timedelta(minutes=r.randrange(0, 8000)), r.choice([1, 2, 3, None]), bytearray(f"b{k}".encode())) for k in range(300)]
    return rows + [("hot", START + timedelta(minutes=k), k, bytearray(b"x")) for k in range(0, 4000, 20)] + [rows[0], (None, START, 1, bytearray(b"n")), ("k1", None, 1, bytearray(b"n"))]


def plain(calls):
    out, last = set(), {}
    order = lambda c: (c[0], c[1], 2**31 - 1 if c[2] is None else c[2], bytes(c[3]))
    for key, ts, attempt, body in sorted((c for c in calls if c[0] and c[1]), key=order):
        if key not in last or ts >= last[key] + timedelta(hours=24):
            last[key] = ts
            out.add((key, ts, attempt, bytes(body)))
    return out


def test_accepted_calls_equal_a_plain_loop(spark):
    calls = some_calls()
    got = callbacks.accepted(spark.createDataFrame(calls, CALL))
    assert {(r.key, r.ts, r.attempt, bytes(r.body)) for r in got.collect()} == plain(calls)
    assert callbacks.accepted(spark.createDataFrame([], CALL)).count() == 0


def test_signatures_are_of_the_raw_body(spark):
    sign = lambda b: "sha256=" + hmac.new(b"secret", b, hashlib.sha256).hexdigest()
    rows = [("a", START, 1, bytearray(b"{}"), sign(b"{}")), ("b", START, 1, bytearray(b"{ }"), sign(b"{}")), ("c", START, 1, bytearray(b"{}"), None)]
    got = callbacks.valid(spark.createDataFrame(rows, f"{CALL}, signature string"), "secret")
    assert [r.key for r in got.collect()] == ["a"] and got.columns == ["key", "ts", "attempt", "body"]


def test_the_stream_equals_the_batch_and_forgets(spark, tmp_path):
    calls = [c for c in some_calls() if c[0] and c[1]]
    r = random.Random(2)
    calls.sort(key=lambda c: c[1] + timedelta(minutes=r.randrange(0, 50)))  # out of order by less than the lateness
    end = START + timedelta(days=30)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", callbacks.STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        source = tmp_path / "calls"
        source.mkdir()
        lines = lambda rows: "\n".join(json.dumps({"key": k, "ts": t.isoformat(), "attempt": a, "text": bytes(b).decode()}) for k, t, a, b in rows)
        parts = [calls[k : k + 125] for k in range(0, len(calls), 125)] + [[("end", end, 1, b"e")], [("end", end + timedelta(days=2), 1, b"e")], [("end", end + timedelta(days=4), 1, b"e")]]
        stream = spark.readStream.schema("key string, ts timestamp, attempt int, text string").option("maxFilesPerTrigger", 1).json(str(source))
        out = callbacks.accepted_stream(stream.select("key", "ts", "attempt", F.encode("text", "utf-8").alias("body")))
        query = out.writeStream.format("memory").queryName("accepted").option("checkpointLocation", str(tmp_path / "at")).start()
        rows = []
        for k, part in enumerate(parts):
            (source / f"{k:03}.json").write_text(lines(part))
            query.processAllAvailable()
            rows.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = {(r.key, r.ts, r.attempt, bytes(r.body)) for r in spark.table("accepted").collect()}
    assert {g for g in got if g[0] != "end"} == plain(calls)
    # a row or two for each key while its day lasts, none after
    assert max(rows) >= 10 and rows[-1] <= 2


def test_viewers_are_escaped_and_one_file_each(spark):
    rows = [("a<b", 0, [0], "title", "1 < 2 & \"x\" </script>", 0.0, 0.0, 1.0, 0.5), ("a<b", 0, [0, 0], "image", None, 0.25, 0.25, 0.5, 0.5), ("a<b", 1, [0], "text", "é", 0.0, 0.0, 0.5, 0.5), ("c/d", 0, [0], "text", "", 0.0, 0.0, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "token string, page int, path array<int>, type string, text string, x1 double, y1 double, x2 double, y2 double")
    got = {r.name: bytes(r.content).decode() for r in viewer.viewers(df).collect()}
    assert set(got) == {"a<b/index.html", "c_d/index.html"}
    html = got["a<b/index.html"]
    assert html.count("<section") == 2 and "a&lt;b" in html and "1 &lt; 2 &amp; &quot;x&quot; &lt;/script&gt;" in html
    assert html.count("</script>") == 2 and html.index('width="1024"') < html.index('width="256"')
    data = json.loads(html.split('<script type="application/json">')[1].split("</script>")[0])
    assert [d["text"] for d in data] == ['1 < 2 & "x" </script>', None]
