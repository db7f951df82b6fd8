"""The two-phase file sink, the stream of jobs against a service of our own, trees by VARIANT, stitched captions."""

import hashlib
import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folio.operators import figures
from folio.sinks import files, placed
from folio.sinks.shared import shared_folder
from folio.sources import variant_trees as V
from folio.sources.pages_tree import nodes, read_documents
from folio.streaming import service

# ---- files


def listed(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file() and not p.name.startswith(("_", ".")))


def test_files_are_placed_once_with_names_apart(spark, tmp_path):
    rows = [("a/x.png", b"1"), ("a/x.png", b"1"), ("a/x.png", b"2"), ("b", b""), ("b", None), ("c.tar/d", b"3"), ("c.tar/d", b"4"), ("é ü%20.txt", "漢".encode())]
    at = str(tmp_path / "out")
    placed.place(spark.createDataFrame(rows, "name string, content binary").repartition(3), at)
    first, second = sorted((b"1", b"2"), key=lambda b: hashlib.sha256(b).hexdigest())
    three, four = sorted((b"3", b"4"), key=lambda b: hashlib.sha256(b).hexdigest())
    got = {r.name: bytes(r.content) for r in placed.read_placed(spark, at).collect()}
    assert {"b", "b_1"} <= set(listed(at)) and (tmp_path / "out/b").read_bytes() == b""
    assert got == {"a/x.png": first, "a/x_1.png": second, "c.tar/d": three, "c.tar/d_1": four, "é ü%20.txt": "漢".encode()}
    assert json.loads((tmp_path / "out/_SUCCESS").read_text())["files"] == 7 and not (tmp_path / "out/_temporary").exists()


def _late(path, good, bad):
    """Rows of which a task fails after it has written some."""

    def run(batches):
        for batch in batches:
            yield batch
            if bad in batch["name"].tolist():
                raise RuntimeError("a task that fails")

    return run


@pytest.mark.parametrize("name", ["../up", "/root", "a/../b", "a//b", "", ".", "_temporary/x", "_SUCCESS", "a/./b"])
def test_names_lead_downwards(spark, tmp_path, name):
    at = str(tmp_path / "out")
    with pytest.raises(Exception, match="isn't a name below"):
        placed.place(spark.createDataFrame([(name, b"1"), ("fine", b"2")], "name string, content binary").coalesce(1), at)
    assert listed(at) == [] and not (tmp_path / "up").exists()


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    """Some tasks have placed their files when another one fails: all is taken back, and files of before stay."""
    at = str(tmp_path / "out")
    placed.place(spark.createDataFrame([("old", b"0")], "name string, content binary"), at)
    df = spark.createDataFrame([(f"n{k}", b"x") for k in range(40)] + [("bad", b"x")], "name string, content binary").repartition(4)
    slow = df.mapInPandas(_late(at, "n", "bad"), "name string, content binary")
    spark.dataSource.register(placed.PlacedFiles)
    with pytest.raises(Exception, match="a task that fails"):
        slow.write.format("placed_files").mode("append").save(at)
    assert listed(at) == ["old"] and not (tmp_path / "out/_temporary").exists()


def test_overwriting_is_refused(spark, tmp_path):
    spark.dataSource.register(placed.PlacedFiles)
    with pytest.raises(Exception, match="adds to a folder"):
        spark.createDataFrame([("a", b"1")], "name string, content binary").write.format("placed_files").mode("overwrite").save(str(tmp_path / "out"))


def test_a_writer_takes_back_what_it_moved(tmp_path):
    """An attempt that dies between two moves leaves a note, by which the job's end removes what was moved."""
    writer = placed.FileWriter(f"file://{tmp_path}/out")
    where, own = writer._at(f"{writer.pending}/7-8")
    where.create_dir(own, recursive=True)
    Path(own, "1").write_bytes(b"left")  # the second name hasn't been placed by this attempt
    Path(tmp_path, "out/not yet").write_bytes(b"of before")
    Path(f"{own}.placed").write_text("moved\nnot yet")
    Path(tmp_path, "out/moved").write_bytes(b"1")
    Path(tmp_path, "out/other").write_bytes(b"2")
    writer.abort([placed.Placed("7-8", 2, 2), None])
    assert listed(tmp_path / "out") == ["not yet", "other"] and not (tmp_path / "out/_temporary").exists()


def test_folders_are_claimed_by_one(spark, tmp_path):
    found, at = [], str(tmp_path / "run")
    threads = [threading.Thread(target=lambda: found.append(files.claimed_path(spark, at))) for _ in range(6)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(found) == [at] + [f"{at}_{k}" for k in range(1, 6)]


def test_folders_of_the_user_are_refused(spark, tmp_path):
    for path in ("/", str(Path.home()), str(Path.cwd()), str(Path.cwd().parent), f"{tmp_path}/.git/x"):
        with pytest.raises(ValueError, match="isn't a folder"):
            files.claimed_path(spark, path)
    (tmp_path / "link").symlink_to(tmp_path / "nowhere")
    assert files.claimed_path(spark, str(tmp_path / "link")) == f"{tmp_path}/link_1"


# ---- jobs


class FakeService:
    """Answers over HTTP: each job's states in order, the last one again and again; every tenth call fails."""

    def __init__(self, states):
        self.states, self.checks, self.sent, self.most, self.calls = states, Counter(), Counter(), 0, 0
        self.open, self.lock = set(), threading.Lock()
        fake = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                status, out = fake.answer(self.path, body)
                data = json.dumps(out).encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def answer(self, path, body):
        with self.lock:
            self.calls += 1
            token = body["token"]
            if self.calls % 10 == 0:
                return 503, {}
            if path == service.SUBMIT:
                self.sent[token] += 1
                if token == "refused":
                    return 400, {}
                self.open.add(token)
                self.most = max(self.most, len(self.open))
                return 200, {"status": "waiting"}
            if body.get("pages_tree"):
                return 200, {"status": "success", "pages_tree": [[{"text": token}]]}
            states = self.states[token]
            state = states[min(self.checks[token], len(states) - 1)]
            self.checks[token] += 1
            if state in ("success", "error"):
                self.open.discard(token)
            return 200, {"status": state}


@pytest.fixture(scope="module")
def scripts():
    """Each user's events as a job's states, with an end for all."""
    names = {"signup": "undefined", "view": "waiting", "click": "processing", "purchase": "success", "error": "error"}
    e = pd.read_parquet("/root/testdata/sf0.001/events.parquet").sort_values(["ts", "event_id"])
    return {str(k): [names[x] for x in g.event_type][:6] + ["success"] for k, g in e.groupby("user_id")}


def plain(states):
    lost = 0
    for k, s in enumerate(states):
        lost = lost + 1 if s == "undefined" else 0
        if s in ("success", "error") or lost == 3:
            return ("not_found" if lost == 3 else s), k + 1
    raise AssertionError


def written(spark, name, tokens):
    at = shared_folder(spark, name)
    service.requests(spark.createDataFrame([(t, f"http://x/{t}") for t in tokens], "token string, url string").repartition(3), f"{at}/requests")
    return at


def collected(spark, at, stop_after=None, **options):
    """Run the stream until nothing is left, or until a batch has come; rows by batch."""
    seen = []

    def keep(df, batch):
        seen.append((batch, df.collect()))
        if stop_after is not None and batch >= stop_after:
            raise RuntimeError("the query dies after its rows were written")

    stream = service.jobs(spark, requests=f"{at}/requests", interval="0", **options)
    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").start()
    try:
        query.processAllAvailable()
    except Exception:
        assert stop_after is not None
    finally:
        query.stop()
    return seen


def test_jobs_over_http_with_a_restart(spark, scripts):
    fake = FakeService(scripts)
    at = written(spark, "http", [*scripts, "refused"])
    options = {"service": "http", "url": fake.url, "batch": "4", "fetch": "true", "wait": "2"}
    first = collected(spark, at, stop_after=1, **options)
    again = collected(spark, at, **options)
    # the batch that died comes again with the same rows; no other job comes twice, none is lost
    died = max(b for b, _ in first)
    assert {b: sorted(r.token for r in rows) for b, rows in first}[died] == {b: sorted(r.token for r in rows) for b, rows in again}[died]
    rows = [r for b, batch in first if b != died for r in batch] + [r for _, batch in again for r in batch]
    assert sorted(r.token for r in rows) == sorted([*scripts, "refused"])
    got = {r.token: r for r in rows}
    assert (got["refused"].outcome, got["refused"].checks, got["refused"].result) == ("error", 0, None)
    for token, states in scripts.items():
        outcome, checks = plain(states)
        assert (got[token].outcome, got[token].checks) == (outcome, checks)
        assert (got[token].result is not None) == (outcome == "success")
        if outcome == "success":
            assert json.loads(got[token].result)["pages_tree"][0][0]["text"] == token
    assert all(fake.sent[t] == 1 for t in scripts)


def test_at_most_so_many_are_open(spark, scripts):
    fake = FakeService({t: ["waiting"] * 3 + ["success"] for t in scripts})
    at = written(spark, "open", scripts)
    assert sum(len(rows) for _, rows in collected(spark, at, service="http", url=fake.url, open="3", wait="5")) == len(scripts)
    assert fake.most == 3


def test_deadlines_and_services_that_are_away(spark):
    fake = FakeService({"a": ["waiting"], "b": ["odd"], "c": [None]})
    at = written(spark, "late", ["a", "b", "c"])
    got = {r.token: r.outcome for _, rows in collected(spark, at, service="http", url=fake.url, deadline="0.5", wait="3") for r in rows}
    assert got == {"a": "timeout", "b": "unknown_state", "c": "unknown_state"}
    at = written(spark, "away", ["a"])
    got = [(r.token, r.outcome, r.checks) for _, rows in collected(spark, at, service="http", url="http://127.0.0.1:9", wait="3") for r in rows]
    assert got == [("a", "failed", 0)]


def test_request_lines_are_read_from_any_place(tmp_path):
    lines = [json.dumps({"token": str(k), "request": {"url": "x" * (k * 977 % 90_000)}}) for k in range(30)]
    (tmp_path / "part-0").write_text("\n".join(lines[:20]) + "\n")
    (tmp_path / "part-1").write_text("")
    (tmp_path / "part-2").write_text("\n".join(lines[20:]))
    place, got = ["", 0], []
    while True:
        line, place = service.Lines(f"file://{tmp_path}").next(place)
        if line is None:
            break
        got.append(json.dumps(line))
    assert got == lines


# ---- trees


def rows_of(df):
    return sorted((r.token, r.page, tuple(r.path) if not isinstance(r.path, str) else tuple(map(int, r.path.split("/"))), r.depth, r.block, r.type, r.kind, r.ord, r.subtree, r.x1, r.y1, r.x2, r.y2, r.text) for r in df.collect())


ODD = {
    "a": [[{"text": "x", "bbox": [0, 1, 2, 3], "block": 4, "type": "title"}, {"items": [{"text": 5}, {"items": [{"desc": "d"}, {"items": []}, {"items": None}]}, 7, None], "order": 2}], [], [{"type": "hline"}]],
    "b": {"status": "success", "pages_tree": [[{"text": "é漢", "bbox": {"x1": 1, "y1": 2.5, "x2": 3, "y2": 4}, "items": [{"text": "hidden"}]}]]},
    "c": [[{"data": None, "bbox": [1, 2, 3]}, {"latex_repr": "x^2", "order": 0}, {"markush": True, "smi": "CC", "caption": "m"}]],
    "d": [],
    "e": [[]],
}
WRONG = {"f": "{", "g": "{}", "h": "[1]", "i": '{"pages_tree":[[1]]}', "j": '{"pages_tree":null}', "k": "", "l": "[[null]]", "m": '"text"'}


def test_variants_equal_the_walk(spark, tmp_path):
    for k, v in ODD.items():
        (tmp_path / f"{k}.json").write_text(json.dumps(v))
    for k, v in WRONG.items():
        (tmp_path / f"{k}.json").write_text(v)
    raw = read_documents(spark, str(tmp_path))
    rows, errors = V.tree_rows(raw)
    walked = nodes(raw)
    assert rows_of(rows) == rows_of(walked.where("error is null"))
    assert {r.token: r.error for r in errors.collect()} == {r.token: r.error for r in walked.where("error is not null").select("token", "error").collect()}
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
    fields = {(r.token, tuple(r.path)): r.fields for r in rows.collect()}
    assert fields["c", (2,)].molecule.asDict() == {"smi": "CC", "markush": True, "caption": "m"} and fields["c", (0,)].chart is not None
    assert V.tree_rows(spark.createDataFrame([], "token string, raw string"))[0].count() == 0


def test_deep_trees(spark):
    """As deep as Spark parses JSON; a deeper one is an error of its own, not a cut."""
    deep = lambda k: "[[" + '{"items":[' * k + '{"text":"x"}' + "]}" * k + "]]"
    rows, errors = V.tree_rows(spark.createDataFrame([("a", deep(120)), ("b", deep(1000)), ("c", deep(0))], "token string, raw string"))
    got = {(r.token, r.depth): r.subtree for r in rows.collect()}
    assert got == {("a", k): 121 - k for k in range(121)} | {("c", 0): 1}
    assert [(r.token, r.error) for r in errors.collect()] == [("b", "not JSON")]


# ---- captions

NODES = "token string, page int, path array<int>, block int, type string, text string, x1 double, y1 double, x2 double, y2 double"
LEFT, RIGHT = (0.0, 0.0, 0.4, 1.0), (0.6, 0.0, 1.0, 1.0)


def stitched(spark, rows):
    df = spark.createDataFrame(rows, NODES)
    return df, figures.stitched(df, F.col("type") == "group")


def test_a_caption_goes_on_over_columns_and_pages(spark):
    rows = [
        ("t", 0, [0], 0, "group", None, *RIGHT), ("t", 0, [0, 0], 1, "image", None, *RIGHT), ("t", 0, [0, 1], 2, "imagecaption", "Figure 1 shows that", *RIGHT),
        ("t", 1, [0], 3, "paragraph", "it goes on", 0.5, 0.0, 0.98, 0.2), ("t", 1, [0, 0], 4, "legend", "below it", *RIGHT), ("t", 1, [1], 5, "imagefootnote", "in another column", *LEFT),
        ("t", 2, [0], 6, "paragraph", "and stays, since it is elsewhere", *LEFT), ("t", 2, [1], 7, "title", "New", *LEFT),
        ("u", 0, [0], 0, "group", None, *LEFT), ("u", 0, [1], 1, "paragraph", "the group says nothing yet", *RIGHT), ("u", 0, [2], 2, "paragraph", "same column", *LEFT),
        ("v", 0, [0], 0, "group", None, *LEFT), ("v", 0, [0, 0], 1, "imagecaption", "It ends here.", *LEFT), ("v", 0, [1], 2, "paragraph", "not taken", *RIGHT),
        ("w", 0, [0], 0, "group", None, *LEFT), ("w", 0, [0, 0], 1, "imagecaption", "it goes on", *LEFT), ("w", 0, [1], 2, "paragraph", "Begins anew", *RIGHT),
        ("x", 0, [0], 0, "group", None, *LEFT), ("x", 2, [0], 1, "paragraph", "a page lies between", *LEFT),
        ("y", 0, [0], 0, "group", None, *LEFT), ("y", 1, [0], 1, "paragraph", "one", *LEFT), ("y", 2, [0], 2, "paragraph", "two", *LEFT), ("y", 3, [0], 3, "paragraph", "three.", *LEFT), ("y", 4, [0], 4, "paragraph", "no more", *LEFT),
        ("z", 0, [0], 0, "paragraph", "no group before", *LEFT), ("z", 0, [1], 1, "paragraph", "at all", *RIGHT),
    ]
    df, chains = stitched(spark, rows)
    got = {r.token: ([(q.page, q.block) for q in r.taken], r.x1, r.x2) for r in chains.collect()}
    assert got == {"t": ([(1, 3), (1, 5)], 0.5, 1.0), "u": ([(0, 1)], 0.0, 0.4), "y": ([(1, 1), (2, 2), (3, 3)], 0.0, 0.4)}
    moved = {(r.token, r.block): (r.page, tuple(r.path), r.item_page, r.x1) for r in figures.with_stitched(df, chains).collect()}
    assert len(moved) == len(rows)
    assert moved["t", 3] == (0, (0, 2), 1, 0.5) and moved["t", 4] == (0, (0, 2, 0), 1, 0.6) and moved["t", 5] == (0, (0, 3), 1, 0.0) and moved["t", 0] == (0, (0,), 0, 0.5)
    assert moved["u", 1] == (0, (0, 0), 0, 0.6) and moved["v", 2] == (0, (1,), 0, 0.6) and moved["y", 3] == (0, (0, 2), 3, 0.0)


def test_stitched_groups_come_from_two_pages(spark):
    rows = [("t", 0, [0], 0, "group", None, *LEFT), ("t", 0, [0, 0], 1, "image", None, *LEFT), ("t", 1, [0], 2, "imagecaption", "figure 1 shows", *LEFT)]
    df, chains = stitched(spark, rows)
    keyword = F.when(F.size("captions") > 0, F.lit("Fig1"))
    before = figures.figure_groups(df, keyword, F.col("type") == "group").collect()[0]
    after = figures.figure_groups(figures.with_stitched(df, chains), keyword, F.col("type") == "group", F.col("item_page")).collect()[0]
    assert before.skipped == "no keyword" and (after.skipped, after.concat_type, after.caption) == (None, "cross_page", "figure 1 shows")
