"""The pipeline's stages against plain versions of what they decide."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm.test_edges import by_links, shingles  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    word = lambda k: [f"w{r.randrange(10**5)}" for _ in range(k)]
    item = word(40)
    out = []
    for i in range(60):
        w = word(r.randrange(20, 90))
        if i % 6 == 5:
            w = list(out[i - 3][1].split())
            w[3] = "edited"
        if i % 10 == 9:
            w = w[:10] + item + w[10:]
        out.append((i, " ".join(w), "en", f"s{i % 3}", 0))
    out += [(None, out[7][1], "en", "s1", 0), (None, " ".join(word(9) + item), "en", "s1", 0), (2, "another text that has the same id as one before it does", "en", "s2", 0), out[8], (70, None, None, None, None), (71, "", "en", "s0", 0)]
    return out, " ".join(item)


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows[0], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, rows[1]), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def values(df):
    return sorted(map(str, (tuple(r) for r in df.select(*pipeline.COLUMNS).collect())))


def test_one_row_of_each_group_stays(spark, rows, folder):
    docs = spark.createDataFrame(rows[0], SCHEMA)
    sets = [shingles(r[1]) for r in rows[0]]
    groups = {}
    for k, root in enumerate(by_links(sets)):
        groups.setdefault(root if sets[k] else ("alone", k), []).append(rows[0][k])
    got = values(pipeline.drop_near_copies(spark, docs, folder))
    first = lambda g: min(g, key=lambda r: (r[0] is None, r[0] or 0))
    want = sorted(str(tuple(first(g))) for g in groups.values())
    assert got == want


def test_contaminated_rows_go(spark, rows, folder):
    got = values(pipeline.drop_contaminated(spark, spark.createDataFrame(rows[0], SCHEMA), folder))
    assert got == sorted(str(tuple(r)) for r in rows[0] if rows[1] not in (r[1] or ""))


def test_mix_keeps_to_the_targets(spark, rows, folder):
    docs = spark.createDataFrame(rows[0], SCHEMA)
    out = pipeline.mix_sources(spark, docs, folder).collect()
    size = lambda r: len((r["text"] or "").split())
    want = {}
    for r in pipeline.mixing.mix(docs)[0].collect():
        want.setdefault(r.source, r.target)
    for source, target in want.items():
        own = [r for r in out if r.source == source]
        assert abs(sum(map(size, own)) - target) <= 0.5 * sum(map(size, {r.doc_id: r for r in own}.values())) + 90
    assert sum(not size(r) for r in out) == 2


def test_all_stages_together(spark, rows, folder):
    out = pipeline.run(spark, folder)
    found = out.collect()
    assert found and all(0 <= r.shard < 8 for r in found)
    clean = {r[0] for r in rows[0] if r[1] and rows[1] in r[1] and r[0] is not None}
    assert not clean & {r.doc_id for r in found}
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_a_stage_leaves_its_result_only(spark, folder, monkeypatch):
    """Rows alike but for their language: the smallest stands for all. Tables of a stage go when its result is written."""
    from folio.llm import common

    rows = [(1, "a b c d e f", lang, "s0", 11) for lang in ("en", "de", "fr")] + [(2, "one two three", "en", "s1", 13)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = pipeline.mix_sources(spark, docs, folder).collect()
    assert {(r.doc_id, r.lang) for r in got} <= {(1, "de"), (2, "en")}
    monkeypatch.setattr(pipeline, "STAGES", [("mixing", pipeline.mix_sources), ("sharding", pipeline.shard)])
    before = len(common.MADE)
    out = pipeline.run(spark, folder)
    assert out.count() > 0 and len(common.MADE) == before + 1
