"""Edge cases of the training-data operators: null and repeated ids, whole rows repeated, very long texts, ties, clashing
column names, and inputs that simpler hashes and counters get wrong."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import bytehash, chat, common, components, decontam, jaccard, langid, mixing, sharding, suffixes, tokens, topk, toxicity

#: Columns that the operators name themselves.
CLASH = ("row", "key", "size", "shard", "pos", "_bucket", "doc", "raw", "n", "node", "group", "rid", "h", "slot", "taken", "block", "start", "digest", "_n", "_row")


def thue_morse(n):
    x = b"a"
    while len(x) < n:
        x += x.translate(bytes.maketrans(b"ab", b"ba"))
    return x.decode()


@pytest.fixture(scope="module")
def odd(spark):
    """Null, repeated and clashing: every operator has to take this."""
    r = random.Random(5)
    word = lambda k: " ".join(f"{r.choice('abcdefgh')}{r.randrange(200)}" for _ in range(k))
    long = word(30_000)
    rows = [(i, word(r.randrange(1, 60)), "en", f"s{i % 3}") for i in range(20)]
    rows += [(3, "another text with the id of a row before it", "de", None), (None, rows[4][1], None, "s1"), (None, None, None, None), (None, "", "en", "s2"), rows[5], rows[5], (30, long, "en", "s0"), (31, long + " end", "en", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)]), rows


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1 if w else 0))}


def by_links(sets):
    """Components of sets that are 0.75 alike, by union-find over all pairs."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(len(sets))]


def test_hashes_of_thue_morse_words_differ():
    x = thue_morse(2048)
    y = x.translate(str.maketrans("ab", "ba"))
    sums = bytehash.prefixes(np.frombuffer((x + y).encode(), np.uint8))
    one, two = bytehash.pieces(sums, np.array([0, 2048]), np.array([2048, 4096]))
    assert one != two
    again = bytehash.prefixes(np.frombuffer(("zz" + y).encode(), np.uint8))
    assert bytehash.pieces(again, np.array([2]), np.array([2050]))[0] == two


def test_jaccard_tells_thue_morse_words_apart(spark):
    x = thue_morse(2048)
    texts = [x, x.translate(str.maketrans("ab", "ba")), x]
    got = {r.doc_id: r.component_id for r in jaccard.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_jaccard_of_chains_copies_and_shared_passages(spark):
    r = random.Random(2)
    word = lambda k: [f"w{r.randrange(10**6)}" for _ in range(k)]
    texts = []
    chain = word(60)
    for _ in range(25):  # each like the one before it, the ends not alike
        chain = chain[3:] + word(3)
        texts.append(chain)
    passage = word(30)
    texts += [passage + word(r.randrange(4, 40)) for _ in range(40)]  # one passage in many, alike or not
    base = word(80)
    for _ in range(40):  # a cluster of near copies
        w = list(base)
        for _ in range(r.randrange(3)):
            w[r.randrange(80)] = word(1)[0]
        texts.append(w)
    texts += [word(k) for k in (1, 2, 4, 5, 6)] + [["same"], ["same"], ["SAME"]]
    texts = [" ".join(t) for t in texts] + [None, "", " \n"]
    order = list(range(len(texts)))
    r.shuffle(order)
    texts = [texts[k] for k in order]
    sets = [shingles(t) for t in texts]
    want = dict(enumerate(by_links(sets)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.similar(df.repartition(5)).collect()}
    assert got == {k: (len(sets[k]), want[k]) for k in want}


@pytest.mark.parametrize("meet", [1024, 3])
def test_jaccard_by_the_matrix_alone(spark, monkeypatch, meet):
    """Without the first grouping all links are found by the token-group matrix, also where ids are shuffled, and where a
    shingle's nodes meet by blocks."""
    r = random.Random(4)
    word = lambda k: [f"w{r.randrange(10**6)}" for _ in range(k)]
    texts = []
    for _ in range(12):
        base = word(r.randrange(5, 90))
        for _ in range(4):
            w = list(base)
            for _ in range(r.randrange(1 + len(w) // 25)):
                w[r.randrange(len(w))] = word(1)[0]
            texts.append(" ".join(w))
    base = word(70)
    for _ in range(25):
        w = list(base)
        w[r.randrange(70)] = word(1)[0]
        texts.append(" ".join(w))
    monkeypatch.setattr(jaccard, "MEET", meet)
    monkeypatch.setattr(jaccard, "groups", lambda nodes, sets: sets.sparkSession.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(jaccard, "FEW", 0)
    want = by_links([shingles(t) for t in texts])
    got = {x.doc_id: x.component_id for x in jaccard.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(want))


def test_lookup_deals_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 10)
    left = spark.range(200).select(F.when(F.col("id") < 150, 1).otherwise(F.col("id")).alias("k"), "id")
    right = spark.createDataFrame([(1, "hot"), (160, "one"), (500, "none")], "k long, name string")
    got = common.lookup(left, right, "k").groupBy("name").count().collect()
    assert {r["name"]: r["count"] for r in got} == {"hot": 150, "one": 1}


def test_components_of_a_star_and_a_path(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 10)
    edges = [(500, k) for k in range(100, 160)] + [(k, k + 1) for k in range(20)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in [*range(100, 160), 500]} | {k: 0 for k in range(21)}


def test_top_k_of_empty_and_large_vectors(spark):
    empty = spark.createDataFrame([(0, []), (1, []), (2, [3])], "vec_id long, vector array<long>")
    got = {(r.query_id, r.vec_id, r.score) for r in topk.top_k(empty, empty, 5).collect()}
    assert got == {(0, 1, 0), (1, 0, 0)}
    for size in (64 * 10**6, 2**40):
        rows = [(k, [size + k, -size + 3 * k]) for k in range(40)]
        df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
        got = [(r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 7"), 5).orderBy("rank").collect()]
        score = lambda k: rows[7][1][0] * rows[k][1][0] + rows[7][1][1] * rows[k][1][1]
        top = 2**63 - 1
        assert got == [(k, min(score(k), top)) for k in sorted((k for k in range(40) if k != 7), key=lambda k: (-min(score(k), top), k))[:5]]


def test_rank_in_constant_time_equals_counting():
    bits = (np.random.default_rng(0).random(5000) < 0.3).astype(np.uint8)
    level = tokens.Level.of(bits)
    place = np.arange(5000)
    assert (level.rank(place) == np.cumsum(bits) - bits).all() and (level.has(place) == (bits == 1)).all() and level.total() == bits.sum()
    keys = np.random.default_rng(1).integers(0, 2**63, 3000, dtype=np.uint64)
    levels = [tokens.Level.of(b) for b in tokens.build_index(keys)]
    assert sorted(tokens.slots(levels, keys).tolist()) == list(range(3000))


def test_tokens_of_odd_rows(odd):
    df, rows = odd
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    manifest = tokens.write_shards(df, path, shard_bytes=50_000)
    got = tokens.read_shards(manifest, manifest.count()).collect()
    assert len(got) == len(rows) and sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((r[0] is not None, r[0] or 0) for r in rows)
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0


def test_removal_of_odd_rows(odd):
    df, rows = odd
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(df).collect()]
    by_id = {k: [x for x in got if x[0] == k] for k in (3, 5, 30, 31, None)}
    assert len(got) == len(rows) and len(by_id[5]) == 3 and len(by_id[None]) == 3
    assert all(n == 0 for _, _, n in by_id[30] + by_id[5])  # rows of one doc_id are one document
    assert by_id[31][0][2] == by_id[30][0][1]  # all but " end"
    copy = max(by_id[None], key=lambda x: x[1])
    assert copy[2] == (copy[1] if copy[1] >= 50 else 0)


def test_jaccard_of_odd_rows(odd):
    df, rows = odd
    got = jaccard.similar(df).collect()
    sets = [shingles(r[1]) for r in rows]
    root = by_links(sets)
    ids = {}
    for k, r in enumerate(rows):
        if sets[k] and r[0] is not None:
            ids[root[k]] = min(ids.get(root[k], r[0]), r[0])
    want = [(r[0], len(sets[k]), ids.get(root[k]) if sets[k] else r[0]) for k, r in enumerate(rows)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got)


def test_mix_of_odd_rows(odd):
    df, rows = odd
    found = mixing.mix(df, block=100)[0].collect()
    assert len(found) == len(rows)
    taken = {}
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        t = taken.setdefault(r.source, [r.target, 0])
        t[1] += r.taken
    assert all(abs(a - b) <= 1 for a, b in taken.values())


def test_shards_of_odd_rows(odd):
    df, rows = odd
    found = sharding.kd_shards(df, 3).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_language_toxicity_and_contamination_of_odd_rows(spark, odd):
    df, rows = odd
    model = langid.fit(df.select("text", "lang"))
    found = langid.predict(df, model).collect()
    assert len(found) == len(rows) and sum(r.lang_pred == "und" for r in found) == 2
    assert langid.fit(df.limit(0).select("text", "lang"))[0] == []
    tox = toxicity.fit(df.withColumn("toxic", F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)).select("text", "toxic"))
    assert len(toxicity.score(df, tox).collect()) == len(rows) and toxicity.below(df, tox).columns == df.columns
    item = " ".join(rows[26][1].split()[100:140])
    bench = spark.createDataFrame([(1, item, 5)], "item_id long, text string, start int")
    assert {(r.doc_id, r.start, r.similarity) for r in decontam.contaminated(df, bench).collect()} == {(30, 100, 1.0), (31, 100, 1.0)}


def test_a_long_item_that_repeats_a_shingle(spark):
    text = "one two three four five " * 14_000  # a shingle 14,000 times, 70,000 words
    words = " ".join(f"w{k}" for k in range(200))
    bench = spark.createDataFrame([(1, "so it is " * 30), (2, words)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (2, f"a {words} b")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()] == [(2, 2)]
    same = spark.createDataFrame([(9, "so " * 40_000)], "item_id long, text string")  # more than 16 bits count
    assert [r.similarity for r in decontam.contaminated(spark.createDataFrame([(1, "so " * 40_000)], "doc_id long, text string").limit(0), same).collect()] == []
    fingerprint = same.select(F.explode(decontam.shingles_of(decontam.words_of(F.col("text")), 5)).alias("s")).agg(F.count(F.lit(1)).alias("n"), *decontam._fingerprint(F.col("s")))
    assert fingerprint.select(decontam._bits(F.col("n")).alias("b")).first()["b"] == same.select(decontam.shingles_of(decontam.words_of(F.col("text")), 5)[0].alias("s")).first()["s"]


def test_toxicity_reads_long_texts_by_pieces_and_patterns(monkeypatch):
    monkeypatch.setattr(toxicity, "STEP", 50)
    text = "word " * 40 + "vequzz " + "other " * 30 + "you are such an idiot " + "end " * 20
    pieces = list(toxicity.portions([text, "", "short"]))
    assert "".join(p for some, of in pieces for p, k in zip(some, of) if k == 0) == text
    features = {int(f) for some, _ in pieces for f in toxicity.text_features(some)[0]}
    assert toxicity.word_hash("vequzz") in features
    monkeypatch.setattr(toxicity, "STEP", 1 << 20)
    assert int(toxicity.pattern_hash(0)) in {int(f) for f in toxicity.text_features([text])[0]}
    assert int(toxicity.pattern_hash(0)) not in {int(f) for f in toxicity.text_features(["are you an engineer"])[0]}


def test_label_model_finds_a_voter_that_guesses():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.2
    good = [np.where(rng.random(4000) < 0.95, truth, ~truth) for _ in range(3)]
    votes = np.stack([np.where(g, 1, -1) for g in good] + [np.where(rng.random(4000) < 0.5, 1, -1)], 1)
    model = toxicity.fit_label_model(votes)
    p = model.posterior(votes)
    assert ((p > 0.5) == truth).mean() > 0.97
    assert min(model.accuracies()[:3]) > 0.85 > 0.65 > model.accuracies()[3]


def test_conversations_with_nulls_repeats_and_none(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, None, None, "x"), (2, 3, "assistant", "b"), (2, 2, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("spans", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.render(df)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (3, 0), None: (1, 0), 2: (2, 2)}
    assert chat.digests(chat.render(df.limit(0))).count() == 0
