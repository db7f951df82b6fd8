"""Operators against brute force on small fixtures with nulls, empty and repeated texts, and copies."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from folio.llm import chat, decontam, jaccard, langid, mixing, sharding, suffixes, tokens, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(300)]
    out = []
    for i in range(120):
        text = " ".join(r.choices(words, k=r.randint(1, 120)))
        if i % 5 == 4:
            w = out[i - 3][1].split()
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        if i % 7 == 6:
            text = out[i - 2][1]
        out.append((i, text, "en", f"s{i % 4}", len(text), 1))
    return [*out, (200, None, None, None, None, None), (201, "", "en", None, 0, 1), (202, "  \n", "en", "s1", 3, 1), (203, "Éa b", "en", "s1", 4, 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (300, 8))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [None] * 8)], "vec_id long, vector array<long>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(table, table.where("vec_id % 50 = 0"), 5).collect()}
    want = {}
    for q in range(0, 300, 50):
        best = sorted((-int(v[q] @ v[i]), i) for i in range(300) if i != q)[:5]
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(best, 1)}
    assert got == want
    assert topk.top_k(table.limit(0), table.limit(0)).count() == 0


def test_mix_takes_targets(docs, none):
    found = [r.asDict() for r in mixing.mix(docs, block=50)[0].collect()]
    assert len(found) == docs.count()
    by = {}
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-6
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - k) <= 1 for t, k in by.values())
    assert sum(t for t, _ in by.values()) == pytest.approx(sum(r["size"] for r in found))
    assert mixing.mix(none)[0].count() == 0


def test_token_shards_read_back(spark, rows, docs, none):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    manifest = tokens.write_shards(docs, path, shard_bytes=4000)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_shards(manifest, manifest.count()).collect()}
    encode, at, want = tokens.PieceEncoder(path).tokenizer, 0, {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = [*encode.encode(text or "", add_special_tokens=False).ids, 0]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want
    assert tokens.write_shards(none, path).count() == 0


def test_added_tokens_are_encoded_as_by_the_file():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    end, fresh = "<|endoftext|>", Tokenizer.from_file(path)
    texts = ["plain words, here", f"a {end} b", "", f"{end}{end}", "ends in <|endo", "ftext|> begins", "<|endoftext |>", f"é {end}\n{end}\n\n x. y", "a <|endoftext|", f"x{end}y"]
    for some in (texts, texts[1:4], texts[:1], ["", f"{end}"], [""]):
        raw = [t.encode() for t in some]
        flat, counts = tokens.PieceEncoder(path).encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])))
        want = [fresh.encode(t, add_special_tokens=False).ids for t in some]
        assert counts.tolist() == [len(x) for x in want] and flat.tolist() == sum(want, [])


def test_suffix_order():
    parts = [b"banana", b"ananas", b"aab", b"bananb", b"aab"]
    ends = np.cumsum([len(p) for p in parts])
    seq, size = suffixes.transform_order(np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends)
    found = [parts[s][len(parts[s]) - n :] for s, n in zip(seq, size)]
    assert found == sorted(found) and len(found) == sum(len(p) + 1 for p in parts)


def test_repeats_are_removed(rows, docs, none):
    got = {r.doc_id: (r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.remove_repeats(docs).collect()}
    seen, want = set(), {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        strings = [b[k : k + 50] for k in range(len(b) - 49)]
        hit = {j for k, s in enumerate(strings) if s in seen for j in range(k, k + 50)}
        seen |= set(strings)
        want[i] = (len(hit), sum(j - 1 not in hit for j in hit), hashlib.sha256(bytes(c for j, c in enumerate(b) if j not in hit)).hexdigest())
    assert got == want
    assert suffixes.remove_repeats(none).count() == 0


def test_jaccard_components(rows, docs, none):
    sets = {}
    for i, text, *_ in rows:
        w = words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1 if w else 0))}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        break
    for _ in range(10):
        root = {i: root[r] for i, r in root.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(docs).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}
    assert jaccard.similar(none).count() == 0


def test_contaminated_finds_passages(spark, rows, docs, none):
    item = " ".join((rows[3][1] + " " + rows[8][1]).split()[:30])
    bench = spark.createDataFrame([(1, item.upper()), (2, "quite other words that no document has here"), (3, None)], "item_id long, text string")
    leaked = docs.unionByName(spark.createDataFrame([(300, f"before {item} after and more", "en", "s0", 1, 1)], SCHEMA))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(leaked, bench).collect()}
    assert got[(300, 1)] == 1.0 and all(i == 1 for _, i in got)
    assert decontam.contaminated(none, bench).count() == 0


def most_similar(texts, items, similarity=0.75):
    """Brute force over all windows: (text, item) -> (start, similarity) of the first most similar one."""
    out = {}
    for j, item in items.items():
        w = words(item)
        n = min(len(w), 5)
        cut = lambda v: Counter(tuple(v[k : k + n]) for k in range(len(v) - n + 1))
        want = cut(w)
        for i, text in texts.items():
            v = words(text)
            for start in range(len(v) - n + 1):
                own = cut(v[start : start + len(w)])
                common = (own & want).total()
                s = common / (own.total() + want.total() - common)
                if s >= similarity and s > out.get((i, j), (0, 0))[1]:
                    out[i, j] = (start, s)
    return out


def test_contaminated_equals_all_windows(spark):
    r = random.Random(11)
    word = lambda k: [f"{r.choice('abcdef')}{r.randrange(500)}" for _ in range(k)]
    items = {1: word(100), 2: word(60), 3: word(30), 4: ["p1", "p2", "p3"], 5: (word(6) * 6)[:34], 6: word(50)}
    texts = {1: word(80) + items[1][50:] + items[1][:50] + word(80)}  # its halves stand swapped
    texts[2] = word(30) + items[2][20:40] + items[2][40:] + items[2][:20] + word(9)  # its thirds turned
    texts[3] = ["first", *items[3][1:]] + word(40)  # an edit at the document's start
    texts[4] = word(20) + items[3][:-1]  # cut by the document's end
    texts[5] = items[2][5:57]  # shorter than the item
    texts[6] = word(7) + items[4] + word(3) + items[4]
    texts[7] = word(12) + items[5] + items[5] + word(12)  # repeated shingles
    for i in range(8, 60):  # moved and edited passages, alike or not
        w = list(items[r.choice([1, 2, 3, 5, 6])])
        at = r.randrange(len(w))
        w = w[at:] + w[:at] if i % 2 else w
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = "edited"
        if i % 3 == 0:
            w.insert(r.randrange(len(w)), "added")
        texts[i] = word(r.randrange(40)) + w + word(r.randrange(40))
    texts, items = ({k: " ".join(v) for k, v in x.items()} for x in (texts, items))
    table = lambda x, key: spark.createDataFrame(list(x.items()), f"{key} long, text string")
    want = most_similar(texts, items)
    got = {(x.doc_id, x.item_id): (x.start, x.similarity) for x in decontam.contaminated(table(texts, "doc_id"), table(items, "item_id")).collect()}
    assert {(i, j) for i, j in want} >= {(1, 1), (2, 2), (3, 3), (4, 3), (5, 2), (6, 4), (7, 5)}
    assert got == want


def test_contaminated_with_null_and_equal_ids(spark, monkeypatch):
    word = lambda c: " ".join(f"{c}{k}" for k in range(12))
    bench = spark.createDataFrame([(1, word("a")), (1, word("b")), (None, word("c"))], "item_id long, text string")
    docs = spark.createDataFrame([(10, f"x {word('a')}"), (11, word("b")), (None, f"y {word('b')} z"), (12, word("c"))], "doc_id long, text string")
    for small in (decontam.SMALL, 0):
        monkeypatch.setattr(decontam, "SMALL", small)
        got = {(r.doc_id, r.item_id, r.start, r.similarity) for r in decontam.contaminated(docs, bench).collect()}
        assert got == {(10, 1, 1, 1.0), (11, 1, 0, 1.0), (None, 1, 1, 1.0), (12, None, 0, 1.0)}


def test_shards_are_even_and_keep_copies_together(docs, none):
    found = sharding.kd_shards(docs, 4).collect()
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r)
    sizes = [sum(r["size"] for r in g) for g in by.values()]
    assert len(found) == docs.count() and max(sizes) - min(sizes) < 0.2 * sum(sizes) / 4
    assert all(sorted(r.slot for r in g) == list(range(len(g))) for g in by.values())
    assert sharding.kd_shards(none).count() == 0


def test_language_of_clear_texts(spark, none):
    train = spark.createDataFrame([("the and that with thing", "en"), ("der und das mit nicht", "de")] * 5 + [(None, "en"), ("x", None)], "text string, lang string")
    ask = spark.createDataFrame([(1, "the thing that"), (2, "das und nicht"), (3, "123"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(ask, langid.fit(train)).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4)] == ["en", "de", "und", "und"] and all(0 <= s <= 1 for _, s in got.values())
    assert langid.predict(none, langid.fit(train.limit(0))).count() == 0


def test_chat_round_trip_and_rewrites():
    turns = [("user", "</s>[INST] ok [/INST]"), ("assistant", "a\\<b[ </s>"), ("to]ol", ""), ("assistant", " x ")]
    formatted, found, rewrites = chat.spans(turns, chat.inst_template)
    assert rewrites == -1 and chat.read_back(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in found] == [t for _, t in turns]
    forgetful = lambda t: "|".join(x for _, x in t[-2:])
    assert chat.spans(turns, forgetful)[2] >= 0


def test_toxicity_learns_words(spark, none):
    clean, bad = "word other thing", "word vequzz thing"
    r = random.Random(1)
    rows = [(f"{bad if k % 4 == 0 else clean} {r.random()}", int(k % 4 == 0)) for k in range(200)]
    model = toxicity.fit(spark.createDataFrame([*rows, (None, 0), ("x", None)], "text string, toxic int"))
    ask = spark.createDataFrame([(1, "a vequzz b"), (2, "quiet words"), (3, None)], "doc_id long, text string")
    got = {x.doc_id: x.score for x in toxicity.score(ask, model).collect()}
    assert got[1] >= 0.3 > max(got[2], got[3]) and toxicity.below(ask, model).count() == 2
    assert toxicity.score(none, model).count() == 0
