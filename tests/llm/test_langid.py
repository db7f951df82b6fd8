"""Language profiles: against bundles laid out whole, by scripts beside Latin, and by held-out accuracy."""

import unicodedata
from collections import Counter

import numpy as np
import pandas as pd

from folio.llm import langid

DIMS = 256


def plain_vector(gram):
    """A trigram's vector by loops."""
    out = np.ones(DIMS)
    for turn, c in zip((2, 1, 0), gram):
        bits = np.unpackbits(langid.letter_bits(np.array([ord(c) if c else 0]), DIMS).view(np.uint8), bitorder="little")
        out *= np.roll(1 - 2 * bits.astype(float), turn)
    return out


def plain_grams(text):
    t = (text or "").lower()
    own = ["", *(c if unicodedata.category(c)[0] == "L" else "" for c in t), ""]
    return [tuple(own[k - 1 : k + 2]) for k in range(1, len(own) - 1) if own[k]]


ROWS = [
    ("the cat and the thing, that!", "en"), ("The end of it", "en"), ("der Hund und das Ding", "de"), ("nicht für die Straße", "de"), ("кошка и собака на улице", "ru"), ("это не то", "ru"),
    ("이것은 한국어 문장입니다", "ko"), ("그리고 저것도", "ko"), ("这是一个中文句子", "zh"), ("那里没有人", "zh"), ("これは日本語の文です", "ja"), ("𝒳𝒴 é̂", "en"), (None, "en"), ("no language", None), ("123 !", "de"),
]


def test_prototypes_and_cosines_equal_bundles_laid_out(spark):
    langs, prototypes = langid.fit(spark.createDataFrame(ROWS, "text string, lang string").repartition(3), DIMS)
    counts = {}
    for text, lang in ROWS:
        if lang:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    assert langs == sorted(counts)
    want = np.stack([sum(plain_vector(g) * np.sqrt(n / counts[lang].total()) for g, n in counts[lang].items()) for lang in langs])
    want -= want.mean(0)
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.abs(prototypes - want).max() < 1e-6
    asked = [t for t, _ in ROWS] + ["", "собака и это", "한국어 그리고", "一个人", "the und der", "x" * 300_000]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), (langs, prototypes)).collect()}
    for k, text in enumerate(asked):
        own = Counter(plain_grams(text))
        if not own:
            assert (got[k].lang_pred, got[k].score) == ("und", 0)
            continue
        cosine = prototypes @ sum(plain_vector(g) * n for g, n in own.items()) / np.sqrt(DIMS * sum(n * n for n in own.values()))
        e = np.exp(langid.SHARPNESS * (cosine - cosine.max()))
        assert got[k].lang_pred == langs[int(cosine.argmax())] and abs(got[k].score - 1 / e.sum()) < 1e-4


def test_scripts_are_told_apart(spark):
    """Letters of all scripts have vectors of their own."""
    model = langid.fit(spark.createDataFrame(ROWS, "text string, lang string"))
    asked = [("улица и кошка", "ru"), ("한국어 문장", "ko"), ("中文句子没有", "zh"), ("日本語です", "ja"), ("the thing", "en"), ("und das Ding", "de")]
    got = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(asked)], "doc_id long, text string"), model).collect()}
    assert got == {k: lang for k, (_, lang) in enumerate(asked)}
    vectors = langid.letter_bits(np.arange(0xAC00, 0xAC00 + 500))
    assert len(np.unique(vectors, axis=0)) == 500


def test_products_are_the_same_when_forgotten(monkeypatch):
    r = np.random.default_rng(1)
    prototypes = r.normal(size=(3, DIMS))
    monkeypatch.setattr(langid, "KNOWN", 50)
    products = langid.Products(prototypes)
    for _ in range(20):
        codes = np.unique(r.integers(97, 103, 60) << 42 | r.integers(97, 103, 60) << 21 | 99)
        assert np.allclose(products.of(codes), langid.trigram_vectors(codes, DIMS) @ prototypes.T, atol=1e-3) and len(products.codes) <= 50


def test_held_out_texts(spark):
    path = "/root/testdata/sf0.01"
    got = langid.op8_langid(spark, path).toPandas()
    docs = pd.read_parquet(f"{path}/documents.parquet")
    assert len(got) == len(docs)
    both = got.merge(docs, on="doc_id")
    own = both[both.held_out & both.lang.notna() & both.text.fillna("").str.contains("[A-Za-z]")]
    assert len(own) > 200 and (own.lang == own.lang_pred).mean() > 0.97
