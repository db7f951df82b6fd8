"""Language ID by hyperdimensional profiles.

Every letter, told by its code point, has a random vector of +1 and -1. A letter trigram's vector is the product
(binding) of its letters' vectors, each permuted by its place; a text's vector is the sum (bundling) of its trigrams'
vectors, and a language's prototype is the bundle of its training texts, from which the mean of all prototypes is taken
away, so that what all languages share doesn't count. A text gets the language whose prototype has the highest cosine
with its vector.

Vectors are bits, so binding is an exclusive or. Trigrams are counted and bundled by the executors; what the driver holds
is a vector for each language, whatever the scripts. A text's product with a prototype is the sum over its trigrams of
the trigram's product with the prototype, so those are worked out once for the trigrams that a worker meets, and no
text's vector is laid out. For its length the trigrams' vectors count as orthogonal, as random vectors of that many
dimensions nearly are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.bytehash import mix64
from folio.llm.common import mapped, stored

#: Dimensions (a multiple of 64); characters handled at a time; trigrams laid out at a time.
DIMS, STEP, LAID = 2048, 1 << 18, 1024
#: How sharply a difference of cosines tells in the score.
SHARPNESS = 30.0
#: Trigrams that a task holds before it hands their counts on, and whose products a worker remembers.
HELD, KNOWN = 1 << 20, 1 << 18
#: Shares are added up as integers of this part, so that sums don't depend on their order.
UNIT = 1 << 32
_TOP = 0x110000
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(p))[0] == "L" for p in range(_TOP)), bool, _TOP))
    return _letters[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' letter trigrams (three code points of 21 bits, 0 for a non-letter on either side), each one's text, and
    which texts have a letter."""
    lowered = [t.lower() for t in texts]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    # a character that is no letter before, between and after the texts
    joined = "\n" + "\n".join(lowered) + "\n"
    point = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    point[~_is_letter()[point]] = 0
    text_of = np.repeat(np.arange(len(texts)), lengths + 1)
    middle = np.flatnonzero(point[1:-1]) + 1
    code = (point[middle - 1] << 42) | (point[middle] << 21) | point[middle + 1]
    owner = text_of[middle - 1]
    return code, owner, np.bincount(owner, minlength=len(texts)) > 0


def letter_bits(points: np.ndarray, dims: int = DIMS, seed: int = 5) -> np.ndarray:
    """A row of random bits (64 a word) for each code point."""
    at = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dims // 64 + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return mix64(mix64(at) ^ np.uint64(seed))


def _turned(bits: np.ndarray) -> np.ndarray:
    """Each row permuted: all bits one place on, the last to the front."""
    return (bits << np.uint64(1)) | np.roll(bits >> np.uint64(63), 1, axis=1)


def trigram_vectors(codes: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Rows of +1 and -1 (float32), one for each trigram: its letters' vectors, turned twice, once and not, bound."""
    mask = (1 << 21) - 1
    points, at = np.unique(np.stack([codes >> 42, codes >> 21 & mask, codes & mask]), return_inverse=True)
    own = letter_bits(points, dims)
    once = _turned(own)
    a, b, c = at.reshape(3, -1)
    bound = _turned(once)[a] ^ once[b] ^ own[c]
    return 1 - 2 * np.unpackbits(bound.view(np.uint8), axis=1, bitorder="little").astype(np.float32)


def _steps(texts: list[str]):
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= STEP:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return code, np.bincount(at, np.concatenate([n for _, n in parts]), len(code)).astype(np.int64)


def count_trigrams(rows: DataFrame) -> DataFrame:
    """lang, code, n over rows of text and lang; each task sums its own first, HELD trigrams at a time."""
    names = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                code, n = _added(parts)
                for k in range(0, len(code), 1 << 16):
                    c, m = code[k : k + (1 << 16)], n[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c), pa.array(m)], schema=names)
            held.clear()

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _steps(texts):
                langs = np.array(batch.column(1)[a:b].to_pylist(), object)
                code, owner, _ = trigrams(texts[a:b])
                for lang in dict.fromkeys(langs.tolist()):
                    own = np.unique(code[(langs == lang)[owner]], return_counts=True)
                    held[lang] = [_added([*held[lang], own])] if lang in held else [own]
                size = sum(len(p[0]) for parts in held.values() for p in parts)
                if size > HELD:
                    yield from emit()
        yield from emit()

    return mapped(rows, run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def bundles(shares: DataFrame, dims: int = DIMS) -> DataFrame:
    """lang, place, total: the sum over a language's trigrams of their share times their vector, in units of 1 / UNIT.
    shares: lang, code, share (a whole number of units). A task adds up its own first."""
    names = pa.schema([("lang", pa.string()), ("place", pa.int32()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, code, share = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for a in range(0, len(code), LAID):
                part = slice(a, a + LAID)
                vectors = trigram_vectors(code[part], dims).astype(np.float64)
                for lang in dict.fromkeys(langs[part].tolist()):
                    # whole numbers below 2**53, so exact
                    own = np.where(langs[part] == lang, share[part], 0).astype(np.float64)
                    total[lang] = total.get(lang, 0) + (own @ vectors).astype(np.int64)
        for lang, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dims, pa.string()), pa.array(np.arange(dims, dtype=np.int32)), pa.array(own)], schema=names)

    return mapped(shares.select("lang", "code", "share"), run, "lang string, place int, total long").groupBy("lang", "place").agg(F.sum("total").alias("total"))


def fit(rows: DataFrame, dims: int = DIMS) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes (a row each).

    rows: text, lang; those with a null lang or text, or without a letter, don't count. What reaches the driver is a
    count and a vector for each language, whatever the input.
    """
    counts = stored(count_trigrams(rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")), "trigrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "lang").select("lang", "code", F.round(F.sqrt(F.col("n") / F.col("total")) * UNIT).cast("long").alias("share"))
    found = bundles(shares, dims).toArrow()
    names, place, total = (found.column(k).to_numpy(zero_copy_only=False) for k in range(3))
    langs = sorted(set(names.tolist()))
    prototypes = np.zeros((len(langs), dims))
    if langs:
        prototypes[np.searchsorted(np.array(langs, object), names), place] = total / UNIT
        prototypes -= prototypes.mean(0) if len(langs) > 1 else 0
        prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
    return langs, prototypes


class Products:
    """Trigrams' products with the prototypes, remembered for KNOWN trigrams."""

    def __init__(self, prototypes: np.ndarray):
        self.to = prototypes.T.astype(np.float32)
        self.codes, self.rows = np.zeros(0, np.int64), np.zeros((0, len(prototypes)), np.float32)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """codes: distinct, ascending."""
        at = np.searchsorted(self.codes, codes)
        known = np.append(self.codes, -1)[at] == codes
        out = np.empty((len(codes), self.rows.shape[1]), np.float32)
        out[known] = self.rows[at[known]]
        new = codes[~known]
        if len(new):
            own = np.concatenate([trigram_vectors(new[k : k + LAID], len(self.to)) @ self.to for k in range(0, len(new), LAID)])
            out[~known] = own
            if len(self.codes) + len(new) > KNOWN:
                self.codes, self.rows = new[:KNOWN], own[:KNOWN]
            else:
                both, rows = np.concatenate([self.codes, new]), np.concatenate([self.rows, own])
                order = np.argsort(both)
                self.codes, self.rows = both[order], rows[order]
        return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score of `docs` (doc_id, text; further columns are not read).

    lang_pred is `und`, with score 0, where the text is null or has no letter or no language was learned; equal cosines
    go to the language first in order. score is the language's part in the softmax of the cosines. Repeated rows are
    scored each. Every task gets the prototypes: a vector for each language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prototypes = shared.value
        products, dims = Products(prototypes), prototypes.shape[1]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _steps(texts):
                code, owner, lettered = trigrams(texts[a:b])
                if langs:
                    codes, at = np.unique(code, return_inverse=True)
                    key, n = np.unique(owner * max(1, len(codes)) + at, return_counts=True)
                    who, table = key // max(1, len(codes)), products.of(codes)[key % max(1, len(codes))]
                    length = np.sqrt(dims * np.bincount(who, n.astype(float) ** 2, b - a))
                    cosine = np.stack([np.bincount(who, n * table[:, k], b - a) for k in range(len(langs))], 1) / np.maximum(length, 1e-12)[:, None]
                    e = np.exp(SHARPNESS * (cosine - cosine.max(1, keepdims=True)))
                    pred = [langs[k] if ok else "und" for k, ok in zip(cosine.argmax(1).tolist(), lettered.tolist())]
                    score = np.where(lettered, 1 / e.sum(1), 0.0)
                else:
                    pred, score = ["und"] * (b - a), np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(pred, pa.string()), pa.array(score)], schema=names)

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double")


def op8_langid(spark, sf_dir):
    """Learns from the rows whose crc32(doc_id as text) mod 3 is not 1; those are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = fit(docs.where(~held("doc_id")).select("text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held("doc_id").alias("held_out"), "lang_pred", "score")
