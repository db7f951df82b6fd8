"""Toxicity by weak supervision.

Voters look at a text and say toxic, clean or nothing. Two lexicons and three patterns are fixed (LEXICON, PATTERNS);
the others are lexicons mined from labelled rows: whole words, and word beginnings of several lengths, that nearly
always come with the label 1. A generative label model estimates each voter's accuracy from how the voters agree, by
expectation-maximisation over the counts of vote patterns, and finds pairs of voters that agree more than their
accuracies explain; such a pair is then modelled jointly, so that it doesn't count twice. The label itself is one more
voter, and a noisy one. A linear classifier is trained on the posterior labels; it sees words and word beginnings only
and scores every text.

The fit reads `most` labelled rows at most, those first by a hash of doc_id and text (a documented bound); scoring reads all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import bytehash
from folio.llm.common import mapped, stored

#: Insults by kind: for persons, and for what they do or are (fixed values).
LEXICON = (
    ("idiot", "idiots", "moron", "morons", "imbecile", "loser", "losers", "scum", "trash", "clown", "jerk", "bastard", "bitch", "asshole", "scumbag", "dumbass"),
    ("stupid", "pathetic", "worthless", "disgusting", "dumb", "filthy", "ugly", "vile", "retarded", "fucking", "shitty", "idiotic", "moronic"),
)
#: Phrases by form, over lower-cased text: an insult said to somebody, a dismissal, a spelling that hides a word.
PATTERNS = (
    rb"\byou(?:'re| are| r)? (?:(?:a|an|such|so|just|really|all|nothing|but|total|complete|bunch|of|the) ){0,4}(?:%s)\b" % b"|".join(w.encode() for words in LEXICON for w in words),
    rb"\b(?:shut up|go to hell|drop dead|kill yourself|piss off|get lost|screw you|fuck you|nobody (?:likes|wants) you|i hate you)\b",
    rb"\b(?:f[*@#]+c?k|sh[*@!1]t|b[*!1]tch|a[*$]{2}hole|id[*1!]ot|m[*0]r[*0]n|st[*]pid)[a-z]*",
)
_FORMS = tuple(map(re.compile, PATTERNS))
#: Bytes of the word beginnings that are features beside whole words; the rows of a fit at most.
BEGINNINGS, MOST = (3, 4, 5, 6, 8), 8000
#: A mined entry: so many labelled texts have it at least, and of those, so large a part is labelled 1 at least
#: (lower end of the interval).
SUPPORT, PRECISION = 4, 0.6
THRESHOLD = 0.3
#: Characters and rows handled at a time; features that a task holds before it adds them up.
STEP, ROWS, MERGE = 1 << 18, 500, 1 << 20
_WORD = np.ones(256, bool)
_WORD[[c for c in range(128) if not chr(c).isalnum()]] = False


def text_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, text, kind) of all words, word beginnings and patterns, feature a 64-bit hash; kind 0 whole word, then
    BEGINNINGS, then PATTERNS."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    joined = b"\0".join(raw) + b"\0"
    data = np.frombuffer(joined, np.uint8)
    offsets = np.cumsum([0] + [len(r) + 1 for r in raw])
    inside = _WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    owner = np.searchsorted(offsets, start, "right") - 1
    sums = bytehash.prefixes(data)
    feature, text, kind = [bytehash.pieces(sums, start, end)], [owner], [np.zeros(len(start), np.int8)]
    for k, n in enumerate(BEGINNINGS, 1):
        long = end - start > n
        feature.append(bytehash.pieces(sums, start[long], start[long] + n) ^ np.uint64(k))
        text.append(owner[long])
        kind.append(np.full(int(long.sum()), k, np.int8))
    for k, form in enumerate(_FORMS):
        at = np.array([m.start() for m in form.finditer(joined)], np.int64)
        feature.append(np.full(len(at), pattern_hash(k), np.uint64))
        text.append(np.searchsorted(offsets, at, "right") - 1)
        kind.append(np.full(len(at), len(BEGINNINGS) + 1 + k, np.int8))
    return np.concatenate(feature), np.concatenate(text), np.concatenate(kind)


def pattern_hash(k: int) -> np.uint64:
    return bytehash.mix64(np.array([0x70A77E12 + k], np.uint64))[0]


def portions(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Pieces of `texts`, STEP characters together or little more, and the text that each is of. A text is cut at blanks
    only; a pattern across such a cut isn't seen."""
    held, of, size = [], [], 0
    for k, t in enumerate(texts):
        at = 0
        while at < len(t) or at == 0:
            end = len(t)
            if end - at > STEP:
                end = t.find(" ", at + STEP)
                end = len(t) if end < 0 else end
            held.append(t[at:end])
            of.append(k)
            size += end - at
            at = max(end, at + 1)
            if size >= STEP:
                yield held, np.array(of)
                held, of, size = [], [], 0
    if held:
        yield held, np.array(of)


def word_hash(word: str) -> int:
    return int(text_features([word])[0][0])


# ---- the label model


@dataclass
class LabelModel:
    """Chances of each vote given the class. cliques: groups of one or two voters; tables: for each clique, P(vote or
    pair of votes | class) as [class, vote] with votes coded 0 clean, 1 nothing, 2 toxic (pairs: 3 * first + second)."""

    cliques: list[tuple[int, ...]]
    tables: list[np.ndarray]
    prior: float

    def code(self, votes: np.ndarray, clique: tuple[int, ...]) -> np.ndarray:
        out = np.zeros(len(votes), np.int64)
        for v in clique:
            out = out * 3 + votes[:, v] + 1
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes); votes are -1, 0 or 1."""
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for clique, table in zip(self.cliques, self.tables):
            log += np.log(table[:, self.code(votes, clique)]).T
        e = np.exp(log - log.max(1, keepdims=True))
        return e[:, 1] / e.sum(1)

    def accuracies(self) -> list[float]:
        """Of each voter that stands alone: P(right | it votes)."""
        out = []
        for clique, t in zip(self.cliques, self.tables):
            if len(clique) == 1:
                right = t[1, 2] * self.prior + t[0, 0] * (1 - self.prior)
                wrong = t[0, 2] * (1 - self.prior) + t[1, 0] * self.prior
                out.append(right / max(right + wrong, 1e-9))
        return out


def _em(patterns: np.ndarray, n: np.ndarray, cliques: list[tuple[int, ...]], start: np.ndarray, rounds: int = 60) -> tuple[LabelModel, np.ndarray]:
    p, model = start.clip(0.01, 0.99), None
    for _ in range(rounds):
        prior = float(np.clip((p * n).sum() / n.sum(), 0.01, 0.5))
        tables = []
        model = LabelModel(cliques, tables, prior)
        for clique in cliques:
            code, size = model.code(patterns, clique), 3 ** len(clique)
            t = np.stack([np.bincount(code, n * (1 - p), size), np.bincount(code, n * p, size)]) + 0.5
            tables.append(t / t.sum(1, keepdims=True))
        p = model.posterior(patterns)
    return model, p


def fit_label_model(votes: np.ndarray, excess: float = 0.3) -> LabelModel:
    """votes: rows by voters, -1 clean, 0 nothing, 1 toxic. Starts from the votes' balance, and then pairs the voters
    whose votes stay correlated by more than `excess` given the class, the strongest first; a voter is in one pair."""
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    m = votes.shape[1]
    start = 1 / (1 + np.exp(-1.5 * (patterns.clip(0).sum(1) - 0.5 * (patterns < 0).sum(1) / max(1, m) - 0.5)))
    model, p = _em(patterns, n, [(v,) for v in range(m)], start)
    found = []
    for a in range(m):
        for b in range(a + 1, m):
            strength = 0.0
            for q in (p, 1 - p):
                w = n * q
                if w.sum() < 20:
                    continue
                x, y = patterns[:, a] - np.average(patterns[:, a], weights=w), patterns[:, b] - np.average(patterns[:, b], weights=w)
                spread = np.sqrt(np.average(x * x, weights=w) * np.average(y * y, weights=w))
                if spread > 1e-3:
                    strength = max(strength, abs(np.average(x * y, weights=w)) / spread)
            if strength > excess:
                found.append((-strength, a, b))
    cliques, used = [], set()
    for _, a, b in sorted(found):
        if not {a, b} & used:
            cliques.append((a, b))
            used |= {a, b}
    if not cliques:
        return model
    return _em(patterns, n, cliques + [(v,) for v in range(m) if v not in used], p)[0]


# ---- the fit


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    label_model: LabelModel | None = None


def fit(rows: DataFrame, most: int = MOST) -> Model:
    """Fit on `rows` (text, toxic 0 or 1), `most` different texts at most. Null labels don't count; a null text is empty.
    Equal texts count once, with the mean of their labels rounded down. Without rows, or with one class only, the model
    knows the fixed lexicons and patterns alone."""
    fixed = [np.array(sorted(word_hash(w) for w in words), np.uint64) for words in LEXICON]
    fixed += [np.array([pattern_hash(k)]) for k in range(len(PATTERNS))]
    own = np.unique(np.concatenate(fixed))
    texts = F.coalesce("text", F.lit(""))
    hashed = rows.where(F.col("toxic").isNotNull()).select(texts.alias("text"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64(F.lit(11), texts).alias("h"))
    sample = hashed.groupBy("h").agg(F.first("text").alias("text"), F.floor(F.avg("toxic")).cast("int").alias("toxic"))
    sample = stored(sample.orderBy("h").limit(most).repartition(8, "h"), "sample")
    classes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(classes) < 2:
        return Model(own, np.full(len(own), 3.0), -3.0)
    counted = mapped(sample.select("text", "toxic"), _counts, "feature long, kind int, total long, positive long").groupBy("feature").agg(F.max("kind").alias("kind"), F.sum("total").alias("total"), F.sum("positive").alias("positive"))
    rate = F.col("positive") / F.col("total")
    lower = rate - F.sqrt((rate * (1 - rate) + 0.25 / F.col("total")) / F.col("total"))
    table = counted.where((F.col("positive") >= SUPPORT) & (lower >= PRECISION)).select("feature", "kind").toArrow()
    mined = table.column(0).to_numpy().view(np.uint64)
    # the classifier sees entries that tell something: mined ones and the fixed
    used = np.unique(np.concatenate([mined, own]))
    kinds = np.full(len(used), -1)
    kinds[np.searchsorted(used, mined)] = table.column(1).to_numpy()
    y, rows_, cols = _matrix(sample, used)
    has = lambda flags: np.bincount(rows_[flags[cols]], minlength=len(y))
    # voters: the fixed lexicons and patterns, two or more fixed words, the mined lexicons by kind, and the label
    is_fixed = [np.isin(used, f) for f in fixed]
    says = [np.where(has(f) > 0, 1, 0) for f in is_fixed]
    says.append(np.where(has(is_fixed[0] | is_fixed[1]) > 1, 1, 0))
    says += [np.where(has(kinds == k) > 0, 1, -1) for k in range(len(BEGINNINGS) + 1) if (kinds == k).any()]
    says.append(np.where(y == 1, 1, -1))
    label_model = fit_label_model(np.stack(says, 1))
    target = label_model.posterior(np.stack(says, 1))
    w, b = np.zeros(len(used)), float(np.log(target.mean() / (1 - target.mean()) + 1e-9))
    speed, pulled = np.full(len(w), 1e-6), 1e-6
    for _ in range(300):  # AdaGrad
        z = b + np.bincount(rows_, w[cols], len(y))
        g = 1 / (1 + np.exp(-z.clip(-30, 30))) - target
        gw = np.bincount(cols, g[rows_], len(w)) / len(y) + 1e-5 * w
        gb = g.mean()
        speed += gw * gw
        pulled += gb * gb
        w -= 0.2 * gw / np.sqrt(speed)
        b -= 0.2 * gb / np.sqrt(pulled)
    return Model(used, w, b, label_model)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, kind, total, positive: in how many texts, and labelled 1, the features of a task's texts are. Texts are
    added up MERGE at a time, so that what is held is the distinct features."""
    known: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    fresh: list[tuple[np.ndarray, ...]] = []

    def merge() -> None:
        nonlocal known
        both = [np.concatenate(c) for c in zip(known, *fresh)]
        fresh.clear()
        feature, first, at = np.unique(both[0], return_index=True, return_inverse=True)
        known = [feature, both[1][first], *(np.bincount(at, c, len(feature)).astype(np.int64) for c in both[2:])]

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own, kinds = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for piece, _ in portions([text]):
                f, _, kind = text_features(piece)
                own, first = np.unique(np.concatenate([own, f]), return_index=True)
                kinds = np.concatenate([kinds, kind])[first]
            one = np.ones(len(own), np.int64)
            fresh.append((own, kinds, one, one * toxic))
            if sum(len(x[0]) for x in fresh) > MERGE:
                merge()
    merge()
    for a in range(0, len(known[0]), 1 << 16):
        feature, kind, total, positive = (c[a : a + (1 << 16)] for c in known)
        yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(total), pa.array(positive)], names=["feature", "kind", "total", "positive"])


def _matrix(sample: DataFrame, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels of the sample's texts, and (text, number in `used`) of the features that each has."""
    shared = sample.sparkSession.sparkContext.broadcast(used)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = shared.value
        for batch in batches:
            numbers = []
            for text in batch.column(1).to_pylist():
                own = [np.zeros(0, np.int64)]
                for piece, _ in portions([text]):
                    f, _, _ = text_features(piece)
                    place = np.minimum(np.searchsorted(used, f), len(used) - 1)
                    own.append(np.unique(place[used[place] == f]))
                numbers.append(np.unique(np.concatenate(own)).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(numbers, pa.binary())], names=["h", "toxic", "numbers"])

    found = mapped(sample.select("h", "text", "toxic"), run, "h long, toxic int, numbers binary").orderBy("h").toArrow()
    own = [np.frombuffer(x.as_py(), np.int32) for x in found.column(2)]
    return found.column(1).to_numpy().astype(np.int64), np.repeat(np.arange(len(own)), list(map(len, own))), np.concatenate([*own, np.zeros(0, np.int32)]).astype(np.int64)


def _scorer(features: np.ndarray, weights: np.ndarray, bias: float):
    """A function from texts to their scores."""
    width = max(len(features), 1)
    maybe = np.zeros(1 << 20, bool)
    maybe[(features >> np.uint64(44)).astype(np.int64)] = True

    def part(texts: list[str]) -> np.ndarray:
        """text * width + number of the features that each text has, once each."""
        f, text, _ = text_features(texts)
        near = np.flatnonzero(maybe[(f >> np.uint64(44)).astype(np.int64)])
        f, text = f[near], text[near]
        place = np.minimum(np.searchsorted(features, f), max(len(features) - 1, 0))
        hit = features[place] == f if len(features) else np.zeros(len(f), bool)
        return text[hit] * width + place[hit]

    def whole(texts: list[str]) -> np.ndarray:
        pairs = [np.zeros(0, np.int64)]
        for piece, of in portions(texts):
            pair = part(piece)
            pairs.append(np.unique(of[pair // width] * width + pair % width))
        pair = np.unique(np.concatenate(pairs))  # a feature counts once in a text
        z = bias + np.bincount(pair // width, weights[pair % width] if len(pair) else None, len(texts))
        return 1 / (1 + np.exp(-z.clip(-30, 30)))

    return whole


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, ROWS at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of `docs` (doc_id, text; further columns are not read). A null or empty text has the
    score of no feature. Repeated rows are scored each. An empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(*shared.value)
        for batch in _few(batches):
            found = scorer([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def below(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Those rows of `docs` (with a column text), whole, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(*shared.value)
        for batch in _few(batches):
            found = scorer([t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()])
            yield batch.filter(pa.array(found < threshold))

    return mapped(docs, run, docs.schema)


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """text and toxic of documents that have a label and aren't held out (crc32 of doc_id as text, mod 4, is 2): of
    `most` labels of such documents, first by a hash of doc_id. They are chosen by ids alone, before any text is read,
    and so few that they are sent to every task, so texts aren't shuffled. Of several labels the greatest counts."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc % 4 != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64(F.lit(13), "doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", "toxic")


def op10_toxicity(spark, sf_dir):
    """Learns from the rows whose crc32(doc_id as text) mod 4 is not 2; those are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
