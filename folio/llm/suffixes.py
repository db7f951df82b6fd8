"""Exact removal of repeated 50-byte strings by a collection Burrows-Wheeler transform.

1. A document that equals one with a smaller doc_id repeats it whole; only the first of equal texts goes on.
2. Each 50-byte string has a minimizer, the smallest of the hashes of its 24-byte parts. Strings that are equal have
   equal minimizers; a string whose minimizer stands in one document only has no copy elsewhere. Neighbouring strings
   mostly share a minimizer, so a document is cut into stretches of one minimizer each, and those whose minimizer
   stands in several documents are segments. Equal segments are one, with the smallest doc_id that has it. Segments
   none of whose strings has its hash twice in their batch are left out.
3. The segments of a batch of minimizers are a collection of short sequences. Its Burrows-Wheeler transform is built
   column by column: each round inserts one symbol per sequence, from the ends to the starts. The place of a suffix
   follows from that of the suffix it extends, by counting the symbol's occurrences before it. Each round passes once,
   front to back, over the transform so far, and carries nothing else along.
4. Among suffixes next to each other, runs with 50 bytes in common are the repeated strings; a string is removed where
   its run has a document with a smaller doc_id.

Batches are bounded, so the columns' arrays are held in memory, where one machine would pass them through files; and as
only common prefixes of 50 bytes count, they are found once, between neighbours of the finished order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import bytehash
from folio.llm.common import lookup, stored

#: Bytes of a string, of the parts from which its minimizer is taken; strings of a segment at most (bits of a mask).
LENGTH, PART, MOST = 50, 24, 63
#: Bytes of text and of segments handled at a time.
STEP, BATCH = 1 << 20, 1 << 20


def _minimizers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all LENGTH-byte strings inside one text, in order, and their minimizers."""
    parts = len(data) - PART + 1
    start = np.arange(max(0, len(data) - LENGTH + 1))
    if not len(start):
        return start, np.zeros(0, np.uint64)
    at = np.arange(parts)
    low = bytehash.rough_pieces(bytehash.rough_prefixes(data), at, at + PART)
    width, reach = LENGTH - PART + 1, 1
    while reach * 2 <= width:  # the least of `reach` values from each place
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[: len(start)], low[width - reach : width - reach + len(start)])
    end = offsets[np.searchsorted(offsets, start, "right")]  # of the text in which a string starts
    inside = start + LENGTH <= end
    return start[inside], low[inside]


def _stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First string, number of strings, minimizer and text of each stretch."""
    start, low = _minimizers(data, offsets)
    text = np.searchsorted(offsets, start, "right") - 1
    if not len(start):
        return start, start, low, text
    new = np.append(True, (low[1:] != low[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    pieces = -(-count // MOST)  # a long stretch, as in periodic text, is cut
    owner = np.repeat(np.arange(len(first)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[owner] + nth * MOST
    return start[begin], np.minimum(count[owner] - nth * MOST, MOST), low[begin], text[begin]


def transform(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform of the sequences data[start:end], by inserting a column a round: for each suffix in
    order the byte before it plus 1, or 0 where it is its sequence's start. Texts are UTF-8, which has no byte 255.

    A suffix's place is known from the suffix that it extends: as many come before it as there are smaller symbols in
    the transform so far, and equal ones ahead. `waits` holds the places of the last round's suffixes and `owner` their
    sequences; nothing else is carried from round to round but the transform.
    """
    length = ends - starts
    owner = np.arange(len(starts))
    before = lambda seq, n: np.where(length[seq] > n, data[ends[seq] - n - 1] + np.uint8(1), np.uint8(0))
    symbol, waits = before(owner, 0), owner
    for n in range(1, int(length.max(initial=0)) + 1):
        grow = symbol[waits] > 0
        places, owner = followers(symbol)[waits[grow]] + len(starts), owner[grow]
        order = np.argsort(places)
        waits, owner = places[order], owner[order]
        old = np.ones(len(symbol) + len(waits), bool)
        old[waits] = False
        wider = np.empty(len(old), np.uint8)
        wider[old], wider[waits] = symbol, before(owner, n)
        symbol = wider
    return symbol


def followers(symbol: np.ndarray) -> np.ndarray:
    """For each entry of a transform the place, after the empty suffixes, of the suffix that its symbol begins."""
    ended = int((symbol == 0).sum())
    out = np.empty(len(symbol), np.int32 if len(symbol) < 1 << 31 else np.int64)
    out[np.argsort(symbol, kind="stable")] = np.arange(len(symbol)) - ended
    return out


def transform_order(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted suffixes of the sequences data[start:end] as (sequence, length): the finished transform is walked from
    all sequences' ends to their starts."""
    m = len(starts)
    symbol = transform(data, starts, ends)
    after = followers(symbol)
    seq, size = np.empty(len(symbol), np.int32), np.empty(len(symbol), np.int32)
    at, owner, n = np.arange(m), np.arange(m), 0
    while len(at):
        seq[at], size[at] = owner, n
        go = symbol[at] > 0
        at, owner, n = after[at[go]] + m, owner[go], n + 1
    return seq, size


def repeated(segments: list[bytes], docs: np.ndarray) -> np.ndarray:
    """For each segment a mask of its strings (bit k: the string at k) that another segment with a smaller doc has."""
    lengths = np.array([len(s) for s in segments], np.int64)
    masks = np.zeros(len(segments), np.int64)
    data = np.frombuffer(b"".join(segments) + bytes(64), np.uint8)
    ends = np.cumsum(lengths)
    maybe = np.flatnonzero(_has_twin(data, ends - lengths, lengths - LENGTH + 1))
    if not len(maybe):
        return masks
    starts, ends, docs = (ends - lengths)[maybe], ends[maybe], docs[maybe]
    seq, size = transform_order(data, starts, ends)
    whole = size >= LENGTH
    seq, size = seq[whole], size[whole]
    at = ends[seq] - size
    # LENGTH bytes of neighbours, eight at a time (the last eight overlap)
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    same = np.ones(max(0, len(at) - 1), bool)
    for k in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        w = np.ascontiguousarray(words[at + k]).view(np.uint64).ravel()
        same &= w[1:] == w[:-1]
    run = np.concatenate([[0], np.cumsum(~same)])
    least = np.minimum.reduceat(docs[seq], np.flatnonzero(np.append(True, ~same)))
    hit = least[run] < docs[seq]
    np.bitwise_or.at(masks, maybe[seq[hit]], np.int64(1) << (at[hit] - starts[seq[hit]]))
    return masks


def _has_twin(data: np.ndarray, starts: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Which segments have a string whose hash occurs twice."""
    owner = np.repeat(np.arange(len(starts)), strings)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings) + starts[owner]
    key = bytehash.rough_pieces(bytehash.rough_prefixes(data), at, at + LENGTH)
    order = np.argsort(key)
    twin = np.append(key[order[1:]] == key[order[:-1]], False)
    twin[1:] |= twin[:-1].copy()
    out = np.zeros(len(starts), bool)
    out[owner[order[twin]]] = True
    return out


def shared_minimizers(texts: DataFrame) -> DataFrame:
    """row, lows: for each text (row, raw) its minimizers that stand in another text too."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytehash.text_buffer(batch.column(1))
            row = batch.column(0).to_numpy()
            for a, b in bytehash.slices(offsets, STEP):
                _, _, low, text = _stretches(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(row[a:b][text])], names=["low", "row"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of low and row, once each, those of a low that has several rows; none needs its low whole."""
        held = (np.zeros(0, np.int64),) * 2  # the last row, which waits for the next
        told = False
        for batch in batches:
            low, row = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns))
            fresh = np.append(True, (low[1:] != low[:-1]) | (row[1:] != row[:-1]))[: len(low)]
            low, row = low[fresh], row[fresh]
            if not len(low):
                continue
            like_last = np.append(told, low[1:] == low[:-1])
            like_next = np.append(low[1:] == low[:-1], False)
            keep = like_last | like_next
            keep[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(row[keep]), pa.array(low[keep])], names=["row", "low"])
            held, told = (low[-1:], row[-1:]), bool(like_last[-1])
        if len(held[0]) and told:
            yield pa.RecordBatch.from_arrays([pa.array(held[1]), pa.array(held[0])], names=["row", "low"])

    marked = texts.select("row", "raw").mapInArrow(mark, "low long, row long")
    dealt = marked.repartition("low").sortWithinPartitions("low", "row")
    return dealt.mapInArrow(several, "row long, low long").groupBy("row").agg(F.collect_list("low").alias("lows"))


def segments(texts: DataFrame) -> DataFrame:
    """low, segment, row, doc, start, count of the stretches whose minimizer is in the text's `lows` (row, doc, raw, lows)."""
    names = ["low", "segment", "row", "doc", "start", "count"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytehash.text_buffer(batch.column(2))
            row, doc, lows = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for a, b in bytehash.slices(offsets, STEP):
                own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                start, count, low, text = _stretches(own, at)
                edge = np.searchsorted(text, np.arange(b - a + 1))
                keep = np.concatenate([np.isin(low[edge[k] : edge[k + 1]].view(np.int64), np.asarray(lows[a + k].values)) for k in range(b - a)])
                start, count, low, text = start[keep], count[keep], low[keep], text[keep]
                raw = own.tobytes()
                piece = [raw[x:y] for x, y in zip(start.tolist(), (start + count + (LENGTH - 1)).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(piece, pa.binary()), pa.array(row[a:b][text]), pa.array(doc[a:b][text]), pa.array(start - at[text]), pa.array(count)], names=names)

    return texts.select("row", "doc", "raw", "lows").mapInArrow(cut, "low long, segment binary, row long, doc long, start long, count long")


def removals(found: DataFrame) -> DataFrame:
    """row, doc, a, b: bytes [a, b) of the text to remove. `found` is what `segments` returns; a task streams its minimizers in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece: list[bytes] = []  # distinct segments of the batch in hand, their smallest docs, and all their places
        least: list[int] = []
        places: list[tuple[np.ndarray, ...]] = []
        size = 0

        def finish() -> pa.RecordBatch:
            masks = repeated(piece, np.array(least))
            nth, row, doc, start, count = (np.concatenate(c) for c in zip(*places))
            full = (np.int64(1) << count) - 1
            mask = np.where(doc > np.array(least)[nth], full, masks[nth])
            out = []
            whole = (mask == full) & (mask != 0)
            out.append((row[whole], doc[whole], start[whole], start[whole] + count[whole] + (LENGTH - 1)))
            for k in np.flatnonzero((mask != 0) & ~whole):
                bits = np.array([(int(mask[k]) >> j) & 1 for j in range(int(count[k]))], np.int8)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], bits, [0]])))
                out.append((np.full(len(edge) // 2, row[k]), np.full(len(edge) // 2, doc[k]), start[k] + edge[::2], start[k] + edge[1::2] + (LENGTH - 1)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=["row", "doc", "a", "b"])

        last: tuple | None = None
        for batch in batches:
            low, seg = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            row, doc, start, count = (batch.column(k).to_numpy() for k in range(2, 6))
            nth = np.empty(len(low), np.int64)
            at = 0
            for k, key in enumerate(zip(low.tolist(), seg)):
                if key != last:
                    if size >= BATCH and key[0] != last[0]:
                        places.append((nth[at:k], row[at:k], doc[at:k], start[at:k], count[at:k]))
                        yield finish()
                        piece, least, places, size, at = [], [], [], 0, k
                    piece.append(key[1])
                    least.append(int(doc[k]))
                    size += len(key[1])
                    last = key
                elif doc[k] < least[-1]:
                    least[-1] = int(doc[k])
                nth[k] = len(piece) - 1
            places.append((nth[at:], row[at:], doc[at:], start[at:], count[at:]))
        if piece:
            yield finish()

    dealt = found.repartition("low").sortWithinPartitions("low", "segment")
    return dealt.mapInArrow(run, "row long, doc long, a long, b long")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row of `docs` (doc_id, text; others aren't read).

    Bytes are UTF-8 bytes; a null text is empty. Rows with the same doc_id are one document here: strings that only
    they share stay. A null doc_id is larger than any. Texts of fewer than 50 bytes are kept. An empty table gives an
    empty result. Copies are told by SHA-256.
    """
    nobody = (1 << 63) - 1
    raw = F.coalesce("text", F.lit("")).cast("binary")
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(nobody)).alias("doc"), raw.alias("raw")).withColumn("row", F.xxhash64("raw", F.length("raw")))
    known = stored(slim.select("doc", "row", F.unhex(F.sha2("raw", 256)).alias("digest")).distinct(), "known")
    first = known.groupBy("digest").agg(F.min("doc").alias("first"), F.first("row").alias("row"), F.count(F.lit(1)).alias("_n"))
    lows = stored(shared_minimizers(slim), "lows")
    chosen = lows.join(first, "row").select(F.col("row"), F.col("first").alias("doc"), "lows")
    # equal rows of one doc are one
    opened = slim.join(chosen, ["row", "doc"])
    found = removals(segments(opened)).groupBy("row", "doc").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("cuts"))
    # a text of which there are very many copies is dealt over tasks
    copies = lookup(known, first.select("digest", "first"), "digest", first).select("doc", "row", (F.col("doc") > F.col("first")).alias("copy"))
    plan = copies.join(stored(found, "cuts"), ["row", "doc"], "left")
    names = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, copy = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out = []
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                spans = [(c["a"], c["b"]) for c in batch.column(3)[k].as_py() or []]
                if copy[k]:
                    spans = [(0, len(text))] if len(text) >= LENGTH else []
                runs: list[list[int]] = []
                for a, b in spans:
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                kept = b"".join(text[x:y] for x, y in zip([0] + [b for _, b in runs], [a for a, _ in runs] + [len(text)]))
                out.append({"doc_id": None if doc[k] == nobody else doc[k], "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(runs), "kept": kept})
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, names)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, names)

    return slim.join(plan, ["doc", "row"]).select("doc", "raw", "copy", "cuts").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_suffixes(spark, sf_dir):
    """Of every document its bytes, those removed, and a digest of what stays."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
