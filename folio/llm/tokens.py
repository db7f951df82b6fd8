"""Token-ID output: raw id payloads with a minimal perfect hash index, written and read in shards.

Documents are dealt to shards by ranges of doc_id and encoded in ascending order. A shard is two files:

* `.bin`: the ids of its documents, one after the other, little-endian, 16 bits each where the vocabulary allows, else 32;
* `.idx`: a JSON header line, then the arrays it names: the documents' keys in order of writing, the hash's bit arrays,
  and for each hash slot a fingerprint, an offset and a length. Beside each bit array lies the number of bits set
  before every 512th bit.

The hash is built in levels: keys that fall alone into a level's bit array own that bit, the others go to the next
level; a key's slot is the number of bits set before its own. That maps n keys to 0..n-1 without a gap, and a lookup
costs one or two probes on average. A key that isn't in the shard is turned away by the stored fingerprint.

Encoding splits a text at places where the tokenizer's own pre-tokenizer always splits (before a space or around a
newline that a visible character follows, and between a letter and a stop), finds the distinct pieces of a few MB by their 64-bit hashes, and gives
only the new ones to the tokenizers library; its ids are then gathered for every piece. A text that holds the literal of
an added token, such as <|endoftext|>, is encoded whole. The result is that of encoding each whole text by the given
file, which the tests check.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import bytehash
from folio.llm.common import new_path, stored

#: Text bytes of a shard, about.
SHARD_BYTES = 32 << 20
#: Text bytes that are encoded at a time, the distinct pieces that a task remembers at most, and the bytes that these
#: have at most: longer ones (a whole text in a script without spaces is one piece) are encoded each time.
STEP_BYTES, REMEMBERED, SHORT = 1 << 20, 1_500_000, 32
END_ID = 0
_LEVELS, _SPACE = 40, 2.0
#: ASCII letters, and marks that always begin a new piece after one.
LETTER, STOP = (np.isin(np.arange(256), list(x)) for x in (b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?|&%$*#()"))


# ---- the index


def _level_place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (bytehash.mix64(keys ^ bytehash.mix64(np.full(1, level + 1, np.uint64))) % np.uint64(size)).astype(np.int64)


def document_keys(ids: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """64-bit keys of (doc_id, how many rows with the same doc_id come before)."""
    return bytehash.mix64(bytehash.mix64(ids.astype(np.int64).view(np.uint64)) + nth.astype(np.uint64))


def build_index(keys: np.ndarray) -> list[np.ndarray]:
    """The bit arrays (a byte for each bit, 0 or 1) of a minimal perfect hash of distinct keys."""
    levels, left = [], keys
    for level in range(_LEVELS):
        if not len(left):
            break
        size = max(4, int(_SPACE * len(left)))
        place = _level_place(left, level, size)
        alone = np.bincount(place, minlength=size) == 1
        levels.append(alone.astype(np.uint8))
        left = left[~alone[place]]
    if len(left):
        raise ValueError("keys are not distinct")
    return levels


class Level:
    """A bit array that tells a set bit's rank in constant time."""

    def __init__(self, words: np.ndarray, size: int, before: np.ndarray):
        self.words, self.size, self.before = words, size, before

    @classmethod
    def of(cls, bits: np.ndarray) -> Level:
        words = np.frombuffer(np.packbits(np.pad(bits, (0, -len(bits) % 512)), bitorder="little").tobytes(), "<u8")
        counts = np.bitwise_count(words).reshape(-1, 8).sum(1)
        return cls(words, len(bits), (np.cumsum(counts) - counts).astype("<u4"))

    def total(self) -> int:
        return int(self.before[-1]) + int(np.bitwise_count(self.words[-8:]).sum())

    def has(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Bits set before each place."""
        word, out = place >> 6, self.before[place >> 9].astype(np.int64)
        for k in range(7):  # whole words of the place's block
            out += np.where(k < (word & 7), np.bitwise_count(self.words[(word & ~7) + k]), 0)
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return out + np.bitwise_count(self.words[word] & below)


def slots(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """Each key's slot; -1 for a key that no level knows."""
    out = np.full(len(keys), -1, np.int64)
    open_, base = np.arange(len(keys)), 0
    for level, bits in enumerate(levels):
        if not len(open_):
            break
        place = _level_place(keys[open_], level, bits.size)
        hit = bits.has(place)
        out[open_[hit]] = base + bits.rank(place[hit])
        base += bits.total()
        open_ = open_[~hit]
    return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (bytehash.mix64(keys + np.uint64(0x51ED)) >> np.uint64(32)).astype("<u4")


# ---- encoding


class Grown:
    """32-bit integers that are added to; room is doubled, so adding costs its own length."""

    def __init__(self) -> None:
        self.room, self.size = np.zeros(1 << 10, np.int32), 0

    @property
    def data(self) -> np.ndarray:
        return self.room[: self.size]

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.room):
            room = np.zeros(max(2 * len(self.room), self.size + len(more)), np.int32)
            room[: self.size] = self.data
            self.room = room
        self.room[self.size : self.size + len(more)] = more
        self.size += len(more)


class PieceEncoder:
    """Encodes many texts at once; see the module's docstring."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        split = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        self.by_piece = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not json.loads(self.tokenizer.to_str())["normalizer"]
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self._forget()

    def _forget(self) -> None:
        """Pieces known by their hashes, in two sorted runs of which the second is short; and their ids."""
        self.runs = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))] * 2
        self.ids, self.starts, self.counts = (Grown() for _ in range(3))

    def _recall(self, keys: np.ndarray) -> np.ndarray:
        """The number of each piece that is known, else -1."""
        out = np.full(len(keys), -1, np.int64)
        for known, number in self.runs:
            if len(known):
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                out = np.where(known[place] == keys, number[place], out)
        return out

    def _remember(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        both = lambda a, b: (np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))
        long, short = self.runs
        if len(short[0]) > 1 << 17:
            long, short = both(long, short), (np.zeros(0, np.uint64), np.zeros(0, np.int32))
            order = np.argsort(long[0], kind="stable")
            long = (long[0][order], long[1][order])
        short = both(short, (keys, numbers))
        order = np.argsort(short[0], kind="stable")
        self.runs = [long, (short[0][order], short[1][order])]

    def _keep(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Remember those pieces that have few bytes, so that what is kept is bound by their number; too many: begin anew."""
        short = size <= SHORT
        if not short.any():
            return
        ids, counts, keys = ids[np.repeat(short, counts)], counts[short].astype(np.int32), keys[short]
        if self.counts.size + len(counts) > REMEMBERED:
            self._forget()
        self._remember(keys, (self.counts.size + np.arange(len(counts))).astype(np.int32))
        self.starts.add((self.ids.size + np.cumsum(counts) - counts).astype(np.int32))
        self.counts.add(counts)
        self.ids.add(ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and their number for each text."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        whole = self._whole(data, offsets)
        if whole.all():
            return self._encode_texts(data, offsets)
        if not whole.any():
            return self._encode_pieces(data, offsets)
        counts, ids = np.zeros(n, np.int64), []
        for own, encode in ((whole, self._encode_texts), (~whole, self._encode_pieces)):
            size = np.diff(offsets)
            flat, counts[own] = encode(data[np.repeat(own, size)], np.append(0, np.cumsum(size[own])))
            ids.append(flat)
        of_whole, out = np.repeat(whole, counts), np.zeros(int(counts.sum()), np.int64)
        out[of_whole], out[~of_whole] = ids
        return out, counts

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts aren't encoded by pieces: all for some tokenizers, else those that hold the literal of an added token."""
        out = np.full(len(offsets) - 1, not self.by_piece)
        raw = data.tobytes()
        for literal in self.added if self.by_piece else ():
            at = raw.find(literal)
            while at >= 0:
                text = np.searchsorted(offsets, at, "right") - 1
                out[text] |= at + len(literal) <= offsets[text + 1]  # else it begins in one text and ends in another
                at = raw.find(literal, at + 1)
        return out

    def _encode_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])]
        found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.int64), np.array([len(x) for x in found], np.int64)

    def _encode_pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        # a character that may be white space doesn't count as visible: ASCII up to 0x20, and lead bytes of others
        visible = (data > 32) & ~np.isin(data, [0xC2, 0xE1, 0xE2, 0xE3])
        follows = np.append(visible[1:], False)
        follows[offsets[1:][offsets[1:] > 0] - 1] = False  # the next text doesn't follow
        line = (data == 10) & follows
        cut = ((data == 32) & follows) | line
        cut[1:] |= line[:-1]
        cut[1:] |= LETTER[data[:-1]] & STOP[data[1:]]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        keys = bytehash.pieces(bytehash.prefixes(data), start, end)
        own, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = self._recall(own)
        new = np.flatnonzero(at < 0)
        # ids of what is new stand by themselves; short pieces are remembered after
        begins, counts, fresh = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), np.zeros(0, np.int32)
        known = at >= 0
        begins[known], counts[known] = self.starts.data[at[known]], self.counts.data[at[known]]
        if len(new):
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            counts[new] = np.fromiter(map(len, found), np.int32, len(found))
            begins[new] = np.cumsum(counts[new]) - counts[new]
            fresh = np.fromiter(chain.from_iterable(found), np.int32, int(counts[new].sum()))
        count = counts[inverse]
        before = np.cumsum(count, dtype=np.int64) - count
        place = np.repeat(begins[inverse] - before, count) + np.arange(int(count.sum()))
        old = np.repeat(known[inverse], count)
        flat = np.empty(len(place), np.int32)
        flat[old], flat[~old] = self.ids.data[place[old]], fresh[place[~old]]
        self._keep(own[new], counts[new], fresh, (end - start)[first[new]])
        counts = count
        text_of = np.searchsorted(offsets, start, "right") - 1
        return flat, np.bincount(text_of, counts, n).astype(np.int64)


@lru_cache(1)
def encoder_of(path: str) -> PieceEncoder:
    """One for each worker process, which keeps what it knows from task to task."""
    return PieceEncoder(path)


def with_ends(flat: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    """The ids with `end_id` after each text's."""
    out = np.full(len(flat) + len(counts), end_id, np.int64)
    out[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)] = flat
    return out


# ---- files


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def write_shards(docs: DataFrame, tokenizer: str, shard_bytes: int = SHARD_BYTES, end_id: int = END_ID) -> DataFrame:
    """Encode `docs` (doc_id, text; further columns are not read) and write the shards to the shared folder.

    Returns the manifest, a row for each shard: shard, path (without .bin or .idx), docs, tokens, first_doc, last_doc.
    Documents are in ascending doc_id order (null first); repeated doc_ids are kept, ordered by a hash of the text. Null or empty
    text has the end id alone. An empty table gives an empty manifest. `tokenizer` is a path that every executor can
    read, part of the installation. A task that is run again writes files of other names; the manifest names those of
    the run that succeeded.
    """
    spark = docs.sparkSession
    to = new_path(spark, "tokens")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    # rows of one doc_id, however many, may lie in several shards
    dealt = slim.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    schema = "shard int, path string, docs long, tokens long, first_doc long, last_doc long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{to}/shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        encoder = out = None
        ids, counts = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                where, at = _file_system(name)
                where.create_dir(at.rpartition("/")[0], recursive=True)
                encoder, out = encoder_of(tokenizer), where.open_output_stream(f"{at}.bin")
            data, offsets = bytehash.text_buffer(batch.column(1))
            own = batch.column(0)
            ids += [np.array(own.fill_null(-(1 << 63)), np.int64)]
            for a, b in bytehash.slices(offsets, STEP_BYTES):
                flat, n = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out.write(with_ends(flat, n, end_id).astype("<u4" if encoder.wide else "<u2").tobytes())
                counts.append(n + 1)
        if out is None:
            return
        out.close()
        key_ids, lengths = np.concatenate(ids), np.concatenate(counts)
        changed = np.flatnonzero(np.append(True, key_ids[1:] != key_ids[:-1]))
        nth = np.arange(len(key_ids)) - np.repeat(changed, np.diff(np.append(changed, len(key_ids))))
        keys = document_keys(key_ids, nth)
        levels = [Level.of(bits) for bits in build_index(keys)]
        slot = slots(levels, keys)
        print_, offset, length = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u8"), np.zeros(len(keys), "<u8")
        print_[slot], offset[slot], length[slot] = fingerprints(keys), np.cumsum(lengths) - lengths, lengths
        parts = {"doc_id": key_ids.astype("<i8"), "nth": nth.astype("<u4"), "fingerprint": print_, "offset": offset, "length": length}
        parts |= {f"level{k}": bits.words for k, bits in enumerate(levels)} | {f"rank{k}": bits.before for k, bits in enumerate(levels)}
        head = {"dtype": "<u4" if encoder.wide else "<u2", "bits": [x.size for x in levels], "arrays": [[k, v.dtype.str, len(v)] for k, v in parts.items()]}
        with where.open_output_stream(f"{at}.idx") as f:
            f.write(json.dumps(head).encode() + b"\n")
            for v in parts.values():
                f.write(v.tobytes())
        yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "path": name, "docs": len(key_ids), "tokens": int(lengths.sum()), "first_doc": int(key_ids[0]), "last_doc": int(key_ids[-1])}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64())]))

    return stored(dealt.mapInArrow(run, schema), "manifest")


class Shard:
    """A shard's index in memory, and its payload on demand."""

    def __init__(self, path: str):
        self.where, self.at = _file_system(path)
        with self.where.open_input_file(f"{self.at}.idx") as f:
            raw = f.read()
        line = raw.index(b"\n")
        head, place = json.loads(raw[:line]), line + 1
        self.parts, self.dtype = {}, np.dtype(head["dtype"])
        for name, dtype, n in head["arrays"]:
            self.parts[name] = np.frombuffer(raw, dtype, n, place)
            place += self.parts[name].nbytes
        self.levels = [Level(self.parts[f"level{k}"], n, self.parts[f"rank{k}"]) for k, n in enumerate(head["bits"])]

    def find(self, doc_ids: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and length in ids of each document; length -1 for those that aren't here."""
        keys = document_keys(doc_ids, nth)
        slot = slots(self.levels, keys)
        known = slot >= 0
        known[known] = self.parts["fingerprint"][slot[known]] == fingerprints(keys[known])
        offset, length = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        offset[known], length[known] = self.parts["offset"][slot[known]], self.parts["length"][slot[known]]
        return offset, length

    def payload(self):
        return self.where.open_input_file(f"{self.at}.bin")

    def ids(self, doc_id: int, nth: int = 0) -> np.ndarray | None:
        """One document's ids, by one seek; None if it isn't here."""
        offset, length = self.find(np.array([doc_id]), np.array([nth]))
        if length[0] < 0:
            return None
        with self.payload() as f:
            f.seek(int(offset[0]) * self.dtype.itemsize)
            return np.frombuffer(f.read(int(length[0]) * self.dtype.itemsize), self.dtype)


def read_shards(manifest: DataFrame, shards: int) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read from the files through their index.

    The manifest has a row for each shard, so its running sum is small whatever the input.
    """
    start = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("shard", "path", start.alias("start")).repartitionByRange(max(1, shards), "shard")
    names = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shard = Shard(r["path"])
                own = shard.parts["doc_id"]
                offset, length = shard.find(own, shard.parts["nth"])
                if (length < 1).any():
                    raise ValueError(f"{r['path']}: the index doesn't hold all documents")
                size = shard.dtype.itemsize
                crc = np.zeros(len(own), np.int64)
                with shard.payload() as f:
                    for k, (a, n) in enumerate(zip(offset.tolist(), length.tolist())):
                        f.seek(a * size)
                        crc[k] = zlib.crc32(np.frombuffer(f.read(n * size), shard.dtype).astype("<u4").tobytes())
                null = own == -(1 << 63)
                for a in range(0, len(own), 10_000):
                    b = slice(a, a + 10_000)
                    yield pa.RecordBatch.from_arrays([pa.array(own[b], mask=null[b]), pa.array(r["start"] + offset[b]), pa.array(length[b]), pa.array(crc[b])], schema=names)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_tokens(spark, sf_dir):
    """Every document's ids as written to shards and read back from them."""
    import public_tokenizers

    manifest = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(manifest, manifest.count())
