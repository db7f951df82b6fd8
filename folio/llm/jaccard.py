"""N-gram Jaccard join by a token-group matrix.

A document's set holds the 64-bit hashes of its distinct five-word shingles; equal sets are one node, told by 128 bits.

1. Nodes are partitioned into groups of similar ones. Nodes with two smallest shingles in common meet the first node of
   those that do; parity sketches drop most that aren't similar (the bits in which two sketches differ never exceed the
   shingles in which the sets differ), and the others are checked exactly. A group is a component of checked links, so
   a cluster of thousands of near copies is one group by a check or two for each member. What this misses, 2. finds.
2. The token-group matrix has each group's union of shingles, kept by ranges of shingles as blobs. A member that is
   similar to a node of another group has PART / PER of its shingles in unions of other groups at least. So the
   shingles are counted that other groups have, for each group and chunk of documents; only where they are enough the
   chunk's part of the group is opened. A shingle goes into a range once for each chunk and group, and once for all of
   a chunk's groups where several have it: no shingle's rows are in proportion to its documents.
3. Of the opened nodes' shingles those stay that several groups have, rare ones first. Two similar nodes share one of
   the first n - ceil(t * n) + 1 of each. Of shingles that the same nodes have one is enough. Nodes of different groups
   that share such a one are compared by size, by the shingles that they share with others, and by sketches, where they
   meet. Only a forest of those that may be similar leaves the task and is checked exactly; then all whose ends the
   checked links haven't joined.

So no link between groups is lost, and links inside a group change no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import bytehash, common
from folio.llm.common import lookup, mapped
from folio.llm.components import components

WORDS = 5
#: Similarity as a fraction: common * PER >= PART * union.
PART, PER = 75, 100
#: Bytes of text handled at a time; shingles of a chunk, and of a range of the matrix, about.
STEP, CHUNK, RANGE = 1 << 16, 1 << 19, 1 << 19
#: Rows with texts or sets that are sent to Python at a time.
BATCH = 500
#: Nodes of a block of a shingle's nodes, about.
MEET = 1024
#: So many ids are sent to every task instead of shuffling the sets.
FEW = 1_000_000
#: Bands of two smallest shingles by which nodes meet at first.
BANDS = 8
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs [a, b) of a text column: a, b, the texts' sorted distinct shingle hashes, one after the other, and the
    offsets of each text's own."""
    data, offsets = bytehash.text_buffer(column)
    for a, b in bytehash.slices(offsets, STEP):
        # a space after each text, so that no word goes on
        own = np.insert(_LOWER[data[offsets[a] : offsets[b]]], offsets[a + 1 : b + 1] - offsets[a], 32)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ~_SPACE[own], [False]]).astype(np.int8)))
        start, end = edges[::2], edges[1::2]
        text_end = offsets[a + 1 : b + 1] - offsets[a] + np.arange(1, b - a + 1)
        owner = np.searchsorted(text_end, start, "right")
        word = bytehash.pieces(bytehash.prefixes(own), start, end)
        count = np.bincount(owner, minlength=b - a)
        first = np.cumsum(count) - count
        # the hash of a run of words; a text of fewer than WORDS words has one run of all of them
        length = np.minimum(count, WORDS)
        runs = np.where(count > 0, np.maximum(count - WORDS + 1, 1), 0)
        text = np.repeat(np.arange(b - a), runs)
        at = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs) + first[text]
        value = bytehash.mix64(length[text].astype(np.uint64))
        for k in range(WORDS):
            more = k < length[text]
            value[more] = bytehash.mix64(value[more] * np.uint64(0x9E3779B97F4A7C15) + word[at[more] + k])
        order = np.lexsort((value, text))
        value, text = value[order], text[order]
        new = np.append(True, (value[1:] != value[:-1]) | (text[1:] != text[:-1]))[: len(value)]
        value, text = value[new], text[new]
        yield a, b, value, np.concatenate([[0], np.cumsum(np.bincount(text, minlength=b - a))])


def stored(df: DataFrame, name: str) -> DataFrame:
    return common.stored(df, name, BATCH)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum over each run; 0 for an empty one."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full])
    return out


def digests(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """128 bits of each set."""
    both = np.stack([_sums(bytehash.mix64(values + np.uint64(salt)), offsets) for salt in (0xA5A5, 0x3C3C77)], 1)
    return [x.tobytes() for x in both]


def band_keys(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """For each set the hashes of its bands: each the smallest shingles of two of 2 * BANDS ranges, if one has any."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    cell = text * (2 * BANDS) + (values >> np.uint64(60)).astype(np.int64)
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
    least = np.full(n * 2 * BANDS, np.uint64(0xFFFFFFFFFFFFFFFF))
    least[cell[first]] = values[first]
    pair = least.reshape(n, BANDS, 2)
    has = (pair != np.uint64(0xFFFFFFFFFFFFFFFF)).any(2)
    key = bytehash.mix64(bytehash.mix64(pair[:, :, 0] + np.arange(BANDS, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + pair[:, :, 1])
    ends = np.append(0, np.cumsum(has.sum(1)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key[has].view(np.int64)))


def sketch_bits(n: int) -> int:
    """Bits of a parity sketch: twice the set's size or more, a power of two from 128 to 65536."""
    return min(1 << 16, max(128, 1 << int(2 * n - 1).bit_length()))


def sketch(values: np.ndarray) -> bytes:
    bits = sketch_bits(len(values))
    return np.packbits((np.bincount((bytehash.mix64(values + np.uint64(0x5A5A)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(raw: bytes, bits: int) -> np.ndarray:
    """The sketch of fewer bits, which is that of the same set, as 64-bit words."""
    words = np.frombuffer(raw, np.uint64)
    while len(words) * 64 > bits:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def may_link(n: np.ndarray, m: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m that differ in `differ` shingles at least can be similar: the sum of the sizes is
    union + common, and the union less the common part is what differs."""
    total = n + m
    # common <= (total - differ) / 2, union = total - common
    return PER * (total - differ) >= PART * (total + differ)


def shingle_table(docs: DataFrame) -> DataFrame:
    """rid (unique), doc_id, n, digest, keys, sketch, shingles (sorted 64-bit hashes, binary) of each row of `docs`."""
    names = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for a, b, values, offsets in shingle_sets(batch.column(1)):
                own = [values[offsets[k] : offsets[k + 1]] for k in range(b - a)]
                columns = [
                    pa.array(np.arange(rid, rid + b - a)), batch.column(0)[a:b], pa.array(np.diff(offsets)), pa.array(digests(values, offsets), pa.binary()),
                    band_keys(values, offsets), pa.array(map(sketch, own), pa.binary()), pa.array([x.tobytes() for x in own], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=names)
                rid += b - a

    schema = "rid long, doc_id long, n long, digest binary, keys array<long>, sketch binary, shingles binary"
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, d: those of `pairs` (a, b; distinct) whose sizes and sketches allow the similarity, and the bits in which
    their sketches differ. nodes: node, n, sketch."""
    names = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(1).to_numpy(), batch.column(4).to_numpy()
            differ = np.abs(n - m)
            keep = np.flatnonzero(may_link(n, m, differ))
            for k in keep.tolist():
                x, y = batch.column(2)[k].as_py(), batch.column(5)[k].as_py()
                bits = 8 * min(len(x), len(y))
                differ[k] = max(differ[k], int(np.bitwise_count(fold(x, bits) ^ fold(y, bits)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(differ)], schema=names).filter(pa.array(may_link(n, m, differ)))

    of = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = lookup(lookup(pairs.select("a", "b"), of("b"), "b"), of("a"), "a")
    return mapped(both.select("a", "na", "sa", "b", "nb", "sb"), run, "a long, b long, d long")


def check_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b; distinct) whose sets are similar; sets: rid, shingles."""
    names = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in (2, 3))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(PER * common >= PART * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=names).filter(pa.array(keep, pa.bool_()))

    few = F.broadcast if pairs.count() <= FEW else (lambda x: x)
    one = sets.select(F.col("rid").alias("b"), F.col("shingles").alias("sb")).join(few(pairs.select("a", "b")), "b")
    two = sets.select(F.col("rid").alias("a"), F.col("shingles").alias("sa")).join(few(pairs.select("a").distinct()), "a", "left_semi")
    return mapped(lookup(one, two, "a", pairs).select("a", "b", "sa", "sb"), run, "a long, b long")


def groups(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: exactly checked links that join most similar nodes (node, n, sketch, keys); see 1. of the module."""
    met = nodes.select("node", F.explode("keys").alias("key"))
    firsts = met.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    pairs = lookup(met, firsts.select("key", "a"), "key", firsts).where("a < node").select("a", F.col("node").alias("b")).distinct()
    close = stored(near(stored(pairs, "met"), nodes), "near")
    # the closest first; of the others those whose ends aren't joined by then
    best = close.groupBy("b").agg(F.min(F.struct("d", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    links = stored(check_pairs(stored(best, "closest"), sets), "links")
    label = components(links)
    open_ = close.join(best, ["a", "b"], "left_anti")
    for c in "ab":
        open_ = open_.join(label.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    # one pair for each two groups and end is enough to try; the rest is found by the matrix
    more = stored(open_.where("ra != rb").groupBy("ra", "b").agg(F.min(F.struct("d", "a")).alias("m")).select(F.col("m.a").alias("a"), "b"), "closer")
    return links.unionByName(stored(check_pairs(more, sets), "links"))


def matrix_ranges(members: DataFrame, bits: int) -> DataFrame:
    """The token-group matrix by chunks of documents and ranges of shingles. members: rid, group, alone (is the group's
    only node), n, shingles.

    A chunk's documents of one group are a unit. Each row has a chunk's part of one range (the first `bits` bits of its
    shingles): of the shingles that one unit of the chunk has the next 32 bits, by units (`low`, `counts`); of those
    that several have, which are known to be shared, the 32 bits once (`told`); and the groups of the units that aren't
    alone. One more row of each chunk has its documents, their units, and for each unit its smallest set and the number
    of shingles that it shares with others of the chunk (`rids`, `counts`, `low`, `told`)."""
    columns = ["range", "chunk", "head", "units", "low", "counts", "told", "rids", "at", "groups"]
    kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int32(), *[pa.binary()] * 6]
    names = pa.schema(list(zip(columns, kinds)))

    def cut(rid, group, alone, n, arrays) -> Iterator[pa.RecordBatch]:
        named, unit = np.unique(group, return_inverse=True)
        units = len(named)
        value, owner = np.concatenate(arrays), np.repeat(unit, n)
        order = np.lexsort((owner, value)) if units < len(rid) else np.argsort(value)
        value, owner = value[order], owner[order]
        new = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))
        value, owner = value[new], owner[new]
        like = value[1:] == value[:-1]
        several = np.append(False, like) | np.append(like, False)
        told = np.unique(value[several])
        shared = np.bincount(owner[several], minlength=units)
        value, owner = value[~several], owner[~several]
        smallest = np.full(units, 1 << 62)
        np.minimum.at(smallest, unit, n)
        crowd = np.zeros(units, bool)
        crowd[unit[~alone]] = True
        at = np.flatnonzero(crowd)
        chunk, rows = int(rid[0]), []
        row = lambda r, head, *parts: dict(zip(columns, (r, chunk, head, units, *(p.tobytes() for p in parts))))
        rows.append(row(int(bytehash.mix64(np.array([chunk], np.uint64))[0] >> np.uint64(64 - bits)), True, smallest, unit.astype(np.uint32), shared, rid, at[:0], named[:0]))
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        a, t = (np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in (value, told))
        low = lambda x: ((x >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for r in range(1 << bits):
            v, u, say = value[a[r] : a[r + 1]], owner[a[r] : a[r + 1]], told[t[r] : t[r + 1]]
            if not len(v) and not len(say):
                continue
            counts = np.bincount(u, minlength=units)
            counts = counts.astype(np.min_scalar_type(int(counts.max())))
            rows.append(row(r, False, low(v[np.argsort(u, kind="stable")]), counts, low(say), rid[:0], at.astype(np.uint32), named[at]))
            if len(rows) >= 16:
                yield pa.RecordBatch.from_pylist(rows, names)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            rid, group, alone, n, arrays = zip(*held)
            return cut(np.array(rid), np.array(group), np.array(alone), np.array(n), arrays)

        for batch in batches:
            for k in range(batch.num_rows):
                values = np.frombuffer(batch.column(4)[k].as_buffer(), np.uint64)
                held.append((*(batch.column(c)[k].as_py() for c in range(4)), values))
                size += len(values)
                if size >= CHUNK:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    schema = "range int, chunk long, head boolean, units int, low binary, counts binary, told binary, rids binary, at binary, groups binary"
    return mapped(members.select("rid", "group", "alone", "n", "shingles"), run, schema)


def open_units(ranges: DataFrame, parts: int) -> DataFrame:
    """rid: the nodes of those units that may have a member similar to a node of another group."""

    def whole(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[dict]]:
        """Rows by their key, which they are sorted by."""
        held: list[dict] = []
        for batch in batches:
            name = batch.schema.field(key).name
            for row in batch.to_pylist():
                if held and held[-1][name] != row[name]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    answer = pa.schema([("chunk", pa.int64()), ("units", pa.int32()), ("shared", pa.binary()), ("smallest", pa.binary()), ("unit", pa.binary()), ("rids", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole(batches, 0):
            out = [{"chunk": r["chunk"], "units": r["units"], "shared": r["told"], "smallest": r["low"], "unit": r["counts"], "rids": r["rids"]} for r in rows if r["head"]]
            rows = [r for r in rows if not r["head"]]
            if rows:
                base = np.cumsum([0] + [r["units"] for r in rows])
                who = np.arange(base[-1])  # a number for each group
                at = np.concatenate([np.frombuffer(r["at"], np.uint32).astype(np.int64) + b for r, b in zip(rows, base)])
                named = np.concatenate([np.frombuffer(r["groups"], np.int64) for r in rows])
                _, first, again = np.unique(named, return_index=True, return_inverse=True)
                who[at] = at[first[again]] if len(at) else at
                counts = np.concatenate([np.frombuffer(r["counts"], f"<u{len(r['counts']) // r['units']}").astype(np.int64) for r in rows])
                unit, value = np.repeat(np.arange(base[-1]), counts), np.concatenate([np.frombuffer(r["low"], np.uint32) for r in rows])
                told = np.unique(np.concatenate([np.frombuffer(r["told"], np.uint32) for r in rows]))
                order = np.argsort(value, kind="stable")
                value, unit = value[order], unit[order]
                run = np.cumsum(np.append(False, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
                several = np.zeros(int(run[-1]) + 1 if len(run) else 0, bool)
                group = who[unit]
                several[run[1:][(run[1:] == run[:-1]) & (group[1:] != group[:-1])]] = True
                if len(told) and len(value):
                    place = np.minimum(np.searchsorted(told, value), len(told) - 1)
                    several[run[told[place] == value]] = True
                shared = np.bincount(unit[several[run]], minlength=base[-1])
                out += [{"chunk": r["chunk"], "units": r["units"], "shared": shared[a:b].tobytes()} for r, a, b in zip(rows, base, base[1:]) if shared[a:b].any()]
            yield pa.RecordBatch.from_pylist(out, answer)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole(batches, 0):
            shared = sum(np.frombuffer(r["shared"], np.int64) for r in rows)
            head = next(r for r in rows if r["rids"] is not None)
            go = PER * shared >= PART * np.frombuffer(head["smallest"], np.int64)
            rid = np.frombuffer(head["rids"], np.int64)[go[np.frombuffer(head["unit"], np.uint32)]]
            yield pa.RecordBatch.from_arrays([pa.array(rid)], names=["rid"])

    counted = mapped(ranges.repartition(parts, "range").sortWithinPartitions("range"), count, "chunk long, units int, shared binary, smallest binary, unit binary, rids binary")
    return mapped(counted.repartition("chunk").sortWithinPartitions("chunk"), decide, "rid long")


def deciding(members: DataFrame) -> DataFrame:
    """shingle, node, n, has, many: the shingles of the opened nodes that decide, by 3. of the module, how many of a node's
    other groups have, and how many nodes have the shingle. members: rid, group, n, shingles of the opened nodes."""
    row = pa.schema([("shingle", pa.int64()), ("node", pa.int64()), ("group", pa.int64()), ("n", pa.int64())])

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, group, n = (batch.column(k).to_numpy() for k in range(3))
            for k in range(batch.num_rows):
                values = np.frombuffer(batch.column(3)[k].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values), *(pa.array(np.full(len(values), x[k])) for x in (rid, group, n))], schema=row)

    rows = stored(mapped(members.select("rid", "group", "n", "shingles"), flat, "shingle long, node long, group long, n long"), "opened")
    by_group = rows.groupBy("shingle", "group").agg(F.count(F.lit(1)).alias("_n"))
    often = by_group.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.sum("_n").alias("_n")).where("df > 1")
    shared = lookup(rows, often.select("shingle", "df"), "shingle", often)
    own = Window.partitionBy("node")
    shared = shared.select("*", F.row_number().over(own.orderBy("df", "shingle")).alias("nth"), F.count(F.lit(1)).over(own).alias("has"))
    least = F.ceil(F.col("n") * PART / PER)
    decide = stored(shared.where(F.col("nth") <= F.col("has") - least + 1).select("shingle", "node", "n", "has"), "decide")
    # shingles of the same nodes count once; their nodes are told by a sum of hashes and their number
    held = decide.groupBy("shingle").agg(F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("who"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    one = stored(held.groupBy("who", "_n").agg(F.min("shingle").alias("shingle")), "shingles")
    return lookup(decide, one.select("shingle", F.col("_n").alias("many")), "shingle", one).select("shingle", "node", "n", "has", "many")


class Joined:
    """Which nodes a task's own pairs have joined so far."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}

    def of(self, nodes: np.ndarray) -> np.ndarray:
        out = np.empty(len(nodes), np.int64)
        for k, x in enumerate(nodes.tolist()):
            while x in self.root:
                x = self.root[x]
            out[k] = x
        return out

    def forest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of the pairs that join what wasn't joined; a pair for each smaller root a round."""
        left, out = np.arange(len(a)), [np.zeros(0, np.int64)]
        while len(left):
            nodes, at = np.unique(np.concatenate([a[left], b[left]]), return_inverse=True)
            x, y = np.split(self.of(nodes)[at], 2)
            apart = x != y
            left, low, high = left[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            _, first = np.unique(high, return_index=True)
            self.root.update(zip(high[first].tolist(), low[first].tolist()))
            out.append(left[first])
            left = np.delete(left, first)
        return np.concatenate(out)


def meet(decide: DataFrame, nodes: DataFrame, label: DataFrame, all_pairs: bool) -> DataFrame:
    """a, b (a < b): pairs of nodes of different groups that share a deciding shingle and may be similar: a forest of them
    for each task, or `all_pairs`. decide: shingle, node, n, has, many; nodes: node, sketch; label: node, group, for nodes
    that aren't alone in their group. A shingle's nodes are dealt to blocks of MEET about, and every two blocks meet in a
    task of their own, so a task holds two blocks of sketches however many nodes a shingle has."""
    names = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def near_pairs(node, group, n, has, sketches, block, two) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of one shingle's nodes: all pairs by the sketch bits of the one with fewer, a strip of nodes at a time; with
        `two` blocks those of a node of each."""
        bits = np.array([8 * len(x) for x in sketches])
        out = []
        for own in np.unique(bits):
            rows, others = np.flatnonzero(bits == own), np.flatnonzero(bits >= own)
            others = others[n[others] * PART <= n[rows].max() * PER]
            words = np.stack([fold(sketches[k], int(own)) for k in others])
            place = np.searchsorted(others, rows)
            step = max(1, (1 << 21) // max(1, words.size))
            for k in range(0, len(rows), step):
                i, w = rows[k : k + step], words[place[k : k + step]]
                most = np.minimum(has[i][:, None], has[others][None, :])
                both = n[i][:, None] + n[others][None, :]
                ok = (group[i][:, None] != group[others][None, :]) & (PER * most >= PART * (both - most)) & ((bits[others] > own)[None, :] | (node[i][:, None] < node[others][None, :]))
                if two:
                    ok &= block[i][:, None] != block[others][None, :]
                x, y = np.nonzero(ok)
                differ = np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(w[x[c : c + 65536]] ^ words[y[c : c + 65536]]).sum(1).astype(np.int64) for c in range(0, len(x), 65536))])
                keep = may_link(n[i[x]], n[others[y]], differ)
                out.append((i[x[keep]], others[y[keep]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, rows, now = Joined(), [], None

        def finish() -> pa.RecordBatch:
            node, n, has, sketches, group, block = zip(*rows)
            node = np.array(node, np.int64)
            i, j = (np.concatenate(c) for c in zip(*near_pairs(node, np.array(group, np.int64), np.array(n, np.int64), np.array(has, np.int64), sketches, np.array(block, np.int64), now[1] != now[2])))
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            if not all_pairs:
                chosen = joined.forest(a, b)
                a, b = a[chosen], b[chosen]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=names)

        for batch in batches:
            for *key, node, n, has, sketch_, group, block in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now and len(rows) > 1:
                    yield finish()
                if key != now:
                    now, rows = key, []
                rows.append((node, n, has, sketch_, group, block))
        if len(rows) > 1:
            yield finish()

    told = lookup(decide, nodes.select("node", "sketch"), "node").join(label, "node", "left")
    blocks = F.ceil(F.col("many") / MEET).cast("int")
    own = F.pmod(F.xxhash64(F.lit(17), "node"), blocks).cast("int")
    placed = told.select("*", own.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    placed = placed.select("shingle", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "n", "has", "sketch", F.coalesce("group", "node").alias("group"), "block")
    dealt = placed.repartition("shingle", "low", "high").sortWithinPartitions("shingle", "low", "high")
    return mapped(dealt, run, "a long, b long").distinct()


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs` (doc_id, text; further columns are not read).

    Words are runs of other than ASCII white space, A-Z lower-cased. Null, empty and wordless texts have no shingle and
    link with nothing: their component is their own doc_id. Rows without a doc_id take part, and count for nothing in
    the smallest doc_id. Repeated rows are reported each. An empty table gives an empty result.
    """
    known = stored(shingle_table(docs), "sets")
    full = known.where("n > 0")
    equal = full.groupBy("digest").agg(F.min("rid").alias("node"), F.min("doc_id").alias("first"), F.first("n").alias("n"), F.count(F.lit(1)).alias("_n"))
    equal = stored(equal, "equal")
    members = stored(lookup(full.select("rid", "doc_id", "digest"), equal.select("digest", "node", "n"), "digest", equal).select("rid", "doc_id", "n", "node"), "members")
    nodes = stored(full.select(F.col("rid").alias("node"), "n", "sketch", "keys").join(equal.select("node"), "node", "left_semi"), "nodes")
    sets = known.select("rid", "n", "shingles")
    links = stored(groups(nodes, sets), "links")
    label = stored(components(links).select("node", F.col("root").alias("group")), "groups")
    # nodes that aren't alone in their group, and copies of nodes, which the matrix leaves out
    tags = label.select(F.col("node").alias("rid"), "group").unionByName(members.where("rid != node").select("rid", F.lit(-1).cast("long").alias("group")))
    tags = stored(tags, "tags")
    few = F.broadcast if tags.count() <= FEW else (lambda x: x)
    tagged = sets.where("n > 0").join(few(tags), "rid", "left").where("coalesce(group, 0) >= 0")
    tagged = tagged.select("rid", F.coalesce("group", "rid").alias("group"), F.col("group").isNull().alias("alone"), "n", "shingles")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    bits = max(5, (total // RANGE).bit_length())
    opened = stored(open_units(matrix_ranges(tagged, bits), 1 << bits), "open")
    few = F.broadcast if opened.count() <= FEW else (lambda x: x)
    decide = stored(deciding(tagged.join(few(opened), "rid", "left_semi")), "decide")
    tried = None
    for all_pairs in (False, True):
        pairs = meet(decide, nodes, label, all_pairs)
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "across")
        if not pairs.limit(1).count():
            break
        found = stored(check_pairs(pairs, sets), "links")
        links, tried = links.unionByName(found), pairs
        label = stored(components(links).select("node", F.col("root").alias("group")), "groups")
    label = label.withColumnRenamed("group", "root")
    rooted = equal.join(label, "node", "left").select("node", "first", "_n", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    of_node = stored(lookup(rooted.select("node", "root"), least.select("root", "component_id"), "root", least).select("node", "component_id"), "components")
    out = lookup(members, of_node, "node", equal.select("node", "_n")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(known.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op5_jaccard(spark, sf_dir):
    """Of every document its set's size and the smallest doc_id that it is linked to, by any number of steps."""
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))
