"""Reading orders of a page's blocks: cuts with edges snapped and full-width splits, gaps between columns, and rows and
columns by overlap; with a driver that falls back from one to the next.

A page holds a bounded number of blocks, so each method works on one page's boxes in Python; whole batches of pages come
by Arrow. Ties go by the order given. A method that would lose a block says so (None), and the driver tries the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from folio.functions.kinds import MARGIN
from folio.operators.order import xy_cut

Box = tuple[float, float, float, float]
#: Pixels within which edges are one; parts of the content's width that a rule and a group must have to split a page.
STICKY, RULE, GROUP, GROUP_SEQUENTIAL, LEAST_WIDTH = 5, 0.5, 0.5, 0.6, 0.6
#: Overlap from which boxes share a row or column; how near bands are, and columns of bands, and their overlap.
SHARE, NEAR, NEAR_COLUMN, SAME_COLUMN = 0.1, 0.03, 0.02, 0.8


def snapped(values: list[float], reach: int = STICKY) -> list[int]:
    """Coordinates on one axis, those in a chain of steps of `reach` at most as one: the most frequent value of the
    chain, the whole part of the mean where several are."""
    out = [0] * len(values)
    chain: list[int] = []

    def close() -> None:
        own = [values[i] for i in chain]
        most = max(map(own.count, own))
        usual = sorted({v for v in own if own.count(v) == most})
        for i in chain:
            out[i] = int(sum(usual) / len(usual))

    for i in sorted(range(len(values)), key=values.__getitem__):
        if chain and values[i] - values[chain[-1]] > reach:
            close()
            chain = []
        chain.append(i)
    if chain:
        close()
    return out


def pixels(boxes: list[Box], width: int, height: int) -> list[tuple[int, int, int, int]]:
    """Relative boxes as whole pixels with snapped edges, two pixels less high at both ends where a pixel stays; a box
    without an area gets a pixel each way."""
    size = (width, height, width, height)
    edges = [snapped([b[k] * size[k] for b in boxes]) for k in range(4)]
    out = []
    for x1, y1, x2, y2 in zip(*edges):
        less = max(0, min(2, (y2 - y1 - 1) // 2))
        y1, y2 = y1 + less, y2 - less
        grow = int((x2 - x1) * (y2 - y1) <= 0)
        out.append((x1, y1, x2 + grow, y2 + grow))
    return out


def profile_runs(ids: list[int], boxes: list, axis: int, gap: float) -> list[list[int]]:
    """ids in runs along an axis, in order of their starts: a run ends where no box covers `gap` pixels or more."""
    runs: list[list[int]] = []
    reach = 0.0
    for i in sorted(ids, key=lambda i: (boxes[i][axis], i)):
        if runs and boxes[i][axis] - reach + 1 <= gap:
            runs[-1].append(i)
            reach = max(reach, boxes[i][axis + 2])
        else:
            runs.append([i])
            reach = boxes[i][axis + 2]
    return runs


def cut_expanded(boxes: list, line: float = 1, primary: str = "y", sequential: bool = False, splits: tuple[int, ...] = ()) -> list[int] | None:
    """Whole-pixel boxes in reading order by runs along one axis and, inside each, along the other.

    sequential: of more than two runs the first is taken and the others are one. splits: heights at which the whole page
    is cut instead of by its gaps, on the first level only; below it columns come first. None if a block falls between
    two splits.
    """
    gaps = {0: 1.0, 1: float(line)}

    def parts(ids: list[int], axis: int, at: tuple[int, ...]) -> list[list[int]]:
        runs = profile_runs(ids, boxes, axis, gaps[axis])
        if axis == 1 and at and len(runs) > (0 if axis == first else 1):
            bounds = [*zip((0, *at), (s - 1 for s in at)), (at[-1], max(boxes[i][3] for i in ids))]
            order = [i for run in runs for i in run]
            return [[i for i in order if a <= boxes[i][1] < b] for a, b in bounds]
        if sequential and len(runs) > 2:
            return [runs[0], [i for run in runs[1:] for i in run]]
        return runs

    first = 1 if primary == "y" else 0
    out: list[int] = []

    def visit(ids: list[int], axis: int, at: tuple[int, ...]) -> None:
        for part in parts(ids, axis, at):
            if not part:
                continue
            across = profile_runs(part, boxes, 1 - axis, gaps[1 - axis])
            if len(across) == 1:
                out.extend(across[0])
                continue
            for inner in parts(part, 1 - axis, at):
                if inner and len(inner) < len(ids):
                    visit(inner, 0, ())
                else:
                    out.extend(inner)

    visit(list(range(len(boxes))), first, tuple(splits))
    return out if sorted(out) == list(range(len(boxes))) else None


def page_splits(boxes: list[Box], kinds: list[str], height: int, sequential: bool) -> tuple[int, ...]:
    """Heights of rules and of groups' edges that go over enough of the content's width."""
    content = max(LEAST_WIDTH, max(b[2] for b in boxes) - min(b[0] for b in boxes))
    at: list[int] = []
    for b, kind in zip(boxes, kinds):
        wide = b[2] - b[0]
        if kind == "hline" and wide > RULE * content:
            at.append(int(b[1] * height))
        elif kind == "group" and wide > (GROUP_SEQUENTIAL if sequential else GROUP) * content:
            at += [int(b[1] * height), int(b[3] * height)]
    return tuple(sorted(at))


# ---- gaps between columns


@dataclass
class Region:
    """Blocks one below the other between two gaps; `top` and `bottom` are rows."""

    left: float
    right: float
    top: int
    bottom: int
    blocks: list[int] = field(default_factory=list)
    below: list[Region] = field(default_factory=list)


def block_rows(boxes: list[Box]) -> list[list[int]]:
    """Blocks by rows: the topmost that is left, and those after it that begin at its bottom or above; each row from left
    to right."""
    rows: list[list[int]] = []
    floor = 0.0
    for i in sorted(range(len(boxes)), key=lambda i: boxes[i][1]):
        if rows and boxes[i][1] <= floor:
            rows[-1].append(i)
        else:
            rows.append([i])
            floor = boxes[i][3]
    return [sorted(r, key=lambda i: (boxes[i][0], boxes[i][2])) for r in rows]


def page_gaps(boxes: list[Box], rows: list[list[int]]) -> list[list[tuple[float, float]]]:
    """For each row the gaps that bound its columns, from left to right. A gap goes on in the next row with what it has in
    common with that row's gaps, so every row of it has the narrowest interval; the page's sides count as gaps."""
    low, high = min(b[0] for b in boxes) - 1, max(b[2] for b in boxes) + 1
    live: list[tuple[float, float, int]] = []
    done: list[tuple[float, float, int, int]] = []
    for r, row in enumerate(rows):
        own, reach = [], low
        for i in row:
            if boxes[i][0] > reach:
                own.append((reach, boxes[i][0]))
            reach = max(reach, boxes[i][2])
        own.append((reach, high))
        kept = [[(max(a, c), min(b, d), start) for c, d in own if max(a, c) <= min(b, d)] for a, b, start in live]
        done += [(*gap, r - 1) for gap, on in zip(live, kept) if not on]
        new = [(c, d, r) for c, d in own if not any(max(a, c) <= min(b, d) for a, b, _ in live)]
        live = [gap for on in kept for gap in on] + new
    done += [(*gap, len(rows) - 1) for gap in live]
    done.sort(key=lambda gap: gap[0])
    return [[(a, b) for a, b, first, last in done if first <= r <= last] for r in range(len(rows))]


def regions(boxes: list[Box]) -> list[Region]:
    """The page's regions in reading order. A region goes on while gaps bound it at exactly its edges and none cuts into
    it; below it come the regions that begin under its right edge, from left to right."""
    rows = block_rows(boxes)
    gaps = page_gaps(boxes, rows)
    root = Region(min(g[0][0] for g in gaps) - 1, max(g[-1][1] for g in gaps) + 1, -1, -1)
    ended, live = [], []
    for r, row in enumerate(rows):
        starts, stops = {a for a, _ in gaps[r]}, {b for _, b in gaps[r]}
        going = []
        for region in live:
            inside = any(region.left < edge < region.right for gap in gaps[r] for edge in gap)
            if region.left in stops and region.right in starts and not inside:
                region.bottom = r
                going.append(region)
            else:
                ended.append(region)
        live, at = going, 0
        for i in row:
            while boxes[i][0] + 1e-4 > gaps[r][at + 1][0]:
                at += 1
            sides = gaps[r][at][1], gaps[r][at + 1][0]
            own = next((x for x in live if (x.left, x.right) == sides), None)
            if own is None:
                own = Region(*sides, r, r)
                live.append(own)
            own.blocks.append(i)
    ended += live
    # the region above is the lowest, then rightmost one that ends higher up and reaches over the right edge
    lowest = sorted([root, *ended], key=lambda e: (-e.bottom, -e.right))
    for region in ended:
        edge = region.right - 2
        next(e for e in lowest if e.bottom < region.top and e.left <= edge <= e.right + 1e-4).below.append(region)
    out, todo = [], [root]
    while todo:
        region = todo.pop()
        out.append(region)
        todo += sorted(region.below, key=lambda e: e.left)[::-1]
    return [r for r in out if r.blocks]


def gap_tree(boxes: list[Box]) -> list[int] | None:
    """Blocks region by region, in each from top to bottom; None where a row's gaps don't hold its blocks."""
    try:
        found = regions(boxes)
    except IndexError:
        return None
    out = [i for r in found for i in sorted(r.blocks, key=lambda i: boxes[i][1])]
    return out if sorted(out) == list(range(len(boxes))) else None


# ---- rows and columns by overlap


def overlap_groups(ids: list[int], boxes: list[Box], axis: int, share: float = SHARE) -> list[list[int]]:
    """Connected groups of blocks that overlap on an axis by more than `share` of the smaller one, in order of the start
    of each group's first member."""
    left, groups = list(ids), []
    while left:
        group, todo = [], [left.pop(0)]
        while todo:
            i = todo.pop()
            group.append(i)
            near = [j for j in left if min(boxes[i][axis + 2], boxes[j][axis + 2]) - max(boxes[i][axis], boxes[j][axis]) > share * min(boxes[i][axis + 2] - boxes[i][axis], boxes[j][axis + 2] - boxes[j][axis])]
            left = [j for j in left if j not in near]
            todo += near
        groups.append(sorted(group, key=ids.index))
    return sorted(groups, key=lambda g: boxes[g[0]][axis])


@dataclass
class Band:
    """Blocks, and how they divide along the band's axis (none: not at all)."""

    ids: list[int]
    axis: int
    parts: list[Band]

    @property
    def columns(self) -> int:
        return max(1, len(self.parts))


def bands(ids: list[int], boxes: list[Box], axis: int, stuck: bool = False) -> Band:
    """Divides blocks along one axis and then the other, until neither divides them."""
    if len(ids) < 2:
        return Band(ids, axis, [])
    groups = overlap_groups(ids, boxes, axis)
    if stuck and len(groups) == 1:
        return Band(ids, axis, [])
    return Band(ids, axis, [bands(g, boxes, 1 - axis, len(groups) == 1) for g in groups])


def naive(boxes: list[Box], mode: str = "col") -> list[int]:
    """Blocks by columns of rows (mode `col`) or rows of columns. Neighbouring rows with as many columns that lie below
    each other are read column by column."""

    def bounds(band: Band) -> Box:
        own = [boxes[i] for i in band.ids]
        return min(b[0] for b in own), min(b[1] for b in own), max(b[2] for b in own), max(b[3] for b in own)

    def over(a: Box, b: Box, axis: int) -> float:
        return min(a[axis + 2], b[axis + 2]) - max(a[axis], b[axis])

    def near(row: Band, last: Band, columns: int) -> bool:
        """Whether a row goes on below the last one of a stack of so many columns."""
        below = over(bounds(row), bounds(last), 1) > -NEAR
        if row.columns == 1:
            return below
        if row.columns != columns:
            return False
        if last.columns == 1 and below:
            return True
        pairs = [(bounds(a), bounds(b)) for a, b in zip(row.parts, last.parts)]
        return row.columns == last.columns and all(over(a, b, 0) >= SAME_COLUMN * min(a[2] - a[0], b[2] - b[0]) and over(a, b, 1) >= -NEAR_COLUMN for a, b in pairs)

    def stacks(rows: list[Band]) -> list[int]:
        """The stack that each row is in."""
        step = lambda held, row: (held[0], held[1], row) if near(row, held[2], held[1]) else (held[0] + 1, row.columns, row)
        return [stack for stack, _, _ in accumulate(rows[1:], step, initial=(0, rows[0].columns, rows[0]))]

    def keys(band: Band, key: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], int]]:
        """Each block with what it is read by: its stack, column and row, at every level."""
        if not band.parts:
            yield from (((*key, k), i) for k, i in enumerate(band.ids))
        elif band.axis == 0:
            for column, part in enumerate(band.parts):
                yield from keys(part, (*key, column))
        else:
            for nth, (row, stack) in enumerate(zip(band.parts, stacks(band.parts))):
                for column, part in enumerate(row.parts if row.columns > 1 else [row]):
                    yield from keys(part, (*key, stack, column, nth))

    return [i for _, i in sorted(keys(bands(list(range(len(boxes))), boxes, 0 if mode == "col" else 1)))]


# ---- drivers


def _turned(boxes: list[Box]) -> list[Box]:
    return [(1 - c, 1 - d, 1 - a, 1 - b) for a, b, c, d in boxes]


def ordered(boxes: list[Box], kinds: list[str], method: str, width: int, height: int, reverse: bool = False, line: float = 0, primary: str = "y", sequential: bool = False) -> list[int] | None:
    """Indices of relative boxes in reading order by naive, gap_tree, xy_cut or xy_cut_exp; with `reverse` the page is
    read upside down and from the end. line: pixels between bands, 0 for the page's least line height."""
    if method not in ("naive", "gap_tree", "xy_cut", "xy_cut_exp"):
        raise ValueError(f"unknown method: {method}")
    if len(boxes) < 2:
        return list(range(len(boxes)))
    own = _turned(boxes) if reverse else boxes
    if method == "naive":
        out: list[int] | None = naive(own)
    elif method == "gap_tree":
        out = gap_tree(own)
    else:
        heights = [(b[3] - b[1]) * height for b, kind in zip(own, kinds) if kind != "hline"]
        line = line or max(1.0, min([max(height / 80, 10.0), *heights]))
        px = pixels(own, width, height)
        if method == "xy_cut":
            out = xy_cut(px, line)
        else:
            out = cut_expanded(px, line, primary, sequential, page_splits(own, kinds, height, sequential))
    return out[::-1] if out and reverse else out


def page_order(boxes: list[Box], kinds: list[str], method: str, width: int, height: int, sequential: bool) -> tuple[list[int], str]:
    """All of a page's blocks and the method that ordered its content.

    Content is ordered by the method, else gap_tree, else naive; after it comes the margin, by cuts. Rules above or below
    all content go to the margin; page bars that aren't at a side take part in the content's order, but stand in the
    margin.
    """
    margin = [i for i, k in enumerate(kinds) if k in MARGIN]
    body = [i for i, k in enumerate(kinds) if k not in MARGIN and k != "hline"]
    rules = [i for i, k in enumerate(kinds) if k == "hline"]
    if body:
        top, bottom = min(boxes[i][1] for i in body), max(boxes[i][3] for i in body)
        outside = [i for i in rules if boxes[i][3] < top or boxes[i][1] > bottom]
        margin += outside
        rules = [i for i in rules if i not in outside]
    bars = [i for i in margin if kinds[i] == "pagebar" and not (boxes[i][2] < 0.25 or boxes[i][0] > 0.75)]
    body = sorted(body + rules + bars)
    margin = [i for i in margin if i not in bars]
    found, used = body, "none"
    methods = ["gap_tree", "naive"] if method in ("gap_tree", "naive") else [method, "gap_tree", "naive"]
    for name in methods:
        more = {"line": 1, "primary": "x", "sequential": sequential} if name == "xy_cut_exp" else {}
        out = ordered([boxes[i] for i in body], [kinds[i] for i in body], name, width, height, **more)
        if out is not None:
            found, used = [body[i] for i in out], name
            break
    margin += [i for i in found if i in bars]
    last = ordered([boxes[i] for i in margin], [kinds[i] for i in margin], "xy_cut", width, height) or []
    return [i for i in found if i not in bars] + [margin[i] for i in last], used


def _by_page(blocks: DataFrame, extra: list, place: Callable[..., tuple[list[int], str]]) -> DataFrame:
    """token, page, block, place, method by a function of a page's boxes, types and the extra columns."""

    @pandas_udf("order array<int>, method string")
    def run(pages: pd.Series, *more: pd.Series) -> pd.DataFrame:
        rows = []
        for page, *rest in zip(pages, *more):
            order, used = place([(b["x1"], b["y1"], b["x2"], b["y2"]) for b in page], [b["type"] for b in page], *rest)
            rank = [0] * len(page)
            for n, i in enumerate(order):
                rank[i] = n
            rows.append((rank, used))
        return pd.DataFrame(rows, columns=["order", "method"])

    cell = F.struct("block", "x1", "y1", "x2", "y2", "type")
    page = blocks.groupBy("token", "page").agg(F.array_sort(F.collect_list(cell)).alias("b"), *extra)
    names = [c for c in page.columns if c not in ("token", "page", "b")]
    placed = page.withColumn("o", run("b", *names))
    zipped = F.arrays_zip(F.transform("b", lambda e: e["block"]).alias("block"), F.col("o.order").alias("place"))
    return placed.select("token", "page", F.explode(zipped).alias("z"), F.col("o.method").alias("method")).select("token", "page", F.col("z.block").alias("block"), F.col("z.place").alias("place"), "method")


def reading_orders(blocks: DataFrame, method: str = "xy_cut_exp", width: int = 1024, height: int = 1024, reverse: bool = False) -> DataFrame:
    """token, page, block, place (from 0), method of all blocks by one method; `none` and the given order where it fails."""

    def place(boxes: list[Box], kinds: list[str]) -> tuple[list[int], str]:
        out = ordered(boxes, kinds, method, width, height, reverse)
        return (out, method) if out is not None else (list(range(len(boxes))), "none")

    return _by_page(blocks, [], place)


def sorted_pages(blocks: DataFrame, columns: DataFrame, method: str = "xy_cut_exp", width: int = 1024, height: int = 1024) -> DataFrame:
    """token, page, block, place, method of all blocks by `page_order`. columns: token, page, columns (their type); pages of
    other than single_1 are read one part after the other."""
    typed = blocks.join(columns.select("token", "page", "columns"), ["token", "page"], "left")
    return _by_page(typed, [F.coalesce(F.first("columns"), F.lit("single_1")).alias("columns")], lambda boxes, kinds, kind: page_order(boxes, kinds, method, width, height, kind != "single_1"))


def page_regions(blocks: DataFrame) -> DataFrame:
    """token, page, block, region: the numbers, in reading order, of the regions that gaps between columns make."""

    @pandas_udf("array<int>")
    def run(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            number = [0] * len(page)
            for n, region in enumerate(regions([(b["x1"], b["y1"], b["x2"], b["y2"]) for b in page])):
                for i in region.blocks:
                    number[i] = n
            out.append(number)
        return pd.Series(out)

    page = blocks.groupBy("token", "page").agg(F.array_sort(F.collect_list(F.struct("block", "x1", "y1", "x2", "y2"))).alias("b"))
    zipped = F.arrays_zip(F.transform("b", lambda e: e["block"]).alias("block"), run("b").alias("region"))
    return page.select("token", "page", F.explode(zipped).alias("z")).select("token", "page", F.col("z.block").alias("block"), F.col("z.region").alias("region"))


def _turn(a: tuple[float, float], b: tuple[float, float], c: tuple[float, float]) -> float:
    """Above 0 if the way from a over b to c turns towards larger y."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def corner_order(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The corners of the smallest rectangle around the points, of any turn: top left, top right, bottom right, bottom left.
    One of its sides lies along a side of the points' hull, so each of those is tried; points on one line give that line."""
    own = np.unique(np.array(points, float), axis=0)
    in_order = [tuple(p) for p in own.tolist()]
    hull: list[tuple[float, float]] = []
    for way in (in_order, in_order[::-1]):
        start = len(hull)
        for p in way:
            while len(hull) - start >= 2 and _turn(hull[-2], hull[-1], p) <= 0:
                hull.pop()
            hull.append(p)
        hull.pop()
    found = []
    for a, b in zip(hull, [*hull[1:], *hull[:1]]):
        along = np.subtract(b, a) / np.hypot(*np.subtract(b, a))
        up = np.array([-along[1], along[0]])
        s, t = own @ along, own @ up
        corners = [tuple((along * x + up * y).tolist()) for x, y in ((s.min(), t.min()), (s.max(), t.min()), (s.max(), t.max()), (s.min(), t.max()))]
        found.append((round(float((s.max() - s.min()) * (t.max() - t.min())), 9), len(found), corners))
    corners = sorted(min(found)[2] if found else in_order * 4)
    left, right = sorted(corners[:2], key=lambda p: p[1]), sorted(corners[2:], key=lambda p: p[1])
    return [left[0], right[0], right[1], left[1]]
