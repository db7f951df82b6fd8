import random

import pytest

from folio.operators.order import xy_cut, xy_order
from folio.sources.blocks import blocks


def by_pixels(boxes, ids, line):
    """The same by marking every covered pixel."""

    def parts(ids, axis, gap):
        covered = sorted({p for i in ids for p in range(boxes[i][axis], boxes[i][axis + 2])})
        starts = [p for k, p in enumerate(covered) if k == 0 or p - covered[k - 1] > gap]
        return [sorted((i for i in ids if lo <= boxes[i][axis] and (hi is None or boxes[i][axis] < hi)), key=lambda i: boxes[i][axis]) for lo, hi in zip(starts, [*starts[1:], None])]

    out = []
    for band in parts(ids, 1, line):
        columns = parts(band, 0, 1)
        out += columns[0] if len(columns) == 1 else [i for c in columns for i in by_pixels(boxes, c, line)]
    return out


@pytest.mark.parametrize("seed", range(40))
def test_equals_marking_pixels(seed):
    r = random.Random(seed)
    boxes = []
    for _ in range(r.randrange(1, 25)):
        x, y = r.randrange(150), r.randrange(150)
        boxes.append((x, y, x + r.randrange(1, 40), y + r.randrange(1, 30)))
    line = r.choice([1, 1, 3, 8])
    got = xy_cut(boxes, line)
    assert sorted(got) == list(range(len(boxes))) and got == by_pixels(boxes, list(range(len(boxes))), line)


def test_columns_under_a_title():
    page = [(0, 0, 100, 10), (0, 20, 45, 30), (55, 20, 100, 30), (0, 40, 45, 50), (55, 40, 100, 50)]
    assert xy_cut(page) == [0, 1, 2, 3, 4]
    # lines that overlap in height across the gutter are read by column
    assert xy_cut([(0, 0, 45, 12), (55, 5, 100, 25), (0, 15, 45, 40), (55, 30, 100, 45)]) == [0, 2, 1, 3]
    assert xy_cut([]) == [] and xy_cut([(3, 3, 3, 3)] * 3) == [0, 1, 2]
    assert xy_cut(page, reverse=True) == [0, 1, 2, 3, 4]


def test_every_block_has_one_place(spark):
    b = blocks(spark, "/root/testdata/sf0.001")
    rows = xy_order(b).collect()
    by_page = {}
    for r in rows:
        by_page.setdefault((r.token, r.page), []).append(r.place)
    assert len(rows) == b.count() and all(sorted(p) == list(range(len(p))) for p in by_page.values())
