"""Mixing against plain water-filling and against what any order of a source's documents must give."""

import random
import re

import pytest

from folio.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """By rounds: share out by weight, bind what is above its limit, share the rest out again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    bound, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in bound]
        left = total - sum(bound.values())
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return bound | share
        bound |= {s: 3.0 * sizes[s] for s in above}


def tables():
    r = random.Random(7)
    text = lambda n: " ".join("w" * r.randrange(1, 5) for _ in range(n))
    many = [(k, text(r.randrange(0, 40)), f"s{r.randrange(400):03}") for k in range(1500)]
    hot = [(k, text(60), "hot") for k in range(200)] + [(1000 + k, text(r.randrange(1, 9)), s) for k, s in enumerate(["a", "b", None, "é", "z", "a"])]
    return {"many": many, "hot": hot, "one": [(1, text(30), "only")], "none": [(1, text(30), None), (2, None, None), (3, "", None)], "empty words": [(1, " \t", "a"), (2, None, "b")]}


@pytest.mark.parametrize("name", list(tables()))
def test_targets_and_words(spark, name):
    rows = tables()[name]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", mixing.F.length("text"))
    got = [r.asDict() for r in mixing.mix(df, block=64)[0].collect()]
    if name == "many":
        again = [r.asDict() for r in mixing.mix(df.repartition(3), block=64)[0].collect()]
        key = lambda r: (r["doc_id"], r["row"], r["taken"])
        assert sorted(map(key, got)) == sorted(map(key, again))
    assert len(got) == len(rows)
    size = {k: len(WORD.findall(t or "")) for k, t, _ in rows}
    sizes = {}
    for k, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size[k]
    want = plain_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    own = {k: s for k, _, s in rows}
    for s in sizes:
        mine = [r for r in got if own[r["doc_id"]] == s]
        goal = round(want[s])
        assert all(abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) and r["source_size"] == sizes[s] and r["size"] == size[r["doc_id"]] for r in mine)
        taken = sum(r["taken"] for r in mine)
        assert abs(taken - goal) <= 1
        # whole passes over all documents, one more over the first ones of an order, and one document that it ends in
        passes = taken // sizes[s] if sizes[s] else 0
        parts = [r["taken"] - passes * r["size"] for r in mine if r["size"]]
        assert all(0 <= p <= r["size"] for p, r in zip(parts, (r for r in mine if r["size"])))
        assert sum(0 < p < r["size"] for p, r in zip(parts, (r for r in mine if r["size"]))) <= 1
        assert all(r["taken"] <= 3 * r["size"] for r in mine)
