from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from fleetgauge.llm import bag_minhash as bm
from tests.llm.conftest import HARD


def brute(rows):
    bags = {}
    for i, t in rows:
        w = bm.words_of(t or "")
        k = min(5, len(w))
        if w:
            bags[i] = Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(bags)
    for n, b in enumerate(ids):
        for a in ids[:n]:
            both = sum((bags[a] & bags[b]).values())
            if both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_classes(docs_of):
    r = random.Random(4)
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    rows = []
    for g in range(8):
        base = words(r.choice([8, 60, 150, 300]))
        for _ in range(r.randint(1, 9)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 45))):
                t[r.randrange(len(t))] = f"z{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(t)))
    rows += [(len(rows) + i, rows[0][1].upper() + "!") for i in range(3)]
    got = bm.near_classes(docs_of(rows)).collect()
    assert {x.doc_id: x.class_id for x in got} == brute(rows)
    kept = sorted(x.doc_id for x in bm.keep_one(docs_of(rows)).collect())
    assert kept == sorted(set(brute(rows).values()))


def test_signature_estimates_weighted_jaccard():
    r = np.random.default_rng(2)
    items = np.unique(r.integers(0, 2**62, 200).astype(np.uint64))
    a, b = (items, r.integers(1, 12, len(items))), (items, r.integers(1, 12, len(items)))
    s = bm.signatures([a, b], 3000)
    assert abs((s[0] == s[1]).mean() - bm.overlap(a, b)) < 0.04
    assert (bm.signatures([a], 64) == bm.signatures([b, a], 64)[1]).all()


def test_hard_rows(docs_of):
    got = bm.near_classes(docs_of(HARD)).collect()
    assert len(got) == len(HARD)
    assert sorted(r.class_id for r in got if r.doc_id == 4) == [4, 4]
    kept = bm.keep_one(docs_of(HARD)).collect()
    assert sorted((r.doc_id is None, r.text is None) for r in kept if r.doc_id is None) == [(True, False), (True, True)]
    assert sum(r.doc_id == 4 for r in kept) == 1 and {0, 1, 2, 3, 5} <= {r.doc_id for r in kept}
    empty = docs_of([(1, "x")]).limit(0)
    assert bm.near_classes(empty).count() == 0 and bm.keep_one(empty).count() == 0


@pytest.mark.parametrize("n", [1, 7, 200])
def test_star_components(spark, n):
    from fleetgauge.llm.components import stars

    chain = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {(r.a, r.b) for r in stars(chain).collect()}
    assert got == {(i, 0) for i in range(1, n + 1)} | {(1001, 1000)}
