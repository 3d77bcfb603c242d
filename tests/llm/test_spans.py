from __future__ import annotations

import random

import pytest

from fleetgauge.llm import lz_spans
from tests.llm.conftest import HARD


def brute(rows, window=50):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        cover, mine = [False] * len(w), []
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            mine.append(g)
            if seen.get(g, i) < i:
                cover[k : k + window] = [True] * window
        for g in mine:
            seen.setdefault(g, i)
        out[i] = b" ".join(x for x, c in zip(w, cover) if not c).decode()
    return out


@pytest.mark.parametrize("seed", range(2))
def test_brute_force(docs_of, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40 if seed else 2000)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passages = [words(r.randint(45, 160)) for _ in range(6)]
    rows = []
    for i in range(60):
        t = words(r.randint(0, 120))
        for p in r.sample(passages, r.randint(0, 3)):
            a = r.randint(0, 30)
            t += p[a:] + words(r.randint(0, 20))
        rows.append((i, " ".join(t)))
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, "x " * 300), (201, "x " * 120)]
    got = {x.doc_id: x for x in lz_spans.dedup(docs_of(rows)).collect()}
    want = brute(rows)
    assert {i: got[i].kept_words for i in want} == want
    assert all(x.n_words - x.n_removed == len(x.kept_words.split()) for x in got.values())
    text = {i: t.split() for i, t in rows}
    for i, x in got.items():
        for f, after in zip(x.factors, [*x.factors[1:], None]):
            part, at = text[i][f.start : f.stop], f.source_start
            assert f.source < i and len(part) == f.stop - f.start >= 50
            assert part == text[f.source][at : at + len(part)]
            assert after is None or after.start > f.start and after.stop > f.stop


def test_a_copy_is_one_factor(docs_of):
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(400)]
    rows = [(1, " ".join(words)), (2, "head " + " ".join(words[30:330]) + " tail"), (3, " ".join(words[100:200] + ["new"] + words[201:300]))]
    got = {x.doc_id: [tuple(f) for f in x.factors] for x in lz_spans.dedup(docs_of(rows)).collect()}
    assert got == {1: [], 2: [(1, 301, 1, 30)], 3: [(0, 100, 1, 100), (101, 200, 1, 201)]}


def test_hard_rows(docs_of):
    rows = lz_spans.dedup(docs_of(HARD + [(9, "long line of words " * 100)])).collect()
    assert len(rows) == len(HARD) + 1
    by = {r.doc_id: r for r in rows}
    assert by[9].n_removed == 400 and by[5].n_removed == 0 and by[0].n_words == 0
    assert lz_spans.dedup(docs_of([(1, "x")]).limit(0)).count() == 0


def test_texts_without_an_id_come_first(docs_of):
    text = " ".join(f"w{i}" for i in range(120))
    got = {x.doc_id: x.n_removed for x in lz_spans.dedup(docs_of([(None, text), (1, text), (2, "x " + text[:400])])).collect()}
    assert got[None] == 0 and got[1] == 120 and got[2] > 50
