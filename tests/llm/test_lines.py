from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetgauge.llm import cuckoo_lines as cl
from tests.llm.conftest import HARD

A, B, SHORT = "a long line that is held by many documents", "Another Long Line that only four documents have", "short"


def test_rule(docs_of):
    texts = [f"{A}\nown line number {i} of this document, long enough\n{SHORT}\n  {A.upper()}\t" for i in range(5)] + [B] * 4
    got = {r.doc_id: r for r in cl.dedup(docs_of(texts)).collect()}
    for i in range(4):
        assert got[i].text == f"own line number {i} of this document, long enough\n{SHORT}" and (got[i].n_lines, got[i].n_dropped) == (4, 2)
    assert got[4].n_dropped == 0 and all(got[i].text == B for i in range(5, 9))


def test_hard_rows(docs_of):
    many = [(100 + i, f"{A}\n") for i in range(5)] + [(104, f"{A}\n")]
    rows = cl.dedup(docs_of(HARD + many)).collect()
    assert len(rows) == len(HARD) + len(many)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.n_dropped for r in by[104]] == [0, 0] and all(by[100 + i][0].text == "" for i in range(4))
    assert by[0][0].text is None and by[0][0].n_lines == 1
    assert cl.dedup(docs_of([(1, "x")]).limit(0)).count() == 0


def test_clashing_columns(docs_of):
    df = docs_of(["a\nb"]).selectExpr("*", "1 AS n_lines", "2 AS n_dropped")
    assert cl.dedup(df).columns[-2:] == ["n_lines_", "n_dropped_"]


def test_result_is_the_same_with_many_shards_and_groups(docs_of, monkeypatch):
    docs = docs_of([f"{A}\nheld by {i % 7} some others and long enough to count\nown line {i} that nobody else has, I think" for i in range(60)])
    want = sorted(map(tuple, cl.dedup(docs).collect()))
    monkeypatch.setattr(cl, "PER_SHARD", 2)
    monkeypatch.setattr(cl, "GROUP_ROWS", 10)
    assert sorted(map(tuple, cl.dedup(docs).collect())) == want
    assert sum(r[-1] for r in want) == 59 + 53


keys = st.sets(st.integers(0, 10**9), max_size=300).map(lambda s: [hashlib.md5(str(x).encode()).digest() for x in sorted(s)])


@settings(max_examples=25, deadline=None)
@given(keys)
def test_filter_has_no_false_negative_and_deletes(ks):
    f = cl.CuckooFilter.of(ks)
    assert all(k in f for k in ks)
    for k in ks:
        assert f.delete(k)
    assert not f.table.any()


def test_index_is_reversible(spark, docs_of, tmp_path, monkeypatch):
    monkeypatch.setattr(cl, "PER_SHARD", 3)
    first = docs_of([(i, f"{A}\nline of document {i} alone, made long enough\nline of the first batch, held by all {i % 2}") for i in range(12)])
    second = docs_of([(i, f"{A}\n{B}") for i in range(12, 18)])
    ix = cl.LineIndex(spark, str(tmp_path / "ix"))
    state = lambda: (sorted(map(tuple, ix.references().collect())), sorted(map(tuple, ix.counts().collect())), sorted(map(tuple, ix.lost().collect())))
    ix.insert(first)
    before = state()
    assert {r.doc for r in ix.lost().collect()} == set(range(11))
    ix.insert(second)
    both = first.unionByName(second)
    assert sorted(map(tuple, cl.dedup(both, index=ix).collect())) == sorted(map(tuple, cl.dedup(both).collect()))
    assert {r.doc for r in ix.lost().collect()} == set(range(17))
    ix.delete(second)
    assert state() == before
    assert ix.filters().groupBy().sum("n_keys").first()[0] == len(before[1])
    held = cl.CuckooFilter.load
    assert sum(int((held(r.filter).table != 0).sum()) for r in ix.filters().collect()) == len(before[1])
    again = cl.LineIndex(spark, str(tmp_path / "ix"), generation=1)
    assert sorted(map(tuple, again.counts().collect())) == before[1]
    ix.delete(first)
    assert ix.references().count() == ix.counts().count() == ix.lost().count() == 0
    ix.insert(first)
    assert state() == before


def test_ids_of_other_types(docs_of):
    df = docs_of([A] * 6 + [(None, A)]).selectExpr("CAST(doc_id AS STRING) AS doc_id", "text")
    assert {r.doc_id: r.n_dropped for r in cl.dedup(df).collect()} == {**{str(i): 1 for i in range(5)}, "5": 0, None: 1}


@pytest.mark.parametrize("n", [0, 1, 100_000, 100_001])
def test_shards(n):
    assert cl.shards_for(n) == max(1, -(-n // 100_000))
