from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fleetgauge.llm import feistel_order as fo
from fleetgauge.llm import kk_pack as kk
from fleetgauge.llm import tokens
from tests.llm.conftest import HARD


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_ids(reference, text):
    assert tokens.encode(tokens.encoder(), text).tolist() == reference(text)


@pytest.fixture(scope="module")
def as_text():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


pieces = st.lists(st.sampled_from(["<|endoftext|>", "<|", "endoftext", "|>", " ", "a", "\n", "b c", "é", "<|endoftext|"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(pieces)
def test_strings_of_added_tokens(reference, as_text, text):
    assert tokens.encode(tokens.encoder(), text).tolist() == reference(text)
    assert tokens.encode(tokens.encoder(literal=True), text).tolist() == as_text(text)


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        tokens.encoder(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("text", ["<|endoftext|> it's 12 x ", "a <|endoftext|> b", "a  b\n\n c\t", " \n", "é²½ 一二", "x" * 3000])
def test_ids_of_odd_texts(reference, text):
    assert tokens.encode(tokens.encoder(), text).tolist() == reference(text)


def test_cut_texts_have_the_same_ids(reference, monkeypatch):
    monkeypatch.setattr(tokens, "PART", 50)
    text = "some words,  two spaces\n new lines \t tabs  and it's more 123 of this " * 20 + "x" * 200
    assert tokens.encode(tokens.encoder(), text).tolist() == reference(text)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 256), max_size=120))
def test_pack(sizes):
    parts = kk.pack(sizes, 1024)
    assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in p) <= 1024 for p in parts)


def test_differencing_beats_dealing():
    sizes = list(range(1, 65))
    sums = [sum(sizes[i] for i in p) for p in kk.multiway(sizes, 8)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 4


def test_sequences(docs_of, reference):
    rows = HARD + [(i, f"document {i} " * (i * 7)) for i in range(10, 60)]
    got = [r.asDict() for r in kk.sequences(docs_of(rows)).collect()]
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    for seq in by.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    for i, t in rows:
        if i is not None and i >= 10:
            ids = np.array([*reference(t), 0], "<u4")
            own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
            assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
            assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(ids) for r in own)
    assert sum(r["length"] for r in got if r["doc_id"] == 4) == 2 * (len(reference("same text here")) + 1)
    assert kk.sequences(docs_of([(1, "x")]).limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    p = fo.permuted(np.arange(n), n, 5)
    assert sorted(p) == list(range(n)) and (fo.permuted(p, n, 5, inverse=True) == np.arange(n)).all()


def test_shards_round_trip(docs_of, reference, tmp_path):
    rules = fo.OrderRules(stride=16, rows=10)
    rows = [(i, f"text number {i} " * i) for i in range(40)] + [(100, None), (101, ""), (102, "very long text " * 3000), (None, "x"), (None, "x")]
    index, folder = fo.materialise(docs_of(rows), rules=rules, path=str(tmp_path / "out"))
    table = sorted(index.collect(), key=lambda r: r.slot)
    assert [r.slot for r in table] == list(range(len(table))) and all((r.shard, r["at"]) == divmod(r.slot, 10) for r in table)
    stored = [x.copy() for x in fo.read_from(folder, 0, rules)]
    assert len(stored) == len(table) and all(zlib.crc32(x.tobytes()) == r.ids_crc32 for x, r in zip(stored, table))
    found = {}
    for ids, r in zip(stored, table):
        at = 0
        for p in r.docs:
            found.setdefault(p.doc, []).append((p.start, ids[at : at + p.length].tolist()))
            at += p.length
        assert at == r.n_tokens and all(ids[at:] == rules.pad_id)
    assert sum(r.n_tokens < 16 for r in table) <= 3  # one padded sequence a task
    for i, t in rows:
        if i is not None:
            assert [x for _, part in sorted(found[i]) for x in part] == [*reference(t or ""), rules.end_id]
    assert sorted(found[None]) == [(0, [*reference("x"), rules.end_id])] * 2
    for start in (7, len(table) - 1):
        assert [x.tobytes() for x in fo.read_from(folder, start, rules)] == [x.tobytes() for x in stored[start:]]
    again, other = fo.materialise(docs_of(rows), rules=rules, path=str(tmp_path / "again"))
    empty, folder = fo.materialise(docs_of([(1, "x")]).limit(0), rules=rules, path=str(tmp_path / "none"))
    assert empty.count() == 0 and list(fo.read_from(folder, 0, rules)) == []
