"""Whole queries against plain versions of the same rules: base counts, resharding, near-duplicates, the pipeline."""

from __future__ import annotations

import os
import random
import re
import zlib

import pytest
import zstandard

import corpus_pipeline as cp
from fleetgauge.llm import bag_minhash as bm
from fleetgauge.llm import compression_bands as cb
from fleetgauge.llm import kk_pack, registry, tokens
from fleetgauge.llm import qgram_leaks as ql
from tests.llm.test_rest import prose, sellers

DATA = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
ODD = [None, "", " \n\t", "a b c a b c\n\nx #y\n\nx #y\xa0z", "x y\r\nx y\r\n\x0b\n", "w\u2003w w\u2003w w\u2003w w", "# * $ % & | < > " * 30, "\x1c\x85 a b a b a b"]


def plain_counts(text):
    text = text or ""
    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\\x20\\x09-\\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1} if len(windows) < 400 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def plain_kept(text, lang, rules):
    n, _, _, _, again = plain_counts(text)
    if n < 50 or 100 * again > 50 * n:
        return False
    raw, z = text.encode(), zstandard.ZstdCompressor(level=3)

    def inside(part):
        low, high = cb.band(len(part), rules.fitted.get(lang, rules.bands))
        return low <= len(part) / len(z.compress(part)) <= high

    parts = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
    return inside(raw) and sum(len(p) for p in parts if not inside(p)) <= 0.34 * len(raw)


@tables
def test_quality_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rules = cb.fitted(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    got = {r.doc_id: r for r in registry.op6_compression_bands(spark, DATA).collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    assert len(got) == len(rows)
    for i, text, lang in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(text)
        assert r.kept == plain_kept(text, lang, rules)


def test_base_counts_of_odd_texts():
    for text in ODD:
        assert cb.base_counts(text or "", (text or "").encode()) == plain_counts(text)


def test_junk_is_found_wherever_it_lies():
    r, z, rules = random.Random(2), zstandard.ZstdCompressor(level=3), cb.Rules()
    good, junk = prose(r, 2000)[:6691].encode(), bytes(r.randrange(33, 127) for _ in range(1500))
    assert len(good) == 6691 and cb.verdict(good, rules, z)[3]
    assert not cb.verdict(good + junk, rules, z)[3] and not cb.verdict(junk + good, rules, z)[3]
    assert cb.verdict(b"x", rules, z)[1] == 1 and not cb.verdict(junk, rules, z)[3]


@tables
def test_held_out_good_rows_are_kept(spark):
    """Limits from one half of the labelled rows, judged on the other."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rules = cb.fitted(docs, labels.filter("doc_id % 2 = 0"))
    held = [r for r in docs.join(labels.filter("doc_id % 2 = 1 AND quality = 1"), "doc_id").collect() if not (lambda c: c[0] < 50 or 2 * c[4] > c[0])(plain_counts(r.text))]
    assert len(held) > 100 and sum(plain_kept(r.text, r.lang, rules) for r in held) >= 0.98 * len(held)


@tables
def test_resharding_over_the_whole_table(spark):
    rows = {r.doc_id: r for r in registry.op2_flow_reshard(spark, DATA).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    sizes, slots = [0] * 40, [[] for _ in range(40)]
    for i, t in texts.items():
        r, raw = rows[i], t.encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 40


def bag_of(text):
    words = re.findall("\\w+", (text or "").lower())
    out = {}
    for i in range(max(1, len(words) - 4) if words else 0):
        k = tuple(words[i : i + 5])
        out[k] = out.get(k, 0) + 1
    return out


def similar(a, b):
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def linked(texts):
    """All pairs at 0.8 or more, by a list of the documents that hold each shingle."""
    bags, holds, pairs = {i: bag_of(t) for i, t in texts.items()}, {}, set()
    for i, b in bags.items():
        for k in b:
            holds.setdefault(k, []).append(i)
    for i, b in bags.items():
        for j in {j for k in b for j in holds[k] if j > i}:
            if similar(b, bags[j]) >= 0.8 - 1e-12:
                pairs.add((i, j))
    return pairs


def classes(texts):
    top = {i: i for i in texts}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, j in linked(texts):
        a, b = sorted((root(i), root(j)))
        top[b] = a
    return {i: root(i) for i in texts}


@tables
def test_near_duplicates_over_the_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r.class_id for r in registry.op3_bag_minhash(spark, DATA).collect()}
    pairs = linked(texts)
    found = sum(got[i] == got[j] for i, j in pairs)
    assert len(pairs) > 50 and found >= 0.99 * len(pairs)
    want = classes(texts)
    assert all(want[i] == want[c] for i, c in got.items())  # nothing unlike is joined


def test_pipeline_against_plain_stages(spark, tmp_path):
    r = random.Random(12)
    item = prose(r, 40)
    rows = {i: "\n".join(prose(r, 30) for _ in range(4)) for i in range(60)}
    line = "this very line stands in a good many of the documents of the table"
    for i in range(0, 24, 2):
        rows[i] = f"{line}\n{rows[i]}\n {line.upper()}"
    for i in range(30, 36):
        rows[60 + i] = rows[30]  # copies
        rows[70 + i] = rows[31] + " and a little more"
    rows[200], rows[201] = "same words again and " * 60, "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/ ") for _ in range(4000))
    rows[202], rows[203], rows[204] = None, "", "few words"
    rows[210], rows[211] = prose(r, 60) + " " + item + " " + prose(r, 60), prose(r, 60) + " " + item[20:110] + " " + prose(r, 60)
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "xx", "s", None if t is None else len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")

    kept = {i: t for i, t in rows.items() if plain_kept(t, "xx", cb.Rules())}
    assert not kept.keys() & {200, 201, 202, 203, 204} and len(kept) >= 70
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in kept.items():
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(i)
    lost = {k: max(v) for k, v in held.items() if len(v) >= 5}
    kept = {i: "\n".join(x for x in t.split("\n") if lost.get(key(x), i) == i) for i, t in kept.items()}
    assert line not in kept[0] and line in kept[22]
    kept = {i: kept[i] for i, c in classes(kept).items() if c == i}
    rules = ql.LeakRules()
    norm = lambda t: b" ".join(re.sub(rb"[^a-z0-9\x80-\xff]", b" ", t.lower().encode()).split())
    windows = [norm(item)[a : a + 48] for a in ql.starts(len(norm(item)), rules)]
    kept = {i: t for i, t in kept.items() if min(sellers(w, norm(t)) for w in windows) > 4}
    assert not kept.keys() & {210, 211} and len(kept) >= 55
    got = cp.run(spark, d).collect()
    enc = tokens.encoder()
    want = {i: [*tokens.encode(enc, t).tolist(), 0] for i, t in kept.items()}
    assert {x.doc_id for x in got} == want.keys()
    full = {}
    for i, ids in want.items():
        own = sorted((x for x in got if x.doc_id == i), key=lambda x: x.start)
        assert [x.start for x in own] == [sum(y.length for y in own[:k]) for k in range(len(own))]
        for x in own:
            assert x.doc_tokens == len(ids) and x.ids_crc32 == zlib.crc32(b"".join(v.to_bytes(4, "little") for v in ids[x.start : x.start + x.length]))
            full.setdefault(x.sequence_id, []).append((x.offset, x.length))
        assert sum(x.length for x in own) == len(ids)
    for parts in full.values():
        ends = [0, *(a + n for a, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= kk_pack.PackRules().length
    assert bm.NearRules().similarity == 0.8
