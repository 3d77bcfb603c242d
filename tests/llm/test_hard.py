"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns: every operator, every stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from fleetgauge.llm import bag_minhash, compression_bands, cuckoo_lines, feistel_order, flow_reshard, kk_pack, license_scan, lz_spans, qgram_leaks, site_templates
from tests.llm.conftest import HARD

CLASHES = (
    "_doc _drop _spans _row _w _block _id _text _lang _content _s _l _from _win _sig _band doc key keys last shard slot old block at w rank offset row part number n n_lines n_dropped n_words n_removed factors "
    "kept_words class_id n_class class_key c a b h label sig size bits start stop length ids ids_crc32 doc_tokens sequence_id _group docs edits item_id n_windows template containment first_word ratio kept own known"
).split()
TIES = [(30 + i, "one and the same text of several documents, " * 12) for i in range(6)]


def marked(df):
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "one and the same text of several documents, " * 4), (2, None), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, t) for i, (_, t) in enumerate(HARD + TIES) for u in (None, "http://h.example/")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


KEEPING = {"op1": cuckoo_lines.dedup, "op8": lz_spans.dedup, "op3": bag_minhash.keep_one, "op6": compression_bands.keep_good}
TELLING = {
    "op3": bag_minhash.near_classes,
    "op5": kk_pack.sequences,
    "op6": compression_bands.judge,
    "op9": license_scan.scan,
    "op10": lambda d: feistel_order.materialise(d, rules=feistel_order.OrderRules(stride=64, rows=50))[0],
}


def plain(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("name", KEEPING)
def test_operators_that_keep_columns(docs_of, name):
    docs = docs_of(HARD + TIES)
    want, got = KEEPING[name](docs), KEEPING[name](marked(docs))
    new = len(want.columns) - len(docs.columns)
    assert got.columns[: len(docs.columns) + len(CLASHES)] == [*docs.columns, *CLASHES] and len(got.columns) == len(docs.columns) + len(CLASHES) + new
    rows = sorted(str([r[c] for c in docs.columns] + list(r)[-new:] * bool(new)) for r in got.collect())
    assert rows == sorted(str([r[c] for c in docs.columns] + list(r)[-new:] * bool(new)) for r in want.collect())
    assert all(r[c] == i for r in got.collect() for i, c in enumerate(CLASHES))
    assert KEEPING[name](marked(docs).limit(0)).count() == 0


@pytest.mark.parametrize("name", TELLING)
def test_operators_that_tell(docs_of, name):
    docs = docs_of(HARD + TIES)
    want = TELLING[name](docs)
    got = TELLING[name](marked(docs))
    if name in ("op5", "op10"):  # places depend on how rows are dealt
        assert got.columns == want.columns and got.agg(F.sum("length" if name == "op5" else "n_tokens")).first() == want.agg(F.sum("length" if name == "op5" else "n_tokens")).first()
    else:
        assert got.columns == want.columns and plain(got, want.columns) == plain(want, want.columns)
    if name in ("op3", "op6"):
        assert got.count() == len(HARD + TIES)
    assert TELLING[name](marked(docs).limit(0)).count() == 0


def test_leaks_and_pages(docs_of, bench, pages):
    docs = docs_of(HARD + TIES)
    got = qgram_leaks.leaks(marked(docs), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(30 + i, 1) for i in range(6)}
    clean = qgram_leaks.clean(marked(docs), marked(bench.withColumnRenamed("item_id", "item")))
    assert clean.count() == len(HARD) and clean.columns == marked(docs).columns
    assert qgram_leaks.clean(docs, bench.limit(0)).count() == len(HARD + TIES)
    out = site_templates.extract(marked(pages))
    assert out.columns == ["page_id", "url", "text", "n_chars"] and plain(out, out.columns) == plain(site_templates.extract(pages), out.columns)
    assert out.count() == pages.count() and site_templates.extract(marked(pages).limit(0)).count() == 0


def test_resharding(docs_of):
    docs = marked(docs_of(HARD + TIES)).drop("shard", "slot").withColumn("shard", F.when(F.col("doc_id") < 30, F.col("doc_id") % 3 - 1)).withColumn("slot", F.lit("own")).withColumn("bytes", F.octet_length("text"))
    out, _ = flow_reshard.assign(docs, "bytes", "shard", 2, 4)  # old shards -1 and null aren't known
    assert out.columns == [*docs.columns, "shard_", "slot_"] and out.count() == len(HARD + TIES)
    assert plain(out, docs.columns) == plain(docs, docs.columns)
    rows = out.collect()
    for s in range(4):
        assert sorted(r.slot_ for r in rows if r.shard_ == s) == list(range(sum(r.shard_ == s for r in rows)))
    assert flow_reshard.assign(docs.limit(0), "bytes", "shard", 2, 4)[0].count() == 0


@pytest.fixture(scope="module")
def folder(tmp_path_factory, bench, spark):
    path = tmp_path_factory.mktemp("tables")
    bench.write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(30, 1, 0), (None, None, None), (1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("stage", [n for n, _ in cp.STAGES])
def test_stages(spark, docs_of, folder, stage):
    run = dict(cp.STAGES)[stage]
    docs = docs_of(HARD + TIES)
    got, want = run(spark, marked(docs), folder), run(spark, docs, folder)
    if stage == "packing":
        assert got.agg(F.sum("length")).first() == want.agg(F.sum("length")).first()
    else:
        assert got.columns == marked(docs).columns
        assert plain(got, docs.columns) == plain(want, docs.columns)
        assert all(r[c] == i for r in got.collect() for i, c in enumerate(CLASHES))
    assert run(spark, marked(docs).limit(0), folder).count() == 0
