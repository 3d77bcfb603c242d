"""The thin queries over the driver's tables, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm import bag_minhash, compression_bands, cuckoo_lines, feistel_order, flow_reshard, kk_pack, license_scan, lz_spans, qgram_leaks, site_templates
from fleetgauge.llm.common import fresh_path, table


def op1_cuckoo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cuckoo_lines.dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.*, frequent.last IS NOT NULL AND keyed.doc_id <> frequent.last AS gone FROM keyed LEFT JOIN frequent ON keyed.k = frequent.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op2_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 24 shards by the hash of the source (a hot source makes one of them very large) to 40 of near equal bytes: the
    old shards are written, the affected ones rewritten, and the digests taken from the files of the new layout."""
    old = F.pmod(F.xxhash64("source"), F.lit(24)).cast("int")
    folder = fresh_path(spark, "old-layout")
    table(spark, sf_dir, "documents").withColumn("old_shard", old).write.option("compression", "zstd").partitionBy("old_shard").parquet(folder)
    numbers = [r[0] for r in table(spark, sf_dir, "documents").select(old).distinct().collect()]  # 24 at most
    if not numbers:
        return spark.createDataFrame([], "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, old_shard int")
    new = flow_reshard.rewrite(spark, {k: f"{folder}/old_shard={k}" for k in numbers}, 40, "octet_length(coalesce(text, '')) + 16")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = flow_reshard.read_layout(spark, new)
    return rows.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), F.col(flow_reshard.SHARD).alias("shard"), F.col(flow_reshard.SLOT).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), old.alias("old_shard"))


def op3_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_templates.extract(table(spark, sf_dir, "pages"))


def op5_kk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kk_pack.sequences(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compression_bands.judge(docs, rules=compression_bands.fitted(docs, table(spark, sf_dir, "labels")))


def op7_qgram_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qgram_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_lz_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lz_spans.dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_feistel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards are written; the rows tell what lies at each slot."""
    return feistel_order.materialise(table(spark, sf_dir, "documents"))[0]


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
placed AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS pos FROM w WHERE len(ws) >= 50),
k AS (SELECT doc_id, pos, sha256(array_to_string(ws[pos:pos + 49], ' ')) AS g FROM placed),
m AS (SELECT doc_id, pos FROM k QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS p FROM m),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP9_SQL = rf"""
WITH named(template, text) AS (VALUES {", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in license_scan.TEMPLATES.items())}),
tw AS (SELECT template, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM named),
tg AS (SELECT DISTINCT template, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT template, ws, unnest(range(1, len(ws) - 3)) AS i FROM tw WHERE len(ws) >= 5)),
tn AS (SELECT template, count(*) AS n, CAST(2 ** ceil(log2(count(*))) AS BIGINT) AS step FROM tg GROUP BY template),
dw AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM documents),
dg AS (SELECT doc_id, i - 1 AS i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM dw WHERE len(ws) >= 5)),
hit AS (SELECT doc_id, template, n, step, i, g FROM dg JOIN tg USING (g) JOIN tn USING (template)),
win AS (SELECT doc_id, template, n, i // step * step AS a, g FROM hit UNION ALL SELECT doc_id, template, n, i // step * step - step, g FROM hit WHERE i >= step),
share AS (SELECT doc_id, template, a, count(DISTINCT g)::DOUBLE / any_value(n) AS s FROM win GROUP BY doc_id, template, a)
SELECT doc_id, template, max(s) AS containment, min(a)::BIGINT AS first_word, count(*) AS n_windows FROM share WHERE s >= {license_scan.CONTAINMENT} GROUP BY doc_id, template
"""

QUERIES = {
    "op1_cuckoo_lines": op1_cuckoo_lines,
    "op2_flow_reshard": op2_flow_reshard,
    "op3_bag_minhash": op3_bag_minhash,
    "op4_site_templates": op4_site_templates,
    "op5_kk_pack": op5_kk_pack,
    "op7_qgram_leaks": op7_qgram_leaks,
    "op8_lz_spans": op8_lz_spans,
    "op9_license_scan": op9_license_scan,
    "op10_feistel_order": op10_feistel_order,
    "op6_compression_bands": op6_compression_bands,
}
ORACLES: dict[str, str] = {
    "op1_cuckoo_lines": OP1_SQL,
    "op8_lz_spans": OP8_SQL,
    "op9_license_scan": OP9_SQL,
}
