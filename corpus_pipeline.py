"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. The first four return the
columns of documents; the last returns the packed pieces. Each result is written to the folder that the cluster shares
and read back, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm import bag_minhash, compression_bands, cuckoo_lines, kk_pack, qgram_leaks
from fleetgauge.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the compression bands reject go."""
    return compression_bands.keep_good(docs, rules=compression_bands.fitted(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go, except in the last document that holds them; n_chars follows the text."""
    kept = cuckoo_lines.dedup(docs)
    if "n_chars" in docs.columns:
        changed = F.col(kept.columns[-1]) > 0  # lines dropped, under a name that documents don't have
        kept = kept.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one document stays."""
    return bag_minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return qgram_leaks.clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as token pieces in sequences of 1024."""
    return kk_pack.sequences(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]
#: Near-duplicates, edit distances and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
