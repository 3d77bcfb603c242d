"""Line dedup with sharded cuckoo filters over exact reference-count tables.

A line's key is 16 bytes of xxh3 over the normalised line. LineIndex holds, for all documents inserted and not deleted
again: the references (key, document, how often), summed from +1 of insertions and -1 of deletions; the exact counts of
the keys that enough documents hold, and the last of these documents; and cuckoo filters of those keys, one per shard
of the key space. A change writes the new references, counts them, and inserts into the filters the keys that became
frequent and deletes those that ceased to be, so deleting a batch gives back the index that was there before it.

Which lines go is decided by the index: references are sent to their shard, whose filter says "perhaps" or "no"; what
may be frequent is joined with the exact counts, where false hits fall out. The result doesn't depend on the filters.

Scale: references are 24 bytes, without text; counts are combined before they shuffle. Shards follow the number of
frequent keys (PER_SHARD each), and a shard's references are probed in as many groups, told apart by document, as keep a
group at some GROUP_ROWS, so a line held by a third of all documents is split, and no filter is sent to every task. The plan is the same at
every size. Texts move once, to meet the keys that they lose.

Cases: null and empty texts are one empty line. Rows that repeat a doc_id are the same document: a key counts once
for it, and all of them keep the line if it is the largest. A null doc_id counts as one document, smaller than all others.
Ids may be of any ordered type. Very long texts are read whole, one document at a time. An empty table gives an empty
result. Columns of the table keep their names and values; ours get an underscore where a name is taken.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.common import extended, fresh_path, map_rows, stored, struct, unused

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
PER_SHARD = 100_000
GROUP_ROWS = 500_000
SLOTS = 4
FULL = 0.85


@dataclass(frozen=True)
class LineRules:
    least_chars: int = 40
    least_docs: int = 5


def line_key(line: str, least_chars: int) -> bytes | None:
    """16 bytes for a line that is long enough. bytes.lower() lowers A-Z only."""
    line = line.strip(SPACE)
    return xxhash.xxh3_128_digest(line.encode().lower()) if len(line) >= least_chars else None


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; an entry lies in one of two buckets that differ by a hash of the fingerprint."""

    def __init__(self, capacity: int, table: np.ndarray | None = None, seed: int = 7):
        self.n = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * FULL)))))
        self.table = np.zeros((self.n, SLOTS), np.uint16) if table is None else table
        self.n = len(self.table)
        self.random = np.random.default_rng(seed)

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        """Built of all keys; it doubles until they fit."""
        capacity = len(keys)
        while True:
            f = cls(capacity)
            if all(f.insert(k) for k in keys):
                return f
            capacity = f.n * SLOTS

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & (self.n - 1)
        return mark, first, self.other(first, mark)

    def other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & (self.n - 1))

    def insert(self, key: bytes, kicks: int = 500) -> bool:
        mark, a, b = self.places(key)
        for bucket in (a, b):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        bucket = (a, b)[int(self.random.integers(2))]
        moved = []
        for _ in range(kicks):
            slot = int(self.random.integers(SLOTS))
            moved.append((bucket, slot, int(self.table[bucket, slot])))
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = self.other(bucket, mark)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        for bucket, slot, was in reversed(moved):  # as it was before
            self.table[bucket, slot] = was
        return False

    def delete(self, key: bytes) -> bool:
        mark, a, b = self.places(key)
        for bucket in (a, b):
            at = np.flatnonzero(self.table[bucket] == mark)
            if len(at):
                self.table[bucket, at[0]] = 0
                return True
        return False

    def __contains__(self, key: bytes) -> bool:
        mark, a, b = self.places(key)
        return mark in self.table[a] or mark in self.table[b]

    def contains_all(self, keys: np.ndarray) -> np.ndarray:
        """For keys of shape (n, 16), uint8: whether each may be in the filter."""
        mark = keys[:, :2].copy().view(np.uint16).ravel().astype(np.uint64)
        mark[mark == 0] = 1
        first = keys[:, 2:10].copy().view(np.uint64).ravel() & np.uint64(self.n - 1)
        second = first ^ (mark * np.uint64(0x5BD1E995) & np.uint64(self.n - 1))
        mark = mark.astype(np.uint16)[:, None]
        return (self.table[first] == mark).any(1) | (self.table[second] == mark).any(1)


def shard_of(key: str, shards: int):
    """Shard of a key column by bytes that the filters don't use."""
    return F.pmod(F.conv(F.hex(F.substring(key, 13, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def references(docs: DataFrame, id_col: str, text_col: str, rules: LineRules) -> DataFrame:
    """(doc, key): the distinct long lines of each row of docs."""

    def lines(doc, text):
        seen = {k for line in (text or "").split("\n") if (k := line_key(line, rules.least_chars))}
        return [(doc, k) for k in seen]

    return map_rows(docs, [id_col, text_col], lines, struct(("doc", docs.schema[id_col].dataType.simpleString()), ("key", "binary")))


def shards_for(n_keys: int, per_shard: int | None = None) -> int:
    return max(1, -(-n_keys // (per_shard or PER_SHARD)))


FILTERS = "shard int, n_keys long, filter binary"


def changed(filters: DataFrame | None, changes: DataFrame, keys: DataFrame) -> DataFrame:
    """filters with the keys of changes (shard, key, add) inserted or deleted. A filter that overflows is built again, larger,
    from the exact keys (shard, key) of its shard."""

    def merge(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
        f, n = (CuckooFilter.load(old.column("filter")[0].as_py()), old.column("n_keys")[0].as_py()) if old.num_rows else (CuckooFilter(new.num_rows), 0)
        fits = True
        for k, add in sorted(zip(new.column("key").to_pylist(), new.column("add").to_pylist(), strict=True), key=lambda x: (x[1], x[0])):
            n += 1 if add else -1
            fits = fits and (f.insert(k) if add else f.delete(k))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n_keys": pa.array([n], pa.int64()), "filter": pa.array([f.dump() if fits else None], pa.binary())})

    def build(group: pa.Table) -> pa.Table:
        ks = sorted(group.column("key").to_pylist())
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "n_keys": pa.array([len(ks)], pa.int64()), "filter": pa.array([CuckooFilter.of(ks).dump()], pa.binary())})

    before = filters if filters is not None else changes.sparkSession.createDataFrame([], FILTERS)
    merged = stored(before.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(merge, FILTERS), "filters")
    again = keys.join(merged.filter("filter IS NULL").select("shard"), "shard", "left_semi").groupBy("shard").applyInArrow(build, FILTERS)
    return merged.filter("filter IS NOT NULL AND n_keys > 0").unionByName(again)


class LineIndex:
    """References, counts and filters in the shared folder, changed by batches. Each change writes a new generation and
    leaves the one before it; a failed batch changes nothing. generation: the one to go on from, 0 for an empty index."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules: LineRules | None = None, generation: int = 0):
        self.spark, self.path, self.rules = spark, path or fresh_path(spark, "line-index"), rules or LineRules()
        self.generation = generation

    def _read(self, what: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{self.generation}/{what}") if self.generation else None

    def references(self) -> DataFrame | None:
        """(key, doc, refs): live references, each document and line once."""
        return self._read("references")

    def counts(self) -> DataFrame | None:
        """(key, n_docs, last): the keys held by enough documents."""
        return self._read("counts")

    def filters(self) -> DataFrame | None:
        """(shard, n_keys, filter) of the keys in counts()."""
        return self._read("filters")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self._change(references(docs, id_col, text_col, self.rules).withColumn("refs", F.lit(1).cast("long")))

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Takes back what insert() did for the same rows."""
        self._change(references(docs, id_col, text_col, self.rules).withColumn("refs", F.lit(-1).cast("long")))

    def _change(self, delta: DataFrame) -> None:
        target, (was, old) = f"{self.path}/{self.generation + 1}", (self.counts(), self.filters())
        delta = delta.select("key", "doc", "refs")
        rows = delta if self.generation == 0 else self.references().unionByName(delta)
        self._write(rows.groupBy("key", "doc").agg(F.sum("refs").alias("refs")).filter("refs > 0"), f"{target}/references")
        refs = self.spark.read.parquet(f"{target}/references")
        self._write(refs.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last")).filter(F.col("n_docs") >= self.rules.least_docs), f"{target}/counts")
        now = self.spark.read.parquet(f"{target}/counts")
        shards = shards_for(now.count())
        keys = now.select(shard_of("key", shards).alias("shard"), "key")
        if was is None or shards != shards_for(was.count()):  # other shards: all filters anew
            old, added = None, keys.withColumn("add", F.lit(True))
        else:
            before = was.select(shard_of("key", shards).alias("shard"), "key")
            added = keys.join(before, ["shard", "key"], "left_anti").withColumn("add", F.lit(True))
            added = added.unionByName(before.join(keys, ["shard", "key"], "left_anti").withColumn("add", F.lit(False)))
        self._write(changed(old, added, keys), f"{target}/filters")
        self.generation += 1

    def _write(self, df: DataFrame, path: str) -> None:
        df.write.option("compression", "zstd").parquet(path)

    def likely(self) -> DataFrame:
        """(key, doc): the live references that the filter of their shard may know."""
        refs, filters = self.references(), self.filters()
        shards = shards_for(self.counts().count())
        groups = max(1, -(-refs.count() // (shards * GROUP_ROWS)))  # a shard's references by document, so that a hot line is split
        kind = refs.schema["doc"].dataType.simpleString()
        left = refs.select("key", "doc", shard_of("key", shards).alias("shard"), F.pmod(F.xxhash64("doc"), F.lit(groups)).cast("int").alias("part"))
        right = filters.select("shard", "filter", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))

        def probe(rows: pa.Table, known: pa.Table) -> pa.Table:
            rows = rows.select(["key", "doc"])
            if not known.num_rows or not rows.num_rows:
                return rows.slice(0, 0)
            keys = np.frombuffer(b"".join(rows.column("key").to_pylist()), np.uint8).reshape(-1, 16)
            return rows.filter(pa.array(CuckooFilter.load(known.column("filter")[0].as_py()).contains_all(keys)))

        return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(probe, f"key binary, doc {kind}")

    def lost(self) -> DataFrame:
        """(key, doc): the references that go, by the counts as they stand."""
        joined = self.likely().join(self.counts().select("key", "last"), "key")
        return joined.filter(~F.col("doc").eqNullSafe(F.col("last"))).select("key", "doc")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules | None = None, index: LineIndex | None = None) -> DataFrame:
    """docs, all columns, with text_col cut to the lines that stay, and n_lines and n_dropped (renamed if taken).
    index: one that holds docs already, and maybe others; else a new one takes them."""
    if index is None:
        index = LineIndex(docs.sparkSession, rules=rules)
        index.insert(docs, id_col, text_col)
    least = index.rules.least_chars
    key, drop = unused(docs, "_doc"), unused(docs, "_drop")
    lost = index.lost().groupBy(F.col("doc").alias(key)).agg(F.collect_set("key").alias(drop))  # a document's keys are bounded by its length
    joined = docs.join(lost.hint("merge"), docs[id_col].eqNullSafe(lost[key]), "left").drop(key)  # the same plan at every size
    new = [docs.schema[text_col], T.StructField(unused(docs, "n_lines"), T.LongType()), T.StructField(unused(docs, "n_dropped"), T.LongType())]

    def cut(text, drop):
        lines = (text or "").split("\n")
        if not drop:
            return text, len(lines), 0
        gone = set(drop)
        kept = [x for x in lines if line_key(x, least) not in gone]
        return "\n".join(kept), len(lines), len(lines) - len(kept)

    return extended(joined, [text_col, drop], cut, new, (drop,))
