"""Repeated passages by relative Lempel-Ziv parsing against an index of reference blocks.

Every document is cut into blocks at content-defined anchors: a window of WINDOW words belongs to the smallest hash
among its word n-grams (leftmost on ties), and consecutive windows with the same anchor occurrence form one block. The
cut depends on content alone, so a passage that occurs in two documents is cut alike inside, whatever surrounds it.

The reference is every distinct block, once, where it occurs first: (anchor, content) with the smallest document that has
it and its place there. Every block of every document is looked up in this index. A block found in a smaller document
points there as a whole. Where it isn't, a factor ends, and the boundary is checked: if the reference holds blocks
with this anchor but other surroundings, the windows of the block are looked up one by one among the windows of all those.
Then each document is parsed greedily from left to right: a factor starts at the first window that points anywhere
and grows, block by block or window by window, as long as the next one points to where its source goes on. So a factor
is the longest stretch from its start that the reference holds in one piece; it has WINDOW words at least. The words
under factors are the duplicate spans.

This finds exactly the windows that also start in a smaller document: equal windows have equal anchors at equal
offsets, so they lie in blocks with one anchor, and those are all compared. Windows are compared by 128 bits of hash.

Scale: rows shuffled are blocks (one per some twenty words), by anchor and content, then windows of boundary blocks, one
copy per distinct block. A passage in a third of all documents is combined to one row per task before it moves; what is
counted per anchor are distinct blocks. Joins have a stored, unique side, so that AQE may split a hot key of the other.

Cases: null texts have no words; texts under WINDOW words have no window and lose nothing. Rows that repeat a doc_id are
one document, judged alike. A null doc_id counts as smaller than all others. A block that its first document holds twice
points to either place. Very long texts are processed whole. An empty table gives an empty result. Columns of the table
keep their names and values; ours get an underscore where a name is taken.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import OUT_ROWS, extended, packed, stored, struct, unused

#: Odd multiplier of the rolling hashes, and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)
U = np.uint64


@dataclass(frozen=True)
class SpanRules:
    window: int = 50
    gram: int = 12


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * MIX
    x = (x ^ (x >> U(29))) * MIX
    return x ^ (x >> U(32))


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of width words."""
    n = len(words)
    sums = np.zeros(n + 1, U)
    np.cumsum(words * powers(BASE, n), out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * powers(INVERSE, n - width + 1))


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, by prefix and suffix minima of chunks."""
    n = len(x)
    size = -(-n // width) * width
    full = np.full(size, np.iinfo(U).max, U)
    full[:n] = x
    chunks = full.reshape(-1, width)
    left = np.minimum.accumulate(chunks, axis=1).ravel()
    right = np.minimum.accumulate(chunks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


class Words:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 200_000):
        self.seen: dict[bytes, int] = {}
        self.most = most

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.seen) > self.most:
            self.seen.clear()
        seen = self.seen
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, words), U, len(words))


def blocks(words: np.ndarray, rules: SpanRules) -> tuple[np.ndarray, ...] | None:
    """Per block: anchor, content hash, first window, number of windows. Also the hash of every window."""
    if len(words) < rules.window:
        return None
    grams = rolling(words, rules.gram)
    bits = max(1, int(len(grams)).bit_length())
    place = np.arange(len(grams), dtype=U)
    low = window_minima((grams >> U(bits) << U(bits)) | place, rules.window - rules.gram + 1) & U((1 << bits) - 1)
    starts = np.flatnonzero(np.diff(low, prepend=low[0] + U(1)))
    anchor = low[starts].astype(np.int64)
    counts = np.diff(starts, append=len(low))
    windows = rolling(words, rules.window)
    # a block is told by its anchor's offset, its windows' number, and a hash over its windows
    sums = np.add.reduceat(windows * powers(BASE, int(counts.max()))[np.arange(len(low)) - np.repeat(starts, counts)], starts)
    content = mixed(sums ^ mixed((anchor - starts).astype(U) * U(1 << 20) + counts.astype(U)))
    return grams[anchor], content, starts, counts, windows


def block_rows(docs: DataFrame, id_col: str, text_col: str, rules: SpanRules) -> DataFrame:
    """(doc, anchor, content, first, n): every block of every document."""
    doc_type = docs.schema[id_col].dataType.simpleString()
    schema = struct(("doc", doc_type), ("anchor", "long"), ("content", "long"), ("first", "int"), ("n", "int"))

    def run(batches):
        words, kind = Words(), None
        out: list[tuple] = []
        size = 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                found = blocks(words.hashes((text.as_py() or "").encode().split()), rules)
                if found:
                    anchor, content, first, n, _ = found
                    out.append((doc.as_py(), anchor.view(np.int64), content.view(np.int64), first.astype(np.int32), n.astype(np.int32)))
                    size += len(n)
                    if size >= 20 * OUT_ROWS:
                        yield flush(out, kind)
                        out, size = [], 0
        if out:
            yield flush(out, kind)

    def flush(out, kind):
        ids = pa.array([x[0] for x in out], kind).take(pa.array(np.repeat(np.arange(len(out)), [len(x[1]) for x in out])))
        return pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate([x[i] for x in out])) for i in range(1, 5))], ["doc", "anchor", "content", "first", "n"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def window_rows(docs: DataFrame, id_col: str, text_col: str, wanted: str, rules: SpanRules) -> DataFrame:
    """(doc, anchor, window, first): the windows of the blocks whose first windows are listed in the column wanted."""
    schema = struct(("doc", docs.schema[id_col].dataType.simpleString()), ("anchor", "long"), ("window", "long"), ("first", "int"))
    arrow = None

    def run(batches):
        nonlocal arrow
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, words = to_arrow_schema(schema), Words()
        out: list[tuple] = []
        for batch in batches:
            for doc, text, firsts in zip(*batch.columns, strict=True):
                anchor, _, start, n, windows = blocks(words.hashes((text.as_py() or "").encode().split()), rules)
                anchor, windows = anchor.view(np.int64), windows.view(np.int64)
                doc = doc.as_py()
                for k in np.searchsorted(start, np.unique(firsts.as_py())):
                    a = int(anchor[k])
                    out.extend((doc, a, int(windows[w]), w) for w in range(int(start[k]), int(start[k] + n[k])))
                    if len(out) >= 10 * OUT_ROWS:
                        yield packed(out, arrow)
                        out = []
        if out:
            yield packed(out, arrow)

    return docs.select(id_col, text_col, wanted).mapInArrow(run, schema)


def smaller(own: str, none: str, doc: str):
    """Whether the document own (none: one without an id, which comes first) comes before doc."""
    return F.col(doc).isNotNull() & (F.col(none) | F.coalesce(F.col(own) < F.col(doc), F.lit(False)))


def owned(rows: DataFrame, *key: str) -> DataFrame:
    """Per key the first document with it (own, or none), its place there, and how many rows have it."""
    first = rows.groupBy(*key).agg(F.bool_or(F.col("doc").isNull()).alias("none"), F.min("doc").alias("own"), F.min_by("first", "doc").alias("at"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("k"))
    return first.withColumn("at", F.when(~F.col("none"), F.col("at")))


def pointers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: SpanRules | None = None) -> DataFrame:
    """(doc, spans): per document with duplicate windows, array of (first window, number of windows, own: the document that
    has them first, at: where), own and at null for a document without an id."""
    rules = rules or SpanRules()
    rows = stored(block_rows(docs, id_col, text_col, rules), "blocks")
    blocks_of = stored(owned(rows, "anchor", "content"), "reference-blocks")
    # anchors in one document only have nothing to look up; where all blocks with an anchor are alike, there is no boundary
    several = (F.col("lo") != F.col("hi")) | (F.col("none") & F.col("lo").isNotNull())
    anchors = blocks_of.groupBy("anchor").agg(F.min("own").alias("lo"), F.max("hi").alias("hi"), F.bool_or("none").alias("none"), (F.count(F.lit(1)) > 1).alias("edge")).filter(several).select("anchor", "edge")
    index = stored(blocks_of.join(anchors, "anchor").select("anchor", "content", "own", "none", "at", "edge"), "index")
    told = stored(rows.join(index, ["anchor", "content"]), "told")
    points = smaller("own", "none", "doc")
    whole = told.filter(points).select("doc", "first", "n", F.when(~F.col("none"), F.col("own")).alias("own"), "at")
    # a block's first document looks at its boundary window by window
    asked = told.filter(~points & F.col("edge")).groupBy("doc").agg(F.collect_set("first").alias("_firsts")).withColumnRenamed("doc", "_doc")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(asked, F.col("_id").eqNullSafe(F.col("_doc"))).drop("_doc")
    windows = stored(window_rows(texts, "_id", "_text", "_firsts", rules), "edge-windows")
    first_in = stored(owned(windows, "anchor", "window").filter("k > 1 AND (own != hi OR none)").drop("k", "hi"), "reference-windows")
    single = windows.join(first_in, ["anchor", "window"]).filter(points).select("doc", "first", F.lit(1).alias("n"), F.when(~F.col("none"), F.col("own")).alias("own"), "at")
    return whole.unionByName(single).groupBy("doc").agg(F.collect_list(F.struct("first", "n", "own", "at")).alias("spans"))


def parse(found: list, window: int) -> list[tuple]:
    """Greedy factors (start, stop, source, source's start) over words. A factor goes on while the next windows point to where its source goes on."""
    out: list[list] = []
    for first, n, own, at in sorted(((s["first"], s["n"], s["own"], s["at"]) for s in found), key=lambda s: (s[0], -s[1])):
        last = out[-1] if out else None
        if last and last[1] == first and at is not None and last[2] == own and last[3] + first - last[0] == at:
            last[1] += n
        elif not last or first + n > last[1]:  # rows that repeat a document point twice
            out.append([first, first + n, own, at])
    return [(a, b + window - 1, own, at) for a, b, own, at in out]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: SpanRules | None = None) -> DataFrame:
    """docs, all columns, plus n_words, n_removed, factors array<(start, stop, source, source_start)> over words, and
    kept_words: the words left, joined by one space (names taken by docs get an underscore)."""
    rules = rules or SpanRules()
    key, spans = unused(docs, "_doc"), unused(docs, "_spans")
    found = pointers(docs, id_col, text_col, rules).withColumnsRenamed({"doc": key, "spans": spans})
    joined = docs.join(found, docs[id_col].eqNullSafe(found[key]), "left").drop(key)
    kind = docs.schema[id_col].dataType.simpleString()
    kinds = ("long", "long", f"array<struct<start:int,stop:int,source:{kind},source_start:int>>", "string")
    fields = struct(*zip((unused(docs, c) for c in ("n_words", "n_removed", "factors", "kept_words")), kinds, strict=True)).fields

    def cut(text, found):
        words = (text or "").encode().split()
        factors = parse(found or [], rules.window)
        kept, at = [], 0
        for a, b, _, _ in factors:
            kept += words[at:a]
            at = max(at, b)
        kept += words[at:]
        return len(words), len(words) - len(kept), [dict(zip(("start", "stop", "source", "source_start"), f, strict=True)) for f in factors], b" ".join(kept).decode()

    return extended(joined, [text_col, spans], cut, fields, (spans,))
