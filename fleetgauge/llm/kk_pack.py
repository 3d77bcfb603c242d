"""Packing by Karmarkar-Karp multiway differencing.

Every document becomes its token ids and one end id. Whole windows of a document stand alone; the rest is cut into
pieces of at most PIECE ids. Pieces are dealt by hash into groups of some GROUP windows, and each group is divided
into k windows of near equal content: each piece starts as a partial partition (its size and k - 1 zeros); the two
partitions with the largest imbalance are merged, the largest part of one with the smallest of the other, until one is
left. k starts at the least possible number of windows and rises by one whenever a part exceeds the capacity.

Scale: text is read and tokenised once and never shuffled; pieces (some 40 bytes a row) are stored, counted, and dealt
to groups whose number follows the input, so a group is bounded whatever the input. The group of a piece depends on
its document, place and content, so copies and documents of any length spread over all groups.

Cases: null and empty texts are the end id alone. Repeated rows are packed each, under ids of their own. An empty table
gives no piece.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import stored, struct
from fleetgauge.llm.tokens import encode, encoder


@dataclass(frozen=True)
class PackRules:
    length: int = 1024
    piece: int = 256
    group: int = 128
    end_id: int = 0


def multiway(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of sizes in k parts of near equal sums. Zero parts of a partial partition are not kept, so that merging
    small partitions is cheap."""
    # (-imbalance, tie, parts descending as (sum, indices)); missing parts are zero
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        meet = len(a) + len(b) - k  # so many parts of both have to be joined
        joined = _join(a, b, meet) if meet > 0 else a + b
        joined.sort(key=lambda p: -p[0])
        low = joined[-1][0] if len(joined) == k else 0
        heapq.heappush(heap, (-(joined[0][0] - low), tie, joined))
        tie += 1
    parts = [p[1] for p in heap[0][2]] if heap else []
    return parts + [[] for _ in range(k - len(parts))]


def _join(a: list, b: list, meet: int) -> list:
    """a and b, descending, as parts of one partition: in the full partitions a's j-th largest meets b's j-th smallest,
    so a's last meet parts meet b's last ones in opposite order."""
    out = a[: len(a) - meet] + b[: len(b) - meet]
    for x, y in zip(a[len(a) - meet :], reversed(b[len(b) - meet :]), strict=True):
        out.append((x[0] + y[0], x[1] + y[1]))
    return out


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of indices, none over capacity; sizes are at most capacity each."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = [p for p in multiway(sizes, k) if p]
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return parts
        k += 1


def pieces(docs: DataFrame, id_col: str, text_col: str, rules: PackRules, vocabulary: str | None = None) -> DataFrame:
    """(doc, start, length, ids_crc32, doc_tokens): the cut documents. No shuffle."""
    schema = struct((f"`{id_col}`", docs.schema[id_col].dataType.simpleString()), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"))

    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                row, start, length, crc, total = [], [], [], [], []
                for i, text in enumerate(part.column(1)):
                    ids = np.append(encode(enc, text.as_py() or ""), np.uint32(rules.end_id)).astype("<u4")
                    whole = len(ids) // rules.length * rules.length
                    cuts = [*range(0, whole, rules.length), *range(whole, len(ids), rules.piece)]
                    for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True):
                        row.append(i)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b]))
                        total.append(len(ids))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], [id_col, "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: PackRules | None = None, vocabulary: str | None = None) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id (unique, not gapless) and offset in its sequence."""
    rules = rules or PackRules()
    cut = stored(pieces(docs, id_col, text_col, rules, vocabulary), "pieces")
    total = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (rules.group * rules.length)))
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64(id_col, "start", "ids_crc32", "length"), F.lit(groups)))
    schema = struct(*((f"`{f.name}`", f.dataType.simpleString()) for f in cut.schema.fields), ("sequence_id", "long"), ("offset", "long"))

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in cut_columns])
        sizes = rows.column("length").to_pylist()
        short = [i for i, s in enumerate(sizes) if s < rules.length]
        windows = [[i] for i, s in enumerate(sizes) if s >= rules.length]
        windows += [[short[i] for i in p] for p in pack([sizes[i] for i in short], rules.length)]
        number, offset = [0] * len(sizes), [0] * len(sizes)
        for w, members in enumerate(windows):
            at = 0
            for i in sorted(members):
                number[i], offset[i] = key[0].as_py() << 24 | w, at
                at += sizes[i]
        return rows.drop_columns(["_group"]).append_column("sequence_id", pa.array(number, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    cut_columns = cut.columns
    return dealt.groupBy("_group").applyInArrow(fill, schema)
