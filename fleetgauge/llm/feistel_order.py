"""Training order on disk: token sequences at the slots of a keyed permutation, in fixed-stride shards.

Documents become token ids (and an end id) and follow each other, within a task, in sequences of STRIDE ids; only a
task's last one is padded. The sequences are stored once, numbered without gaps from the partitions' counts, and a
Feistel network over the least even number of bits that holds all numbers, with cycle-walking past those outside,
maps each number to a slot. The permutation needs no table, is the same on every machine, and has an inverse. A shard
is a range of ROWS consecutive slots: the sequences go to the task of their shard, which writes them in order, STRIDE * 2
bytes each, so a reader seeks to any slot with one division.

Scale: one shuffle, of compressed ids, each to the shard that one division gives; slots are pseudorandom, so hot sources
and copies spread evenly and all shards but the last are equally large. A task holds one shard, STRIDE * ROWS * 2 bytes, and
writes it under a name of its own, renamed when complete, so lost and repeated tasks leave whole shards. The driver sees one
count per input task.

Cases: null and empty texts are the end id alone. Repeated rows and ties are written each. An empty table gives
no row and no shard. Documents of any length are cut, one document in memory at a time. Only id and text are read, so
other columns may have any name.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fleetgauge.llm.common import OUT_ROWS, fresh_path, packed, stored, struct
from fleetgauge.llm.tokens import encode, encoder

U = np.uint64


@dataclass(frozen=True)
class OrderRules:
    """ids are written as little-endian uint16; the vocabulary has 50,257."""

    stride: int = 512
    rows: int = 32_768
    end_id: int = 50_256
    pad_id: int = 50_256
    key: int = 20_240_601
    rounds: int = 8


def round_keys(key: int, rounds: int) -> list[int]:
    out = []
    for _ in range(rounds):
        key = (key + 0x9E3779B97F4A7C15) % (1 << 64)
        z = (key ^ key >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
        z = (z ^ z >> 27) * 0x94D049BB133111EB % (1 << 64)
        out.append(z ^ z >> 31)
    return out


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    x = x + U(key)
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def permuted(numbers: np.ndarray, n: int, key: int, rounds: int = 8, inverse: bool = False) -> np.ndarray:
    """Image of each number below n under the keyed permutation of range(n), or its preimage."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, keys = U((1 << half) - 1), round_keys(key, rounds)
    out, todo = numbers.astype(U), np.arange(len(numbers))
    while len(todo):
        x = out[todo]
        left, right = x >> U(half), x & mask
        if inverse:
            for k in reversed(keys):
                left, right = right ^ (_scramble(left, k) & mask), left
        else:
            for k in keys:
                left, right = right, left ^ (_scramble(right, k) & mask)
        out[todo] = left << U(half) | right
        todo = todo[out[todo] >= U(n)]  # walk on until inside
    return out.astype(np.int64)


def sequences(docs: DataFrame, id_col: str, text_col: str, rules: OrderRules, vocabulary: str | None = None) -> DataFrame:
    """(part, row, n_tokens, ids_crc32, docs, ids): sequences, numbered within the task that made them. docs tells which ids
    of which documents: (doc, start, length), in their order."""
    kind = docs.schema[id_col].dataType
    schema = struct(("part", "int"), ("row", "long"), ("n_tokens", "int"), ("ids_crc32", "long"), ("docs", f"array<struct<doc:{kind.simpleString()},start:long,length:int>>"), ("ids", "binary"))
    arrow = to_arrow_schema(schema)

    def run(batches):
        enc, part, made = encoder(vocabulary), TaskContext.get().partitionId(), 0
        out: list[tuple] = []
        held, pieces, n = [], [], 0  # the open sequence

        def full():
            raw = np.full(rules.stride, rules.pad_id, "<u2")
            raw[:n] = np.concatenate(held)
            raw = raw.tobytes()
            return part, made, n, zlib.crc32(raw), pieces, raw

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc = doc.as_py()
                ids = np.append(encode(enc, text.as_py() or ""), np.uint32(rules.end_id)).astype("<u2")
                at = 0
                while at < len(ids):
                    take = min(rules.stride - n, len(ids) - at)
                    held.append(ids[at : at + take])
                    pieces.append({"doc": doc, "start": at, "length": take})
                    n, at = n + take, at + take
                    if n == rules.stride:
                        out.append(full())
                        held, pieces, n, made = [], [], 0, made + 1
                        if len(out) >= OUT_ROWS:
                            yield packed(out, arrow)
                            out = []
        if n:
            out.append(full())
        if out:
            yield packed(out, arrow)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def starts_of(cut: DataFrame) -> np.ndarray:
    """starts[p]: how many sequences the tasks before p made; the last entry is their number. One count per input task."""
    counts = {r.part: r.n for r in cut.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    return np.cumsum([0, *(counts.get(p, 0) for p in range(max(counts, default=-1) + 1))])


def numbered(batch: pa.RecordBatch, starts: np.ndarray, rules: OrderRules) -> np.ndarray:
    """The slots of sequences."""
    return permuted(starts[batch.column("part").to_numpy()] + batch.column("row").to_numpy(), int(starts[-1]), rules.key, rules.rounds)


def pieces(cut: DataFrame, starts: np.ndarray, rules: OrderRules) -> DataFrame:
    """(shard, at, ids): of each batch of sequences what belongs to a shard, compressed, and the places there, as little-endian uint32."""

    def run(batches):
        import zstandard

        compressor = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            slot = numbered(batch, starts, rules)
            order = np.argsort(slot)
            ids = np.frombuffer(b"".join(x.as_buffer() for x in batch.column("ids")), "<u2").reshape(-1, rules.stride)[order]
            slot = slot[order]
            edges = [0, *(np.flatnonzero(np.diff(slot // rules.rows)) + 1), len(slot)]
            groups = [(a, b) for a, b in zip(edges, edges[1:]) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([slot[a] // rules.rows for a, _ in groups], pa.int32()), pa.array([(slot[a:b] % rules.rows).astype("<u4").tobytes() for a, b in groups], pa.binary()), pa.array([compressor.compress(ids[a:b].tobytes()) for a, b in groups], pa.binary())],
                ["shard", "at", "ids"],
            )

    return cut.select("part", "row", "ids").mapInArrow(run, "shard int, at binary, ids binary")


def write_shards(cut: DataFrame, starts: np.ndarray, path: str, rules: OrderRules) -> DataFrame:
    """(shard, file, first_slot, n_rows), stored: the shards written under path, one task each, which holds one shard."""
    n = int(starts[-1])

    def run(batches) -> Iterator[pa.RecordBatch]:
        import zstandard

        shards: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, at, raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "at", "ids")), strict=True):
                if shard not in shards:
                    shards[shard] = np.zeros((min(rules.rows, n - shard * rules.rows), rules.stride), "<u2")
                shards[shard][np.frombuffer(at, "<u4")] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u2").reshape(-1, rules.stride)
        store, base = folder_of(path)
        store.create_dir(base, recursive=True)
        for shard, ids in shards.items():
            temporary, name = f"{base}/.{uuid.uuid4().hex}", f"{base}/shard-{shard:06d}.bin"
            with store.open_output_stream(temporary) as out:
                out.write(ids.data)
            store.move(temporary, name)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], "first_slot": pa.array([shard * rules.rows], pa.int64()), "n_rows": pa.array([len(ids)], pa.int64())})

    sent = pieces(cut, starts, rules).repartitionById(max(1, -(-n // rules.rows)), "shard")
    return stored(sent.mapInArrow(run, "shard int, file string, first_slot long, n_rows long"), "training-order")


def materialise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: OrderRules | None = None, vocabulary: str | None = None, path: str | None = None) -> tuple[DataFrame, str]:
    """Write the raw files <path>/shard-000000.bin. Returns what lies where (slot, shard, at, n_tokens, ids_crc32, docs), and
    the folder; manifest.json there tells stride, rows a shard and number of sequences."""
    rules = rules or OrderRules()
    path = path or fresh_path(docs.sparkSession, "training-order")
    cut = stored(sequences(docs, id_col, text_col, rules, vocabulary), "sequences")
    starts = starts_of(cut)
    n = int(starts[-1])
    whole = write_shards(cut, starts, path, rules).agg(F.sum("n_rows")).first()[0] or 0
    if whole != n:
        raise RuntimeError(f"{whole} of {n} sequences are on disk")
    store, base = folder_of(path)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps({"sequences": n, "stride": rules.stride, "rows": rules.rows, "key": rules.key, "rounds": rules.rounds}).encode())

    def run(batches):
        for batch in batches:
            slot = numbered(batch, starts, rules)
            own = [batch.column(c) for c in ("n_tokens", "ids_crc32", "docs")]
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // rules.rows, pa.int32()), pa.array(slot % rules.rows, pa.int32()), *own], ["slot", "shard", "at", "n_tokens", "ids_crc32", "docs"])

    docs_type = cut.schema["docs"].dataType.simpleString()
    return cut.drop("ids").mapInArrow(run, f"slot long, shard int, at int, n_tokens int, ids_crc32 long, docs {docs_type}"), path


def folder_of(path: str):
    """File system and folder of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def read_from(folder: str, slot: int, rules: OrderRules | None = None) -> Iterator[np.ndarray]:
    """Sequences from a slot on, in training order: what a reader does when it resumes."""
    rules = rules or OrderRules()
    store, base = folder_of(folder)
    size = rules.stride * 2
    shard, at = divmod(slot, rules.rows)
    while store.get_file_info(name := f"{base}/shard-{shard:06d}.bin").is_file:
        with store.open_input_file(name) as f:
            f.seek(at * size)
            while raw := f.read(size):
                yield np.frombuffer(raw, "<u2")
        shard, at = shard + 1, 0
