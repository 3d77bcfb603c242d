"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new capacities.

The sizes of the old shards are supplies, the capacities of the new ones demands, and a byte that changes its shard
costs 1 (or what a cost matrix says). The flow's arcs are block transfers. Rows lie per old shard in blocks; running
sums of bytes over the blocks, and within each block, give every row a position, and each arc takes an interval of
positions. Rows too large for that (over 1 / BIG_SHARE of a capacity; there are at most (BIG_SHARE + 1) * n_new of
them, whatever the input) are placed first, one by one, inside the flow's budgets where they fit; a second flow then
spreads the rest over what is left, so that sizes differ by small rows only.

rewrite() takes positions in the order of the old files, so what moves are ranges of consecutive rows of a file: as many
as there are files, arcs and, twice, large rows. This list is sent to the tasks, each reads its files once and
writes what it reads to the new shards; no text is shuffled.

Scale: the driver sees the old shards' sizes, the bounded list of large rows and the arcs. Sizes (not texts) shuffle by
(old shard, block), so an old shard with a third of all rows is still cut in many blocks. Equal texts are placed row by
row: a group of copies may be larger than a shard, so it isn't kept together.

Cases: null ids, texts and sizes are ordinary rows (a null size counts as 0). A row whose old shard is null or isn't
one of them is new: it moves, wherever it goes. Repeated rows and ties are told apart by a row number that is stored
before anything depends on it, or by their place in a file. An empty table gives an empty result. Very long texts are
large rows. Columns of any name stay as they are; if one is called shard or slot, ours get an underscore.
"""

from __future__ import annotations

import functools
import heapq
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetgauge.llm.common import fresh_path, stored, unused

BIG_SHARE = 200
N_BLOCKS = 512
#: Rows of a file that make a block of it.
BLOCK_ROWS = 4096
#: Columns of a rewritten layout; those that the rows have under other names stay.
SHARD, SLOT = "reshard_shard", "reshard_slot"


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """Flows {(i, j): amount} that ship all supply into demand at least cost; sum(supply) <= sum(demand).
    Successive shortest paths on the bipartite graph, with potentials, so that each path is one Dijkstra run."""
    n, m = len(supply), len(demand)
    flow: dict[tuple[int, int], int] = {}
    left, room = list(supply), list(demand)
    high = [0] * (n + m)
    while any(left):
        dist, back, done = [float("inf")] * (n + m), [-1] * (n + m), set()
        heap = []
        for i in range(n):
            if left[i]:
                dist[i] = 0
                heap.append((0, i))
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            if u < n:
                steps = ((n + j, cost[u][j]) for j in range(m))
            else:
                steps = ((i, -cost[i][u - n]) for i in range(n) if flow.get((i, u - n)))
            for v, c in steps:
                new = d + c + high[u] - high[v]
                if new < dist[v]:
                    dist[v], back[v] = new, u
                    heapq.heappush(heap, (new, v))
        end = min((n + j for j in range(m) if room[j]), key=lambda v: dist[v] + high[v])
        reach = max(x for x in dist if x < float("inf"))
        high = [h + min(x, reach) for h, x in zip(high, dist, strict=True)]
        path, v = [], end
        while back[v] >= 0:
            path.append((back[v], v))
            v = back[v]
        amount = min([left[v], room[end - n], *(flow[b, a - n] for a, b in path if a >= n)])
        left[v] -= amount
        room[end - n] -= amount
        for a, b in path:
            if a < n:
                flow[a, b - n] = flow.get((a, b - n), 0) + amount
            else:
                flow[b, a - n] -= amount
    return {k: x for k, x in sorted(flow.items()) if x}


def capacities(total: int, n: int) -> list[int]:
    return [total // n + (j < total % n) for j in range(n)]


def move_cost(n_old: int, n_new: int) -> list[list[int]]:
    return [[int(i != j) for j in range(n_new)] for i in range(n_old)]


def place_big(rows: list[tuple[int, int, int]], budget: dict[tuple[int, int], int], demand: list[int]) -> tuple[dict[int, int], list[int]]:
    """Shard of each large row (row number, old shard, size), largest first: where the flow sends its old shard's bytes
    if it fits there, else where most room is left. Also the room left afterwards."""
    budget, room, at = dict(budget), list(demand), {}
    arcs: dict[int, list[int]] = {}
    for i, j in budget:
        arcs.setdefault(i, []).append(j)
    for row, old, size in sorted(rows, key=lambda r: (-r[2], r[0])):
        fits = [j for j in arcs.get(old, ()) if budget[old, j] >= size and room[j] >= size]
        j = old if old in fits else max(fits, key=lambda j: budget[old, j]) if fits else max(range(len(room)), key=room.__getitem__)
        budget[old, j] = budget.get((old, j), 0) - size
        room[j] -= size
        at[row] = j
    return at, room


def plan(sizes: list[int], big: list[tuple[int, int, int]], n_new: int, cost: list[list[int]] | None = None) -> tuple[dict[int, int], list[tuple[int, int, int, int]]]:
    """Shards of the large rows, and arcs (old, new, from, to) over the positions of the other rows' bytes."""
    cost = cost or move_cost(len(sizes), n_new)
    want = capacities(sum(sizes), n_new)
    at, room = place_big(big, min_cost_flow(sizes, want, cost), want)
    small = list(sizes)
    for _, old, size in big:
        small[old] -= size
    room = [max(0, r) for r in room]
    if over := sum(room) - sum(small):  # a row larger than a capacity leaves less to the others
        for k, j in enumerate(sorted(range(n_new), key=room.__getitem__)):
            take = min(room[j], -(-over // (n_new - k)))
            room[j] -= take
            over -= take
    arcs, start = [], [0] * len(small)
    flow = min_cost_flow(small, room, cost)
    for (i, j), amount in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        arcs.append((i, j, start[i], start[i] + amount))
        start[i] += amount
    return at, arcs


def _placed(base: DataFrame, n_old: int, n_new: int, cost: list[list[int]] | None) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """base (old, block, at, w, ..) plus the shard of each row, and the arcs. base is stored; rows of one old shard follow
    each other by block, then at."""
    spark = base.sparkSession
    found = {r.old: r.w for r in base.groupBy("old").agg(F.sum("w").alias("w")).collect()}  # n_old + 1 rows
    sizes = [int(found.get(i, 0)) for i in range(n_old + 1)]
    least = max(1, sum(sizes) // n_new // BIG_SHARE)
    big = sorted(base.filter(F.col("w") > least).select("block", "at", "old", "w").collect())  # at most (BIG_SHARE + 1) * n_new rows
    at, arcs = plan(sizes, [(k, r.old, r.w) for k, r in enumerate(big)], n_new, [*(cost or move_cost(n_old, n_new)), [1] * n_new])
    alone = spark.createDataFrame([(big[k].block, big[k].at, j) for k, j in at.items()], base.select("block", "at", F.lit(0).alias("_alone")).schema)
    to = spark.createDataFrame(arcs, "_o int, _shard int, _from long, _to long")
    rows = base.join(F.broadcast(alone), ["block", "at"], "left").withColumn("_small", F.when(F.col("_alone").isNull(), F.col("w")).otherwise(F.lit(0)))
    blocks = rows.groupBy("old", "block").agg(F.sum("_small").alias("_bytes"))
    before = blocks.select("old", "block", (F.sum("_bytes").over(W.partitionBy("old").orderBy("block")) - F.col("_bytes")).alias("_before"))
    run = F.sum("_small").over(W.partitionBy("old", "block").orderBy("at")) - F.col("_small")
    rows = rows.withColumn("_run", run).join(before, ["old", "block"]).withColumn("_mid", F.expr("_before + _run + _small div 2"))
    inside = (F.col("old") == F.col("_o")) & F.col("_alone").isNull() & (F.col("_mid") >= F.col("_from")) & (F.col("_mid") < F.col("_to"))
    rows = rows.join(F.broadcast(to), inside, "left").withColumn("shard", F.coalesce("_alone", "_shard"))
    return rows.select(*base.columns, "shard"), arcs


def _ranked(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """placed plus the rank of a row among those of its shard, old shard and block; and how many rows of the shard lie before
    these (shard, old, block, offset)."""
    piece = ["shard", "old", "block"]
    counts = placed.groupBy(*piece).agg(F.count(F.lit(1)).alias("n"))
    offset = counts.select(*piece, (F.sum("n").over(W.partitionBy("shard").orderBy("old", "block")) - F.col("n")).alias("offset"))
    return placed.withColumn("rank", F.row_number().over(W.partitionBy(*piece).orderBy("at")) - 1), offset


def _known(old, n_old: int):
    """The old shard, n_old where there is none."""
    return F.when(old.between(0, n_old - 1), old).otherwise(F.lit(n_old)).cast("int")


def assign(rows: DataFrame, size: str, old: str, n_old: int, n_new: int, cost: list[list[int]] | None = None) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """rows (with a size and an old shard below n_old) plus shard int and slot long, gapless from 0 in each shard; and the arcs."""
    number = F.monotonically_increasing_id()
    weight = F.greatest(F.coalesce(F.col(f"`{size}`"), F.lit(0)), F.lit(1)).cast("long")  # one byte at least, so that each row has a position
    base = stored(rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), _known(F.col(f"`{old}`"), n_old).alias("old"), F.pmod(F.xxhash64(number), F.lit(N_BLOCKS)).cast("int").alias("block"), number.alias("at"), weight.alias("w")), "reshard")
    placed, arcs = _placed(base, n_old, n_new, cost)
    ranked, offset = _ranked(placed)
    out = ranked.join(offset, ["shard", "old", "block"])
    return out.select("row.*", F.col("shard").alias(unused(rows, "shard")), (F.col("offset") + F.col("rank")).cast("long").alias(unused(rows, "slot"))), arcs


def transfers(rows: DataFrame, file: str, at: str, old: str, size: str, n_old: int, n_new: int) -> DataFrame:
    """(file, lo, hi, old, shard, slot): the rows lo to hi of a file go to a shard, where lo gets that slot. At most one range
    per file and arc, and two per large row."""
    weight = F.greatest(F.coalesce(F.expr(size), F.lit(0)), F.lit(1)).cast("long")
    base = rows.select(_known(F.col(old), n_old).alias("old"), F.struct(F.col(file).alias("file"), F.expr(f"`{at}` div {BLOCK_ROWS}").alias("n")).alias("block"), F.col(at).alias("at"), weight.alias("w"))
    ranked, offset = _ranked(_placed(stored(base, "sizes"), n_old, n_new, None)[0])
    runs = ranked.groupBy("shard", "old", "block", (F.col("at") - F.col("rank")).alias("run")).agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.min("rank").alias("rank"))
    runs = runs.join(offset, ["shard", "old", "block"]).withColumn("slot", F.col("offset") + F.col("rank"))
    whole = runs.groupBy(F.col("block")["file"].alias("file"), "old", "shard", (F.col("slot") - F.col("lo")).alias("run")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("slot").alias("slot"))
    return whole.select("file", "lo", "hi", "old", "shard", F.col("slot").cast("long").alias("slot"))


def rewrite(spark: SparkSession, layout: dict[int, str], n_new: int, size_expr: str, out: str | None = None) -> dict[int, str]:
    """Reshard Parquet shards {number: path} into n_new shards of near equal size_expr. Only shards that some row leaves
    or enters are written anew, under out, with each row's SLOT; the others keep their files. Returns the new
    {number: path}."""
    out = out or fresh_path(spark, "layout")
    rows, file, at, old = _shards(spark, layout)
    ranges = stored(transfers(rows, file, at, old, size_expr, max(layout) + 1, n_new), "transfers")
    moves = ranges.select("old", "shard").distinct().collect()  # n_old * n_new rows at most
    touched = sorted({x for i, j in moves if i != j for x in (i, j)} | (set(range(n_new)) - set(layout)))
    todo = ranges.filter(F.col("shard").isin(touched)).select(F.struct("file", "lo", "hi", "shard", "slot").alias("_to"))
    moved = rows.join(F.broadcast(todo), (F.col(file) == F.col("_to")["file"]) & F.col(at).between(F.col("_to")["lo"], F.col("_to")["hi"]))
    own = [c for c in rows.columns if c not in (file, at, old, SHARD, SLOT)]
    moved = moved.select(*(F.col(f"`{c}`") for c in own), F.col("_to")["shard"].alias(SHARD), (F.col("_to")["slot"] + F.col(at) - F.col("_to")["lo"]).alias(SLOT))
    moved.sortWithinPartitions(SHARD, SLOT).write.option("compression", "zstd").partitionBy(SHARD).parquet(out)
    kept = {k: p for k, p in layout.items() if k < n_new and k not in touched}
    new = kept | {k: f"{out}/{SHARD}={k}" for k in sorted({m[1] for m in moves} & set(touched))}
    spark.createDataFrame([(json.dumps(new, sort_keys=True),)], "value string").coalesce(1).write.text(f"{out}/_manifest")
    return dict(sorted(new.items()))


def _shards(spark: SparkSession, layout: dict[int, str]) -> tuple[DataFrame, str, str, str]:
    """The rows of all shards, and the names of three more columns: file and place, which tell a row, and the shard."""
    every = spark.read.option("mergeSchema", "true").parquet(*(layout[k] for k in sorted(layout)))  # all footers, in one job
    parts = {k: spark.read.schema(every.schema).parquet(path) for k, path in sorted(layout.items())}
    file, at, old = (unused(every, x) for x in ("reshard_file", "reshard_at", "reshard_old"))
    told = [p.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at), F.lit(k).alias(old)) for k, p in parts.items()]
    return functools.reduce(DataFrame.unionByName, told), file, at, old


def read_layout(spark: SparkSession, layout: dict[int, str]) -> DataFrame:
    """The rows of a layout that rewrite() returned, with SHARD and SLOT. A shard that no rewrite touched is numbered in the
    order of its files."""
    rows, file, at, old = _shards(spark, layout)
    rows = rows.withColumnRenamed(old, SHARD)
    order = F.row_number().over(W.partitionBy(SHARD).orderBy(file, at)) - 1
    if SLOT not in rows.columns:
        return rows.withColumn(SLOT, order.cast("long")).drop(file, at)
    bare = [r[0] for r in rows.filter(F.col(SLOT).isNull()).select(SHARD).distinct().collect()]  # one per shard at most
    if not bare:
        return rows.drop(file, at)
    plain = rows.filter(F.col(SHARD).isin(bare)).withColumn(SLOT, order.cast("long"))
    return rows.filter(~F.col(SHARD).isin(bare)).unionByName(plain).drop(file, at)
