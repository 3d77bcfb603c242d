"""Near-duplicates by BagMinHash over multisets of word shingles.

A document is the multiset of its shingles of five words (lower case, letters and digits). BagMinHash [Ertl, 2018]
gives each shingle a Poisson process of points over (weight, time, signature slot); a document sees the points below
its shingles' weights, and each slot keeps the earliest point it sees. Two documents agree in a slot with a probability
of exactly their weighted Jaccard similarity. The weight axis is discretised in dyadic cells (0,1], (1,2], (2,4], ..;
a cell's process is generated once for all weights in it, its points fall to unit weights by a hash, and those above the
weight are discarded. A shingle of weight w costs about log2(w) processes. Points later than a bound by which all
slots are very probably filled are not generated; documents with an empty slot double the bound.

Signatures are banded. In each bucket the members are compared with leaders, each verified by exact multiset overlap:
first one leader, then, in buckets whose members lie in more than one component, sixteen, then 256 times as many each
round, until every pair of candidates in different components has been compared. Pairs inside a component need no comparison. So no
link among the candidates is lost, and a bucket of k like documents costs k comparisons. Candidates share a band and
agree in AGREE of all slots; a pair in several buckets is compared once.

Cases: equal word sequences form one node before anything else, so copies of a text cost one row each. Texts without
words (null, empty, punctuation) are alone in their class. Texts of one to four words have one shingle, the whole text.
Rows that repeat a doc_id are classed by their own text. The class id is the least doc_id in the class, null if there
is none.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.common import discard, map_rows, stored, struct, unused
from fleetgauge.llm.components import stars
from fleetgauge.llm.lz_spans import MIX, U, Words, mixed, rolling

WORD = re.compile(r"\w+")
BITS = 2048
GOLDEN = U(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class NearRules:
    """At a similarity of 0.8 a pair shares no band with probability (1 - 0.8 ** 4) ** 20 < 0.00003, and agrees in less
    than 48 of 80 slots with probability < 0.00003."""

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 20
    rows: int = 4
    agree: float = 0.6


def words_of(text: str) -> list[bytes]:
    return [w.encode() for w in WORD.findall(text.lower())]


def content_key(words: list[bytes]) -> bytes | None:
    return xxhash.xxh3_128_digest(b"\x00".join(words)) if words else None


def bag(words: list[bytes], hashes: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their counts; words must not be empty."""
    return np.unique(rolling(hashes.hashes(words), min(k, len(words))), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def bitmap(b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """BITS bits as 64-bit numbers, one set for each shingle and each repeat of it."""
    starts = np.cumsum(b[1]) - b[1]
    repeat = np.arange(int(b[1].sum())) - np.repeat(starts, b[1])
    bits = np.zeros(BITS, bool)
    bits[(mixed(np.repeat(b[0], b[1]) + repeat.astype(U) * GOLDEN) & U(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """BagMinHash signatures, one row of m hashes per bag."""
    out = np.zeros((len(bags), m), U)
    todo, slack = np.arange(len(bags)), 5.0
    while len(todo):
        got, empty = _signatures([bags[i] for i in todo], m, math.log(m) + slack)
        out[todo[~empty]] = got[~empty]
        todo, slack = todo[empty], 2 * slack + 5
    return out


def _signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Signatures from the points up to time reach / (bag's weight), and which bags have an empty slot."""
    items = np.concatenate([b[0] for b in bags])
    weights = np.concatenate([b[1] for b in bags]).astype(U)
    doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    limit = reach / np.array([b[1].sum() for b in bags], float)
    times, slots, marks = [], [], []
    low = 0
    while True:  # cells (0, 1], (1, 2], (2, 4], ..
        inside = weights > U(low)
        if not inside.any():
            break
        width = max(1, low)
        key = mixed(items[inside] ^ mixed(np.full(1, 2 * low + 1, U)))
        w, d = weights[inside], doc[inside]
        t, most = np.zeros(len(key)), limit[d]
        while len(key):
            key = (key ^ (key >> U(31))) * MIX + GOLDEN
            r = mixed(key)
            t = t - np.log1p(-(r >> U(11)).astype(float) * 2.0**-53) / (m * width)
            alive = t <= most
            key, w, d, t, most, r = key[alive], w[alive], d[alive], t[alive], most[alive], r[alive]
            r = mixed(r + GOLDEN)
            slot = ((r & U(0xFFFFFFFF)) * U(m)) >> U(32)
            at = U(low) + U(1) + (((r >> U(32)) * U(width)) >> U(32))
            seen = at <= w
            times.append(t[seen])
            slots.append(d[seen] * m + slot[seen].astype(np.int64))
            marks.append(r[seen])
        low = max(1, 2 * low)
    time, slot, mark = np.concatenate(times), np.concatenate(slots), np.concatenate(marks)
    first = np.full(len(bags) * m, np.inf)
    np.minimum.at(first, slot, time)
    out = np.zeros(len(bags) * m, U)
    best = time == first[slot]
    out[slot[best]] = mark[best]
    return out.reshape(-1, m), np.isinf(first).reshape(-1, m).any(1)


def band_keys(sig: np.ndarray, rules: NearRules) -> np.ndarray:
    """One 64-bit key per band and document."""
    parts = sig.reshape(len(sig), rules.bands, rules.rows)
    key = np.broadcast_to(mixed(np.arange(1, rules.bands + 1, dtype=U) * GOLDEN), parts.shape[:2]).copy()
    for i in range(rules.rows):
        key = mixed(key ^ parts[:, :, i])
    return key.view(np.int64)


def signed(docs: DataFrame, id_col: str, text_col: str, rules: NearRules) -> DataFrame:
    """(doc, c, keys, sig, size): content key, band keys, 16 bits of each signature slot, weight and bitmap of each row with words."""
    schema = struct(("doc", docs.schema[id_col].dataType.simpleString()), ("c", "binary"), ("keys", "array<long>"), ("sig", "array<short>"), ("size", "long"), ("bits", "array<long>"))

    def run(batches):
        hashes = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [words_of(x.as_py() or "") for x in part.column(1)]
                has = [i for i, w in enumerate(texts) if w]
                if not has:
                    continue
                bags = [bag(texts[i], hashes, rules.shingle) for i in has]
                sig = signatures(bags, rules.bands * rules.rows)
                keys, slots = band_keys(sig, rules), (sig >> U(48)).astype(np.uint16).view(np.int16)
                columns = [part.column(0).take(pa.array(has)), pa.array([content_key(texts[i]) for i in has], pa.binary()), pa.array(list(keys), pa.list_(pa.int64())), pa.array(list(slots), pa.list_(pa.int16())), pa.array([int(b[1].sum()) for b in bags], pa.int64()), pa.array([bitmap(b) for b in bags], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "c", "keys", "sig", "size", "bits"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def node_texts(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(c, text): a text for each content key in nodes."""
    rep = members.groupBy("c").agg(F.min("doc").alias("_doc"))
    asked = nodes.join(rep, "c").withColumnRenamed("c", "_c")
    rows = docs.select(id_col, text_col).join(asked.hint("merge"), docs[id_col].eqNullSafe(asked["_doc"])).select("_c", text_col)

    def check(c, text):
        if content_key(words_of(text or "")) == c:
            yield c, text

    texts = map_rows(rows, ["_c", text_col], check, struct(("c", "binary"), ("text", "string")))
    again = members.join(rep.filter(F.col("_doc").isNotNull()), "c").filter(F.col("doc") == F.col("_doc")).groupBy("c").count().filter("count > 1")
    if not again.isEmpty() or not rep.filter(F.col("_doc").isNull()).isEmpty():  # repeated rows
        texts = texts.groupBy("c").agg(F.first("text").alias("text"))
    return stored(texts, "near-texts")


def verified(pairs: DataFrame, texts: DataFrame, rules: NearRules) -> DataFrame:
    """The pairs (a, b) whose bags overlap enough."""
    left = texts.select(F.col("c").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("c").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")

    def setup():
        return Words(), {}

    def check(a, b, ta, tb, state):
        hashes, last = state
        if last.get("b") != b:  # the join leaves rows of one leader together
            last.update(b=b, bag=bag(words_of(tb), hashes, rules.shingle))
        if overlap(bag(words_of(ta), hashes, rules.shingle), last["bag"]) >= rules.similarity - 1e-12:
            yield a, b

    return map_rows(both, ["a", "b", "ta", "tb"], check, struct(("a", "binary"), ("b", "binary")), setup)


def candidates(left: DataFrame, leaders: int, rules: NearRules) -> DataFrame:
    """(a, b): members of open buckets, each with the leaders of other components in its bucket. A pair comes from the
    first band in which it agrees only, and only if sizes, signatures and bitmaps allow the similarity: a bit that only one
    bag sets is a shingle that the other lacks, which bounds the overlap from above. left: (k, n, c, h, label, keys, sig,
    size, bits); a bucket's leaders are its members with the least h, some `leaders` of them."""
    names = ("c", "label", "h", "keys", "sig", "size", "bits")
    lead = left.filter(F.col("h").cast("double") * F.col("n") < F.lit(float(leaders) * (1 << 40))).select("k", *(F.col(c).alias(f"{c}_b") for c in names))
    first = F.array_intersect("keys", "keys_b")[0] == F.col("k")
    sizes = F.least("size", "size_b") >= F.greatest("size", "size_b") * (rules.similarity - 1e-12)
    equal = F.expr(f"aggregate(zip_with(sig, sig_b, (x, y) -> int(x = y)), 0, (s, v) -> s + v) >= {math.ceil(rules.agree * rules.bands * rules.rows)}")
    only = lambda x, y: F.expr(f"aggregate(zip_with({x}, {y}, (x, y) -> bit_count(x & ~y)), 0, (s, v) -> s + v)")
    most = F.least(F.col("size") - only("bits", "bits_b"), F.col("size_b") - only("bits_b", "bits"))
    possible = most >= (F.col("size") + F.col("size_b") - most) * (rules.similarity - 1e-12)
    lead = lead.withColumnRenamed("k", "kb")
    once = (F.col("h") > F.col("h_b")) | (F.col("h").cast("double") * F.col("n") >= F.lit(float(leaders) * (1 << 40)))
    member = left.select("k", "n", *names)
    cond = (F.col("k") == F.col("kb")) & (F.col("label") != F.col("label_b")) & once & sizes & first & equal & possible
    return member.join(lead, cond).select(F.col("c").alias("a"), F.col("c_b").alias("b")).distinct()


def links(docs: DataFrame, id_col: str, text_col: str, members: DataFrame, buckets: DataFrame, nodes: DataFrame, rules: NearRules) -> DataFrame:
    """(a, b): each content key in a class of several, with the least of its class. buckets: (band, k, c), two or more c
    for each k. nodes: (c, keys, sig, size)."""
    spark = docs.sparkSession
    texts = node_texts(docs, id_col, text_col, buckets.select("c").distinct(), members)
    sized = buckets.withColumn("h", F.pmod(F.xxhash64("c"), F.lit(1 << 40)))
    groups = stored(sized.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("h", "c")).alias("lead")), "near-groups")
    most = groups.agg(F.max("n")).first()[0]
    led = sized.join(groups, "k").filter(F.col("c") != F.col("lead")["c"])
    # a few bands join most of what belongs together, so that the other bands have little left to compare
    tested = stored(led.filter(F.col("band") < 4).select(F.col("c").alias("a"), F.col("lead")["c"].alias("b")).distinct(), "near-pairs")
    e = stars(verified(tested, texts, rules))
    leaders = 16
    while leaders < 256 * most:  # in the last round all members lead
        label = e.withColumnsRenamed({"a": "c", "b": "label"})
        now = sized.select("k", "c", "h").join(label, "c", "left").withColumn("label", F.coalesce("label", "c"))
        open_groups = now.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter(F.col("lo") != F.col("hi")).select("k", "n")
        left = stored(now.join(open_groups, "k").join(nodes, "c"), "near-open")
        if left.isEmpty():
            discard(spark, left)
            break
        seen = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pairs = stored(candidates(left, leaders, rules).join(seen, ["a", "b"], "left_anti"), "near-pairs")
        if not pairs.isEmpty():
            new = stars(e.unionByName(verified(pairs, texts, rules)))
            discard(spark, e)
            e, tested = new, tested.unionByName(pairs)
        discard(spark, left)
        leaders *= 256
    return e


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: NearRules | None = None) -> DataFrame:
    """(id, class_id, n_class, class_key, c): per row with words its class; class_key tells classes apart even without ids."""
    rules = rules or NearRules()
    rows = stored(signed(docs, id_col, text_col, rules), "near-signed")
    members = rows.select("doc", "c")
    nodes = rows.groupBy("c").agg(F.first(F.struct("keys", "sig", "size", "bits")).alias("s")).select("c", "s.*")
    exploded = nodes.select("c", F.posexplode("keys").alias("band", "k"))
    many = exploded.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k")
    buckets = stored(exploded.join(many, "k").select("band", "k", "c"), "near-buckets")
    if buckets.isEmpty():
        labelled = members.withColumn("class_key", F.col("c"))
    else:
        e = links(docs, id_col, text_col, members, buckets, stored(nodes.join(buckets.select("c").distinct(), "c"), "near-nodes"), rules)
        labelled = members.join(e, members["c"] == e["a"], "left").select("doc", "c", F.coalesce("b", "c").alias("class_key"))
    ids = labelled.groupBy("class_key").agg(F.min("doc").alias("class_id"), F.count(F.lit(1)).alias("n_class"))
    return labelled.join(ids, "class_key").select(F.col("doc").alias(id_col), "class_id", "n_class", "class_key", "c")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: NearRules | None = None) -> DataFrame:
    """(id, class_id, n_class): one row per row of docs, those without words alone in their class."""
    found = classes(docs, id_col, text_col, rules)

    def wordless(doc, text):
        if not WORD.search(text or ""):
            yield doc, doc, 1

    kind = docs.schema[id_col].dataType.simpleString()
    alone = map_rows(docs, [id_col, text_col], wordless, struct((f"`{id_col}`", kind), ("class_id", kind), ("n_class", "long")))
    return found.select(id_col, "class_id", "n_class").unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: NearRules | None = None) -> DataFrame:
    """The rows of docs, all columns, of one document per class: the one with the least id. Rows without words stay.
    Where ids repeat, rows are told apart by their content too, and of equal rows one stays."""
    found = stored(classes(docs, id_col, text_col, rules), "near-classes")
    if found.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        lost = found.filter(~F.col(id_col).eqNullSafe(F.col("class_id"))).select(F.col(id_col).alias("_doc"))
        return docs.join(lost.hint("merge"), docs[id_col].eqNullSafe(lost["_doc"]), "left_anti")  # the same plan at every size
    key = unused(docs, "_content")
    text_at = docs.columns.index(text_col)
    keyed = map_rows(docs, docs.columns, lambda *v: [(*v, content_key(words_of(v[text_at] or "")))], T.StructType([*docs.schema.fields, T.StructField(key, T.BinaryType())]))
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("doc"), F.col("c")))
    heads = found.groupBy("class_key").agg(first.alias("head")).select(F.col("head")["doc"].alias("_doc"), F.col("head")["c"].alias("_c"))
    kept = keyed.join(heads, keyed[id_col].eqNullSafe(heads["_doc"]) & (keyed[key] == heads["_c"])).select(keyed["*"]).dropDuplicates([key])
    return kept.unionByName(keyed.filter(F.col(key).isNull())).select(*docs.columns)
