"""Benchmark decontamination by the q-gram lemma.

Benchmark items and documents are normalised (lower case, runs of ASCII characters other than letters and digits as
one space) and compared as UTF-8. An item is searched by windows of WINDOW bytes, one every STRIDE bytes and one at its
end, so that a part of it is found too; items below WINDOW bytes are one window. A window of m bytes with at most e edits
in a document keeps m - q + 1 - q * e of its q-grams, on diagonals that differ by at most e. So the q-grams that a
document shares with an item are counted in bands of diagonals 2 * (e + 1) wide, each overlapping the next by half; in
bands that reach the bound they are counted per window, and windows that reach it are aligned, by a banded edit distance
against any part of that region. No window within the budget is missed, so a verbatim passage of WINDOW + STRIDE - 1
bytes (55) is surely found wherever it lies in an item, and so is one with edits that holds a window within the budget.
Shorter passages are found only where they hold a window, and those below WINDOW less the budget never.

Scale: documents are read once, where they lie, with no shuffle. The benchmark is sent to the tasks in blocks of at
most BLOCK_BYTES; a larger one is searched block by block. The work grows with the text, not with copies or hot keys.

Cases: null and empty documents match nothing; items with less than LEAST bytes after normalising (null, empty, too
short to be evidence) match nothing. Rows that repeat a doc_id, and ties, give a result each. Very long documents are
searched whole, part by part, so that a repetitive one holds little in memory. Empty tables give no leak and lose no
document. Of documents only id and text are read; clean() keeps all columns as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import map_rows, struct

U = np.uint64
#: ASCII characters other than letters and digits become spaces; others stay.
SPACED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
MULTIPLIER = U(0x9E3779B97F4A7C15)
BITS = 22
BLOCK_BYTES = 8 << 20
#: Bytes of a document that are searched at a time, and by which the parts overlap.
PART, OVERLAP = 1 << 14, 512


@dataclass(frozen=True)
class LeakRules:
    q: int = 8  # at most 8: grams are read as 64-bit numbers
    window: int = 48
    stride: int = 8
    budget: float = 0.1
    least: int = 32


def normalised(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(SPACED).split())


def grams(raw: bytes, q: int) -> np.ndarray:
    """The q-byte grams of raw as numbers."""
    n = len(raw) - q + 1
    if n <= 0:
        return np.zeros(0, U)
    padded = np.frombuffer(raw + bytes(8 - q), np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1)).copy().view("<u8").ravel() & U((1 << 8 * q) - 1)


def starts(n: int, rules: LeakRules) -> list[int]:
    """Where the windows of an item of n bytes start."""
    if n < rules.least:
        return []
    last = max(0, n - rules.window)
    return [*range(0, last, rules.stride), last]


class Patterns:
    """The windows of a block of items; the items' grams sorted for lookup, and a bitmap that rules most grams out."""

    def __init__(self, items: list[tuple], rules: LeakRules):
        self.rules, self.item, self.raw, self.start = rules, [], [], []
        texts, first = [], [0]
        for item, text in items:
            raw = normalised(text or "")
            at = starts(len(raw), rules)
            if at:
                texts.append(raw)
                self.item.extend([item] * len(at))
                self.raw.extend(raw[a : a + rules.window] for a in at)
                self.start.extend(at)
                first.append(len(self.raw))
        self.start = np.array(self.start, np.int64)
        #: Windows first[t] up to first[t + 1] are those of text t; they are equally long.
        self.first_window = np.array(first, np.int64)
        size = np.array([min(len(t), rules.window) for t in texts], np.int64)
        self.text_edits = np.minimum((rules.budget * size).astype(np.int64), (size - rules.q) // rules.q)
        self.reach = size - rules.q + 1  # grams of a window
        self.bound = self.reach - rules.q * self.text_edits
        self.edits = np.repeat(self.text_edits, np.diff(self.first_window))
        parts = [grams(t, rules.q) for t in texts]
        gram = np.concatenate(parts) if parts else np.zeros(0, U)
        text = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        place = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.text, self.place = text[order], place[order]
        self.gram, self.first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[self.gram * MULTIPLIER >> U(64 - BITS)] = True

    def regions(self, raw: bytes, done: np.ndarray | None = None) -> list[tuple[int, int, int]]:
        """(pattern, low, high): bands of diagonals that share enough grams with a pattern, in ascending order of bands.
        done: texts to leave out."""
        g = grams(raw, self.rules.q)
        at = np.flatnonzero(self.bitmap[g * MULTIPLIER >> U(64 - BITS)])
        if not len(at) or not len(self.gram):
            return []
        k = np.minimum(np.searchsorted(self.gram, g[at]), len(self.gram) - 1)
        true = self.gram[k] == g[at]
        at, k = at[true], k[true]
        n = self.count[k]
        hit = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        text, place, at = self.text[hit], self.place[hit], np.repeat(at, n)
        enough = np.bincount(text, minlength=len(self.bound)) >= self.bound
        enough = (enough if done is None else enough & ~done)[text]
        if not enough.any():
            return []
        text, place, at = text[enough], place[enough], at[enough]
        band = (at - place) // (self.text_edits[text] + 1)
        # each hit counts in the band that starts at its step and in the one before
        group = text << 34 | band + (1 << 32)
        group = np.concatenate([group, group - 1])
        near, of, counts = np.unique(group, return_inverse=True, return_counts=True)
        left = (counts >= self.bound[near >> 34])[of]
        if not left.any():
            return []
        # a gram of the text counts once in a band: sorted by band and place
        of, place = np.unique(np.stack([of[left], np.concatenate([place, place])[left]]), axis=1)
        out, ends = [], np.flatnonzero(np.diff(of, append=-1)) + 1
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            key = int(near[of[a]])
            t, step = key >> 34, int(self.text_edits[key >> 34]) + 1
            if b - a < self.bound[t]:
                continue
            low = ((key & ((1 << 34) - 1)) - (1 << 32)) * step
            p = int(self.first_window[t])
            start, places = self.start[p : self.first_window[t + 1]], place[a:b]
            shared = np.searchsorted(places, start + self.reach[t]) - np.searchsorted(places, start)
            out.extend((p + int(w), low + int(start[w]), low + int(start[w]) + 2 * step) for w in np.flatnonzero(shared >= self.bound[t]))
        return out


def banded(pattern: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """Least edits of pattern against any part of text, and where that part ends; None if over most. Only a band of
    diagonals is filled: those on which the pattern can lie within text, and most more on either side, which no alignment
    within the budget leaves."""
    t, m, n = np.frombuffer(text, np.uint8), len(pattern), len(text)
    low, high = -most, max(0, n - m) + most
    far = m + n + 1
    diagonal = np.arange(low, high + 1)
    places = np.arange(len(diagonal))
    padded = np.full(m + len(diagonal) + 1, -1, np.int16)  # text from low on; -1 outside
    keep = min(n, len(padded) - most)
    padded[most : most + keep] = t[:keep]
    row = np.where((diagonal >= 0) & (diagonal <= n), 0, far)
    for i, c in enumerate(pattern, 1):
        letter = padded[i - 1 : i - 1 + len(diagonal)]  # that of the text at i - 1 + diagonal
        new = np.where(letter < 0, far, row + (letter != c))
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.minimum.accumulate(new - places) + places  # insertions
        new[diagonal + i > n] = far
        row = new
        if row.min() > most:
            return None
    at = int(row.argmin())
    return int(row[at]), m + int(diagonal[at])


def search(raw: bytes, patterns: Patterns) -> dict:
    """{item: [windows found, least edits, first start, last stop]} of a normalised document. It is read in parts of PART
    bytes that overlap by more than a window with its edits can span; items whose windows are all found without an edit
    aren't looked for in later parts, where nothing could be better."""
    found: dict = {}
    best: dict[int, tuple[int, int, int]] = {}
    done = np.zeros(len(patterns.bound), bool)
    for origin in range(0, max(1, len(raw)), PART):
        part = raw[origin : origin + PART + OVERLAP]
        for p, match in hits(part, patterns, done, best, origin):
            best[p] = min(best.get(p, match), match)
        if len(raw) > PART and best:
            exact = np.zeros(len(patterns.raw), np.int64)
            exact[[p for p, x in best.items() if x[0] == 0]] = 1
            done = np.add.reduceat(exact, patterns.first_window[:-1]) == np.diff(patterns.first_window)
            if done.all():
                break
    for p, (edits, start, stop) in best.items():
        x = found.setdefault(patterns.item[p], [0, edits, start, stop])
        found[patterns.item[p]] = [x[0] + 1, min(x[1], edits), min(x[2], start), max(x[3], stop)]
    return found


def hits(raw: bytes, patterns: Patterns, done: np.ndarray, best: dict, origin: int):
    """(window, (edits, start, stop)) of a part of a document that starts at origin."""
    exactly = {p for p, x in best.items() if x[0] == 0}
    for p, low, high in patterns.regions(raw, done):
        if p in exactly:  # later bands lie further on
            continue
        w, e = patterns.raw[p], int(patterns.edits[p])
        a = max(0, low - e)
        part = raw[a : max(0, high + len(w) + e)]
        exact = part.find(w)
        if exact >= 0:
            exactly.add(p)
            yield p, (0, origin + a + exact, origin + a + exact + len(w))
        elif (hit := banded(w, part, e)) is not None:
            yield p, (hit[0], origin + max(0, a + hit[1] - len(w)), origin + a + hit[1])


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[DataFrame]:
    """benchmark in parts of at most some BLOCK_BYTES each."""
    size = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    if n == 1:
        return [benchmark]
    return [benchmark.filter(F.pmod(F.xxhash64(item_col, text_col), F.lit(n)) == i) for i in range(n)]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rules: LeakRules | None = None) -> DataFrame:
    """(id, item, n_windows, edits, start, stop): per document and item found in it, the windows found, the least edits
    of one, and where they lie in the normalised document, in bytes."""
    rules, out = rules or LeakRules(), None
    schema = struct((f"`{id_col}`", docs.schema[id_col].dataType.simpleString()), (f"`{item_col}`", benchmark.schema[item_col].dataType.simpleString()), ("n_windows", "long"), ("edits", "long"), ("start", "long"), ("stop", "long"))
    for block in blocks(benchmark, item_col, item_text):
        items = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in block.select(item_col, item_text).collect()])  # at most BLOCK_BYTES

        def found(doc, text, patterns):
            for item, x in search(normalised(text or ""), patterns).items():
                yield doc, item, *x

        part = map_rows(docs, [id_col, text_col], found, schema, lambda items=items: Patterns(items.value, rules))
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text", rules: LeakRules | None = None) -> DataFrame:
    """The rows of docs, all columns unchanged, in which no item is found."""
    import pyarrow as pa

    rules, text_at = rules or LeakRules(), docs.columns.index(text_col)
    for block in blocks(benchmark, benchmark.columns[0], item_text):
        items = docs.sparkSession.sparkContext.broadcast([(i, r[0]) for i, r in enumerate(block.select(item_text).collect())])

        def run(batches, items=items):
            patterns = Patterns(items.value, rules)
            for batch in batches:
                yield batch.filter(pa.array([not search(normalised(x.as_py() or ""), patterns) for x in batch.column(text_at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
