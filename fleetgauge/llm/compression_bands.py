"""Quality rules by compression: documents whose zstandard ratio leaves the band for their length are rejected.

A ratio is the UTF-8 bytes over their compressed bytes. It is taken over the whole document and over each fixed
chunk of CHUNK bytes, the last one as long as it is; a repetitive text has a high ratio, random text (keys, base64,
hashes) a low one. What is ordinary depends on the length, since a short text gives the compressor little to find, and
on the language, so the limits are a table by both. A document passes if its own ratio lies in the band of its length
and chunks outside the band of theirs hold at most MAX_BAD of its bytes.

Limits come from good labelled rows: at most MOST_LABELLED of them (by a hash of their ids) give, per language and
length, the middle and the spread of ordinary ratios, and the band is a MARGIN wider than the spread. Where the sample
has too few rows of a language or length, and for tables without labels, the wide limits of BANDS hold.

Scale: one pass, no shuffle; before it, ratios of the bounded sample go to the driver, numbers only.

Cases: null and empty texts have no words, ratios of null, and fail the base rules. Repeated rows and ties are judged
one by one, alike. Long documents are compressed whole, in one native call. An empty table gives no row. Columns of
the table other than id, text and language aren't read by judge() and are kept as they are by keep_good().
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from itertools import pairwise

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import map_rows, struct

#: At so many bytes, the least and the greatest ratio of prose in any language; between them the limits run
#: straight over the logarithm of the length.
BANDS = ((16, 0.40, 1.35), (32, 0.55, 1.45), (64, 0.70, 1.55), (128, 0.80, 1.70), (256, 1.05, 1.90), (512, 1.20, 2.05), (1024, 1.35, 2.20), (2048, 1.50, 2.35), (4096, 1.60, 2.45), (8192, 1.65, 2.55), (16384, 1.70, 2.65), (32768, 1.70, 2.75), (131072, 1.70, 3.00))
#: Labelled rows that the limits are taken from, at most.
MOST_LABELLED = 8000
SYMBOLS = b"#*$%&|<>"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


@dataclass(frozen=True)
class Rules:
    """Limits of the base rules and of the compression bands; fitted: {language: bands} of those with enough good rows."""

    least_words: int = 50
    most_repeated_percent: int = 50
    level: int = 3
    chunk: int = 4096
    most_bad: float = 0.34
    bands: tuple = BANDS
    fitted: dict = field(default_factory=dict)
    near_rows: int = 40  # good rows within an octave of a length that a fitted limit needs
    margin: float = 1.3
    slack: float = 0.015


def band(n_bytes: int, bands: tuple) -> tuple[float, float]:
    """The limits at a length; below the first length and beyond the last theirs hold."""
    if n_bytes <= bands[0][0]:
        return bands[0][1:]
    for (at, low, high), (then, low_then, high_then) in pairwise(bands):
        if n_bytes < then:
            share = math.log(n_bytes / at) / math.log(then / at)
            return low + share * (low_then - low), high + share * (high_then - high)
    return bands[-1][1:]


def fit(sizes: np.ndarray, ratios: np.ndarray, rules: Rules) -> tuple:
    """Bands of one language from the ratios of good rows: at each half octave the middle is a quadratic over the rows within
    an octave, the limits lie MARGIN times their greatest deviations (and SLACK of the middle) from it. Lengths with too few rows keep the
    wide limits."""
    x, out = np.log2(sizes), []
    for at in sorted({*(b[0] for b in rules.bands), *(int(2 ** (k / 2)) for k in range(14, 35))}):
        low, high = band(at, rules.bands)
        near = np.abs(x - math.log2(at)) <= 1
        if near.sum() >= rules.near_rows and x.min() <= math.log2(at) <= x.max():
            d = x[near] - math.log2(at)
            curve = np.polyfit(d, ratios[near], 2 if near.sum() >= 2 * rules.near_rows else 1)
            off = ratios[near] - np.polyval(curve, d)
            close = off[np.argsort(np.abs(d), kind="stable")[: max(rules.near_rows, len(d) // 2)]]
            slack = rules.slack * curve[-1]
            low, high = curve[-1] + rules.margin * close.min() - slack, curve[-1] + rules.margin * close.max() + slack
        out.append((at, float(low), float(high)))
    return tuple(out)


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", rules: Rules | None = None) -> Rules:
    """Rules with limits from the rows that labels calls good (1) and the base rules accept."""
    rules = rules or Rules()
    if lang_col not in docs.columns:
        return rules
    picked = labels.filter((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(MOST_LABELLED)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")).join(F.broadcast(picked), "_id")

    def measured(text, lang, compressor):
        raw = (text or "").encode()
        words = raw.split()
        if len(words) >= rules.least_words and 100 * repeated(words) <= rules.most_repeated_percent * len(words):
            yield lang, len(raw), len(raw) / len(compressor.compress(raw))

    good = map_rows(rows, ["_text", "_lang"], measured, struct(("lang", "string"), ("n", "long"), ("ratio", "double")), lambda: zstandard.ZstdCompressor(level=rules.level))
    by: dict = {}
    for lang, n, ratio in good.orderBy(F.xxhash64("lang", "n", "ratio"), "lang", "n", "ratio").limit(MOST_LABELLED).collect():
        by.setdefault(lang, []).append((n, ratio))
    return replace(rules, fitted={lang: fit(*np.array(sorted(x)).T, rules) for lang, x in by.items()})


def base_counts(text: str, raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. bytes.split() cuts at exactly the six ASCII spaces."""
    words = raw.split()
    word_chars = len(text) - sum(map(text.count, SPACE))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), word_chars, n_symbols, len(lines) - len(set(lines)), repeated(words)


def repeated(words: list[bytes]) -> int:
    """Words that lie in a window of three that occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    count = upto = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            count += i + 3 - max(i, upto)
            upto = i + 3
    return count


def verdict(raw: bytes, rules: Rules, compressor: zstandard.ZstdCompressor, lang: str | None = None) -> tuple[float | None, int, int, bool]:
    """Whole ratio, chunks, chunks outside their band, and whether the bands accept the text."""
    if not raw:
        return None, 0, 0, False
    bands = rules.fitted.get(lang, rules.bands)
    whole = len(raw) / len(compressor.compress(raw))
    low, high = band(len(raw), bands)
    good = low <= whole <= high
    if len(raw) <= rules.chunk:  # one chunk, the text itself
        return whole, 1, int(not good), good
    n = bad = bad_bytes = 0
    for at in range(0, len(raw), rules.chunk):
        part = raw[at : at + rules.chunk]
        low, high = band(len(part), bands)
        n += 1
        if not low <= len(part) / len(compressor.compress(part)) <= high:
            bad += 1
            bad_bytes += len(part)
    return whole, n, bad, good and bad_bytes <= rules.most_bad * len(raw)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: Rules | None = None) -> DataFrame:
    """One row per row of docs: the id, the base counts, the ratios, base_failed and kept. No shuffle."""
    rules = rules or Rules()
    schema = struct((f"`{id_col}`", docs.schema[id_col].dataType.simpleString()), ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("ratio", "double"), ("n_chunks", "long"), ("n_bad_chunks", "long"))
    lang = [lang_col] if lang_col in docs.columns else []

    def row(key, text, *more):
        *lang, compressor = more
        text = text or ""
        raw = text.encode()
        n, chars, symbols, lines, again = base_counts(text, raw)
        failed = n < rules.least_words or 100 * again > rules.most_repeated_percent * n
        whole, chunks, bad, good = verdict(raw, rules, compressor, *lang)
        yield key, n, chars, symbols, lines, again, failed, good and not failed, whole, chunks, bad

    return map_rows(docs, [id_col, text_col, *lang], row, schema, lambda: zstandard.ZstdCompressor(level=rules.level))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rules: Rules | None = None) -> DataFrame:
    """The rows of docs, all columns unchanged, that both the base rules and the bands accept."""
    rules, columns = rules or Rules(), docs.columns
    text_at, lang_at = columns.index(text_col), columns.index(lang_col) if lang_col in columns else None

    def run(batches):
        import pyarrow as pa

        compressor = zstandard.ZstdCompressor(level=rules.level)
        for batch in batches:
            langs = [None] * batch.num_rows if lang_at is None else batch.column(lang_at).to_pylist()
            good = []
            for x, lang in zip(batch.column(text_at), langs, strict=True):
                raw = (x.as_py() or "").encode()
                words = raw.split()
                ok = len(words) >= rules.least_words and 100 * repeated(words) <= rules.most_repeated_percent * len(words)
                good.append(ok and verdict(raw, rules, compressor, lang)[3])
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
