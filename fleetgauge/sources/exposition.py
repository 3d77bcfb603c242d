"""Metrics exposition text to samples, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name, optional {labels}, value, optional integer timestamp; quoted label values may hold commas and braces.
LINE = r'^\s*([a-zA-Z_:][a-zA-Z0-9_:]*)\s*(?:\{((?:[^"{}]|"(?:[^"\\]|\\.)*")*)\})?\s+([^\s\x01]+)(?:\s+(-?\d+))?\s*$'
LABEL = r'([a-zA-Z_]\w*)\s*=\s*"((?:[^"\\]|\\.)*)"'
#: What the browser flavour takes as a line, a label and the number that a value starts with.
LOOSE_LINE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{([^}]*)\})?\s+([\d.e+\-]+)"
LOOSE_LABEL = r'(\w+)="([^"]*)"'
LOOSE_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?"


def parse_value(s: Column) -> Column:
    """Double with NaN and infinities; null for anything else."""
    return F.when(F.lower(s).isin("nan", "+nan", "-nan"), F.lit(float("nan"))).when(F.lower(s).isin("inf", "+inf"), F.lit(float("inf"))).when(F.lower(s) == "-inf", F.lit(float("-inf"))).otherwise(s.try_cast("double"))


def unescaped(v: Column) -> Column:
    """Backslash, quote and newline escapes, each read once from left to right: between escaped backslashes no escape overlaps."""
    part = lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    return F.array_join(F.transform(F.split(v, r"\\\\", -1), part), "\\")


def parse_labels(s: Column) -> Column:
    """Map of labels; the last of two equal names wins (session setting mapKeyDedupPolicy), escapes are resolved."""
    return F.map_from_arrays(F.regexp_extract_all(s, F.lit(LABEL), F.lit(1)), F.transform(F.regexp_extract_all(s, F.lit(LABEL), F.lit(2)), unescaped))


def matched(lines: DataFrame, text: str, pattern: str, groups: str) -> DataFrame:
    """lines that match, with the array _m of the groups, the last of which may hold anything: the pattern is matched once,
    its groups are told apart by a character that the others don't hold."""
    n = groups.count("$")
    cut = F.split(F.regexp_replace(F.col(text), pattern, "\x02" + groups.replace(" ", "\x01")), "\x01", n)
    marked = lines.filter(~F.col(text).startswith("\x02")).withColumn("_m", cut)
    return marked.filter(F.get("_m", F.lit(0)).startswith("\x02"))


def parse(lines: DataFrame, text: str = "value", finite_only: bool = False) -> DataFrame:
    """lines plus metric, labels and value; comments, blanks and lines that don't parse are dropped. Other columns
    (node, ts_ms) stay. finite_only also drops NaN and infinities."""
    others = [c for c in lines.columns if c != text]
    found = matched(lines.filter(~F.ltrim(F.col(text)).startswith("#")), text, LINE, "$1 $3 $2")
    out = found.select(*others, F.expr("substring(get(_m, 0), 2)").alias("metric"), parse_labels(F.get("_m", F.lit(2))).alias("labels"), parse_value(F.get("_m", F.lit(1))).alias("value")).filter(F.col("value").isNotNull())
    return out.filter(~F.isnan("value") & (F.abs("value") < float("inf"))) if finite_only else out


def parse_loose(lines: DataFrame, text: str = "value") -> DataFrame:
    """The browser flavour: no white space before a name, labels end at the first brace and keep their escapes, and the value
    is the number that the text after them starts with, so there are no NaN, infinities or capital exponents."""
    others = [c for c in lines.columns if c != text]
    found = matched(lines.filter(~F.col(text).startswith("#")), text, LOOSE_LINE + r"[\s\S]*$", "$1 $3 $2")
    number = F.regexp_extract(F.get("_m", F.lit(1)), LOOSE_NUMBER, 0).try_cast("double")
    labels = F.map_from_arrays(*(F.regexp_extract_all(F.get("_m", F.lit(2)), F.lit(LOOSE_LABEL), F.lit(i)) for i in (1, 2)))
    return found.select(*others, F.expr("substring(get(_m, 0), 2)").alias("metric"), labels.alias("labels"), number.alias("value")).filter(F.col("value").isNotNull())


def bare_values(samples: DataFrame, *keys: str) -> DataFrame:
    """The label-dropping flavour: per metric (and key) the values of all its samples, as an array in ascending order."""
    return samples.groupBy(*keys, "metric").agg(F.array_sort(F.collect_list("value")).alias("values"))


def snapshots(samples: DataFrame) -> DataFrame:
    """One nested row per node and time: (node, cluster, ts_ms, samples)."""
    return samples.groupBy("node", "cluster", "ts_ms").agg(F.collect_list(F.struct("metric", "labels", "value")).alias("samples"))


def render(samples: DataFrame) -> DataFrame:
    """Samples as exposition lines, column value; the inverse of parse()."""
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    label = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"'))), ",")
    head = F.when(F.size("labels") > 0, F.concat("metric", F.lit("{"), label, F.lit("}"))).otherwise(F.col("metric"))
    return samples.withColumn("value", F.concat(head, F.lit(" "), F.col("value").cast("string"))).drop("metric", "labels")
