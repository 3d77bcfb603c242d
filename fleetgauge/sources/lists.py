"""Node lists, VM inventory, backend and capacity documents, and the scrape configuration made of a node list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetgauge import schemas

DEFAULT_PORT = 8764
MARKER = r"^#\s*cluster:(\w+)"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files. A node list is one small file, read whole, so lines keep their order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))


def _with_port(node):
    return F.when(node.contains(":"), node).otherwise(F.concat(node, F.lit(f":{DEFAULT_PORT}")))


def node_list(lines: DataFrame, sections: str = "keep", inline_comments: bool = False, port: str = "missing") -> DataFrame:
    """(node, host, port, cluster, line) of (file, line, value).

    sections: "keep" assigns clusters by marker lines (main before the first), "ignore" merges all, "first" stops at
    the first marker. inline_comments: text after # is cut. port: "missing" adds the default where none is, "always"
    appends it (a second one if there is one), "never" leaves nodes as they are."""
    marker = F.regexp_extract(F.trim("value"), MARKER, 1)
    w = W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = lines.withColumn("cluster", F.coalesce(F.last(F.when(marker != "", marker), ignorenulls=True).over(w), F.lit("main")))
    node = F.trim(F.regexp_replace(F.split("value", "#")[0] if inline_comments else F.col("value"), r"\s+", ""))
    out = marked.filter(~F.ltrim("value").startswith("#")).withColumn("node", node).filter(F.col("node") != "")
    if sections == "first":
        out = out.filter(F.col("cluster") == "main")
    elif sections == "ignore":
        out = out.withColumn("cluster", F.lit("main"))
    if port != "never":
        out = out.withColumn("node", _with_port(F.col("node")) if port == "missing" else F.concat("node", F.lit(f":{DEFAULT_PORT}")))
    return out.select("node", F.substring_index("node", ":", 1).alias("host"), F.try_element_at(F.split("node", ":"), F.lit(2)).try_cast("int").alias("port"), "cluster", "line")


def inventory(lines: DataFrame, status: str | None = None) -> DataFrame:
    """VM inventory of white-space columns; status RUNNING keeps the running ones."""
    c = F.split(F.trim("value"), r"\s+")
    out = lines.filter(F.size(c) >= 6).select(*(c[i].alias(n) for i, n in enumerate(("name", "zone", "machine_type", "internal_ip", "external_ip", "status"))))
    return out if status is None else out.filter(F.col("status") == status)


def live_backends(docs: DataFrame, text: str = "value") -> DataFrame:
    """(external_ip) of backends that are up and have one."""
    b = F.explode(F.from_json(text, schemas.BACKENDS)["backends"])
    return docs.select(b.alias("b")).filter("b.up AND b.external_ip IS NOT NULL AND b.external_ip <> ''").select("b.external_ip")


def capacity(docs: DataFrame, text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Capacity documents with their sections as one map, after the columns keep; missing numbers are 0."""
    d = docs.select(*keep, F.from_json(text, schemas.CAPACITY).alias("d")).select(*keep, "d.*")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("active_calls", "max_calls", "vi_max_calls", "exotel_max_calls", "vacant_slots")]
    sections = F.map_from_arrays(F.array(*map(F.lit, schemas.SECTIONS)), F.array(*(F.col(f"`{s}`") for s in schemas.SECTIONS)))
    return d.select(*keep, *numbers, sections.alias("sections"))


def scrape_config(nodes: DataFrame, job: str = "gpu_nodes", every: str = "15s", patience: str = "10s") -> DataFrame:
    """One row, column value: the YAML text of a scrape configuration over a node list (a small table by nature)."""
    targets = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "node"))), lambda x: F.concat(F.lit("          - '"), x["node"], F.lit("'"))), "\n")
    head = f"global:\n  scrape_interval: {every}\n  scrape_timeout: {patience}\nscrape_configs:\n  - job_name: '{job}'\n    static_configs:\n      - targets:\n"
    return nodes.agg(F.concat(F.lit(head), targets, F.lit("\n")).alias("value"))


def with_node_array(pages: DataFrame, nodes: DataFrame, text: str = "value", name: str = "NODES") -> DataFrame:
    """pages whose script array of that name holds the nodes, in order of their lines, in place of what it held. The list is a
    small table by nature; an empty one empties the array."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct("line", "node"))), lambda x: F.concat(F.lit('  "'), x["node"], F.lit('",\n')))
    block = nodes.agg(F.concat(F.lit(f"const {name} = [\n"), F.array_join(entries, ""), F.lit("];")).alias("block")).first()[0]
    quoted = block.replace("\\", "\\\\").replace("$", "\\$")  # in a replacement, $ names a group
    return pages.withColumn(text, F.regexp_replace(text, rf"(?s)const {name} = \[.*?\];", quoted))
