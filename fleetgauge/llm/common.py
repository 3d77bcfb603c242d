"""What the corpus operators share: reading, per-document Arrow maps, tables in the shared folder."""

from __future__ import annotations

import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a result that a Python worker gathers before it hands them to Spark.
OUT_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one on a single machine (tests); on a cluster an
    error, since executors wouldn't see it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="fleetgauge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: its lineage ends there, so a lost executor costs no recomputation."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files behind stored() tables that nothing reads any more, and the shuffle files of finished jobs."""
    for f in {p.rsplit("/", 1)[0] for df in tables for p in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()  # Spark removes a shuffle when the driver's JVM has collected its plan


def map_rows(df: DataFrame, columns: list[str], fn: Callable[..., Iterable[tuple]], schema: T.StructType, setup: Callable | None = None) -> DataFrame:
    """flatMap over rows: fn(*values, [setup()]) yields result tuples. Values arrive one at a time from Arrow batches,
    results leave in batches of OUT_ROWS, so memory holds one input batch and one output batch."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = (setup(),) if setup else ()
        out: list[tuple] = []
        for batch in batches:
            cols = [batch.column(i) for i in range(len(columns))]
            for i in range(batch.num_rows):
                out.extend(fn(*(c[i].as_py() for c in cols), *more))
                if len(out) >= OUT_ROWS:
                    yield packed(out, arrow)
                    out = []
        if out:
            yield packed(out, arrow)

    return df.select(*columns).mapInArrow(run, schema)


def extended(df: DataFrame, read: list[str], fn: Callable[..., tuple], fields: list[T.StructField], drop: tuple[str, ...] = ()) -> DataFrame:
    """df with columns made row by row: fn(*values of read) gives the values of fields. A field that df has takes its place,
    others follow; columns in drop go. All other columns stay Arrow arrays and aren't looked at."""
    made = [f.name for f in fields]
    own = [f for f in df.schema.fields if f.name not in drop]
    schema = T.StructType([*(next((n for n in fields if n.name == f.name), f) for f in own), *(f for f in fields if f.name not in df.columns)])
    arrow, at = to_arrow_schema(schema), {c: i for i, c in enumerate(df.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(a, OUT_ROWS)
                cols = [part.column(at[c]) for c in read]
                out = list(zip(*(fn(*(c[i].as_py() for c in cols)) for i in range(part.num_rows)), strict=True))
                new = {n: pa.array(x, arrow.field(n).type) for n, x in zip(made, out, strict=True)}
                yield pa.RecordBatch.from_arrays([new[n] if n in new else part.column(at[n]) for n in arrow.names], arrow.names)

    return df.mapInArrow(run, schema)


def packed(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def struct(*fields: tuple[str, str]) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in fields))


def unused(df: DataFrame, name: str) -> str:
    """A column name starting with name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
