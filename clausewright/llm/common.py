"""Shared helpers: table access, Arrow batch iteration, durable intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that end a word for the operators that split on ASCII white space.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: Texts handled together inside a Python worker hold about so many bytes, and a batch on its way to one.
CHUNK_BYTES, BATCH_BYTES = 4 << 20, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Keep only the named columns, under the operator's own names, whatever else the table has."""
    return df.select(*[df[src].alias(dst) for dst, src in cols.items()])


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.  Only a local master without
    that setting gets a folder of this process, removed when it ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="clausewright-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several steps read to the shared folder and read it again: lineage ends here, a lost
    executor costs no recomputation, and each reader prunes columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fields(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column's UTF-8 bytes, without making Python strings."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def slices(batch: pa.RecordBatch, name: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a part hold about `most` bytes (one longer text makes a part of its own)."""
    if batch.num_rows == 0:
        return
    col = batch.column(batch.schema.get_field_index(name))
    col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) else pa.large_string())
    ends = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + 1, offset=8 * col.offset)
    part = (ends[:-1] - ends[0]) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def bounded(df: DataFrame) -> DataFrame:
    """Let Spark bound Arrow batches of this session by bytes, not by rows alone, unless the session says how."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) == "67108864b":  # Spark's own default
        conf.set(name, str(BATCH_BYTES))
    return df


def arrow_filter(df: DataFrame, keep: Callable[[pa.RecordBatch], list[bool]], text: str = "text") -> DataFrame:
    """The rows that a function of bounded batches keeps, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                if (some := batch.filter(pa.array(keep(batch), pa.bool_()))).num_rows:
                    yield some

    return bounded(df).mapInArrow(run, df.schema)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: T.StructType | str, text: str | None = "text", most: int = CHUNK_BYTES) -> DataFrame:
    """mapInArrow with a function from one bounded batch to columns; the schema names and types them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, most) if text else [whole]:
                if batch.num_rows and (out := fn(batch)) is not None:
                    yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return bounded(df).mapInArrow(run, kind)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply, xor-shift), wrapping."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def fraction_column(*cols) -> "F.Column":
    """A number in [0, 1) that depends on the row's values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))
