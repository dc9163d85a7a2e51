"""Exact nearest neighbours of a stated query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries that go to the workers together, and rows that are multiplied with them at once.
QUERIES, ROWS = 4096, 4096


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """query_id, key, rank, similarity: each query's k rows of the greatest cosine (to 9 decimals; ties by key), itself left out.

    Queries are taken in blocks of QUERIES, which bounds what is broadcast.  A task multiplies a batch of rows with a block and keeps k rows a query, so what
    is shuffled is k rows a query and task, not every pair.  Vectors have one length; rows without one and those of length zero are left out."""
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    has = F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0)
    n = queries.where(has).count()
    parts = max(1, -(-n // QUERIES))
    out = None
    for part in range(parts):
        block = queries.where(has & (F.pmod(F.xxhash64(key), F.lit(parts)) == part)).select(key, vector).toArrow()
        shared = spark.sparkContext.broadcast((block[key].to_pylist(), _vectors(block[vector].combine_chunks()) if block.num_rows else np.zeros((0, 0))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best: list[list[tuple]] = [[] for _ in ids]
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    own = batch.column(0).to_pylist()
                    s = np.round(q @ _vectors(batch.column(1)).T, 9)
                    for i, query in enumerate(ids):
                        least = np.partition(s[i], max(0, len(own) - k - 1))[max(0, len(own) - k - 1)]  # the query itself may be among them
                        best[i] = sorted(best[i] + [(-float(s[i, j]), own[j]) for j in np.flatnonzero(s[i] >= least).tolist() if own[j] != query])[:k]
            flat = [(ids[i], x, -s) for i, found in enumerate(best) for s, x in found]
            if flat:
                cols = list(zip(*flat, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.float64())], names=["query_id", key, "s"])

        made = rows.where(has).select(key, vector).mapInArrow(run, f"query_id {kind}, {key} {kind}, s double")
        out = made if out is None else out.unionByName(made)
    best = out.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("d"), key))), 1, k).alias("best"))
    flat = best.select("query_id", F.posexplode("best").alias("place", "x"))
    return flat.select("query_id", F.col(f"x.{key}").alias(key), (F.col("place") + 1).alias("rank"), F.round(-F.col("x.d"), 6).alias("similarity"))
