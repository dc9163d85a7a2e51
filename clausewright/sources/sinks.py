"""Sinks: JSON lines, manifests, reports, and upserts into tables or outside stores."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    """Null fields are left out, as Spark's JSON writer does."""
    df.write.mode("overwrite").json(path)


def if_any(df: DataFrame, path: str) -> bool:
    """Written only if there is a row; tells whether it was."""
    if df.limit(1).count():
        json_lines(df, path)
        return True
    return False


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def manifest(done: DataFrame, failed: DataFrame, output_base: str, version: str = "1.0") -> DataFrame:
    """One row: the manifest of ingested and failed records.  Its document list is one value by definition of the format."""
    fields = [c for c in done.columns]
    a = done.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("documents"), F.sort_array(F.collect_set("regulator")).alias("regulators"), F.count("*").cast("int").alias("count"))
    b = failed.agg(F.array_sort(F.collect_list(F.struct("s3_key", "regulator", "error"))).alias("failed"), F.count("*").cast("int").alias("failed_count"))
    return a.crossJoin(b).select(F.lit(version).alias("version"), F.lit(output_base).alias("output_base"), "regulators", "documents", "count", "failed_count", "failed")  # one row each


def upserted(current: DataFrame | None, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """What an upsert leaves: per key the row with the greatest `order`, new rows before old ones of equal order."""
    rows = new.withColumn("_new", F.lit(1))
    if current is not None:
        rows = rows.unionByName(current.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    cols = [c for c in rows.columns if c not in (*keys, "_new")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(F.col(order), F.col("_new"))).alias("r")).select(*keys, "r.*")


def vectors(records: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of a vector collection: id, document, metadata, embedding.  `embed` adds `embedding` to rows with `document`."""
    rows = records.select(F.col("source_id").alias("id"), F.col("input_text").alias("document"), F.create_map(F.lit("document_id"), F.regexp_replace("source_id", "_[^_]*$", ""), F.lit("classification"), F.col("classification"), F.lit("section"), F.col("section"), F.lit("confidence_score"), F.lit("1.0"), F.lit("confidence_tier"), F.lit("unknown")).alias("metadata"))
    return embed(rows)


def for_each_batch(df: DataFrame, connect: Callable[[], object], send: Callable[[object, list[Row]], None], size: int = 100) -> None:
    """Rows to an outside store, `size` at a time, over one connection a partition.  `send` must be an upsert: a lost task is run again."""
    def run(rows: Iterable[Row]) -> None:
        client, held = None, []
        for r in rows:
            client = client or connect()
            held.append(r)
            if len(held) == size:
                send(client, held)
                held = []
        if held:
            send(client, held)

    df.foreachPartition(run)


def run_report(records: DataFrame, rejects: DataFrame, balanced: DataFrame, chunks: DataFrame, version: str) -> DataFrame:
    """One row of counts."""
    kinds = records.agg(F.count("*").alias("total_records"), *[F.sum((F.col("classification") == k).cast("long")).alias(k) for k in ("obligation", "non_obligation", "neutral")])
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return kinds.crossJoin(n(rejects, "rejects")).crossJoin(n(balanced, "balanced_records")).crossJoin(n(chunks, "total_chunks")).withColumn("version", F.lit(version))
