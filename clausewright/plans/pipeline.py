"""The stages from manifest to graph, each callable by itself and skippable; stages meet in stored tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunk, extract, graph, sample, segment, validate
from ..sources import sinks, tables


@dataclass(frozen=True)
class Config:
    output: str
    version: str = "v1"
    limit: int | None = None
    strict: bool = False
    ratios: dict[str, float] = field(default_factory=lambda: {"obligation": 0.5, "non_obligation": 0.2, "neutral": 0.3})
    vectors: Callable[[DataFrame], DataFrame] | None = None
    graph: bool = True
    extractor: Callable[[DataFrame], DataFrame] | None = None

    def at(self, name: str) -> str:
        return f"{self.output.rstrip('/')}/{self.version}/{name}"


def parse(spark: SparkSession, docs: DataFrame, cfg: Config) -> DataFrame:
    """Chunks, nodes and edges.  The segments have three readers, so they are written once."""
    docs = docs.orderBy("document_id").limit(cfg.limit) if cfg.limit else docs
    segment.segments(docs, strict=cfg.strict).write.mode("overwrite").parquet(cfg.at("segments"))
    segs = spark.read.parquet(cfg.at("segments"))
    made = chunk.chunks(docs, cfg.strict, segs=segs)
    sinks.json_lines(made, cfg.at("chunks"))
    if sinks.if_any(graph.nodes(docs, segs, cfg.strict), cfg.at("nodes")):
        sinks.json_lines(graph.edges(docs, segs, cfg.strict), cfg.at("edges"))
    return spark.read.schema(made.schema).json(cfg.at("chunks"))


def extraction(spark: SparkSession, chunks: DataFrame, cfg: Config) -> DataFrame:
    """Records, rejects, the balanced set and the report.  The first records of a class are those of the first chunks, by document and place."""
    chunks = chunks.orderBy("document_id", "chunk_index").limit(cfg.limit) if cfg.limit else chunks
    in_order = chunks.orderBy("document_id", "chunk_index").withColumn("seq", F.monotonically_increasing_id())  # sorted by ranges, so ids rise with the order
    payload = extract.inputs(in_order)
    extract.extract(payload, cfg.extractor).write.mode("overwrite").parquet(cfg.at("raw"))
    good, bad = validate.split_valid(spark.read.parquet(cfg.at("raw")))
    failed = [c for c in ("extract_error",) if c in good.columns]
    if failed:  # what a remote extractor gave up on is rejected with its reason
        bad = bad.unionByName(good.where("extract_error IS NOT NULL").select("chunk_id", F.col("extract_error").alias("error")))
        good = good.where("extract_error IS NULL").drop("extract_error")
    sinks.if_any(bad, cfg.at("rejects"))
    balanced = sample.ratio_balance(good, cfg.ratios)
    sinks.json_lines(balanced, cfg.at("balanced"))
    sinks.json_lines(sinks.run_report(good, bad, balanced, chunks, cfg.version), cfg.at("report"))
    return good


def run(spark: SparkSession, docs: DataFrame, cfg: Config, skip: tuple[str, ...] = ()) -> dict[str, str]:
    """All stages; `skip` names any of parse, vector, graph.  A skipped parse reads the chunks of an earlier run."""
    chunks = tables.json_lines(spark, cfg.at("chunks"), chunk.chunks(docs, cfg.strict).schema.simpleString()[7:-1]) if "parse" in skip else parse(spark, docs, cfg)
    records = extraction(spark, chunks, cfg)
    done = {k: cfg.at(k) for k in ("chunks", "raw", "balanced", "report")}
    if "vector" not in skip and cfg.vectors:
        sinks.vectors(records, cfg.vectors).write.mode("overwrite").parquet(cfg.at("vectors"))
        done["vectors"] = cfg.at("vectors")
    if "graph" not in skip and cfg.graph:
        node, edge = graph.record_graph(records)
        node.write.mode("overwrite").parquet(cfg.at("record_nodes"))
        edge.write.mode("overwrite").parquet(cfg.at("record_edges"))
        done |= {k: cfg.at(k) for k in ("record_nodes", "record_edges")}
    return done
