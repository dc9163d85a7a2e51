"""Chunks: one for each span of an emitted level, or one for a document without spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .segment import segments, with_paths

LEVELS = ("section", "subsection", "clause", "explanation", "proviso", "definition", "schedule", "article")
FALLBACK = 12_000
CARRIED = ("regulator", "document_type", "document_subtype", "s3_key", "source_url", "local_path", "title")


def chunks(docs: DataFrame, strict: bool = False, paths: bool = False, segs: DataFrame | None = None) -> DataFrame:
    """docs: document_id, full_text, and any of pages, act_name, effective_date, amendment_info and the CARRIED columns; segs: the documents' segments
    where they are stored already.  Chunks are numbered after the levels that aren't emitted are gone; strict also carries the jurisdiction.  A document
    meets its spans in one left join, whose empty side makes the chunk of a document without spans, so segmentation runs once."""
    carried = [c for c in ("act_name", "effective_date", "amendment_info", *CARRIED, *(("jurisdiction",) if strict else ())) if c in docs.columns]
    segs = segments(docs, strict=strict) if segs is None else segs
    segs = (with_paths(segs) if paths else segs).where(F.col("level").isin(*LEVELS))
    seq = Window.partitionBy("document_id").orderBy("ord")
    own = segs.withColumn("chunk_index", F.row_number().over(seq) - 1).withColumn("total_chunks", F.count("*").over(Window.partitionBy("document_id")).cast("int")).select(
        "document_id", "chunk_index", "total_chunks", T.or_else(F.col("text"), "(no content)").alias("text"), "level", "section_number",
        F.when(F.col("level").isin("clause", "subsection"), F.col("clause_number")).alias("clause_number"), F.col("title").alias("section_title"), "chapter",
        "start_offset", "end_offset", *(["parent_path"] if paths else []), "semantic_role")
    bare = T.or_else(T.strip(F.substring("full_text", 1, FALLBACK)), "(no text)")
    meta = docs.select("document_id", bare.alias("_bare"), *carried, *(["pages"] if "pages" in docs.columns else []))
    alone = F.col("chunk_index").isNull()
    out = meta.join(own, "document_id", "left").withColumns({"text": F.when(alone, F.col("_bare")).otherwise(F.col("text")), "semantic_role": F.coalesce("semantic_role", F.lit("other")), "total_chunks": F.coalesce("total_chunks", F.lit(1)), "chunk_index": F.coalesce("chunk_index", F.lit(0))})
    out = out.select("document_id", *[c for c in own.columns if c != "document_id"], *carried, *(["pages"] if "pages" in docs.columns else []))
    out = out.withColumn("chunk_id", F.concat_ws("_", "document_id", "chunk_index"))
    if "pages" in docs.columns:
        start = T.page_at(F.col("pages"), F.col("start_offset"))
        end = F.when(F.col("end_offset") > 0, T.page_at(F.col("pages"), F.col("end_offset") - 1)).otherwise(start)
        out = out.withColumns({"page_start": start, "page_end": end}).drop("pages")
    return out


def windows(docs: DataFrame, size: int = 6000, overlap: int = 150) -> DataFrame:
    """An extension: overlapping windows of characters."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    starts = F.sequence(F.lit(0), F.greatest(F.length("full_text") - 1, F.lit(0)), F.lit(size - overlap))
    return docs.where(F.length("full_text") > 0).select("document_id", "full_text", F.posexplode(starts).alias("chunk_index", "start_offset")).select("document_id", "chunk_index", "start_offset", F.col("full_text").substr(F.col("start_offset") + 1, F.lit(size)).alias("text"))
