"""Structural-parse results (nodes with parent paths): contract checks, levels, labels and ancestors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Level of each node type; a document has none.
LEVEL = {
    "PREAMBLE": "section", "RECITAL": "section", "TITLE": "section", "PART": "part", "CHAPTER": "chapter", "SECTION": "section", "ARTICLE": "section",
    "SUBSECTION": "clause", "PARAGRAPH": "clause", "POINT": "clause", "SUBPOINT": "clause", "SCHEDULE": "schedule", "ANNEX": "annex", "DEFINITION": "definition",
}


def level(node_type: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LEVEL.items() for x in kv]), F.upper(node_type))


def label(own: Column, numbering: Column, id_path: Column) -> Column:
    """The label, else the numbering in brackets, else the path's last part."""
    return F.coalesce(F.nullif(own, F.lit("")), F.when(F.size(numbering) > 0, F.concat(F.lit("("), F.array_join(numbering, ")("), F.lit(")"))), F.element_at(F.split(id_path, "/"), -1))


def contract_errors(parses: DataFrame) -> DataFrame:
    """document_id, errors and warnings.  parses: document_id, nodes, relationships (schemas.STRUCTURE)."""
    ids = F.transform("nodes", lambda n: n["id_path"])
    roots = F.size(F.filter("nodes", lambda n: F.upper(n["node_type"]) == "DOCUMENT"))
    errors = F.array_compact(F.array(F.when(F.size(ids) != F.size(F.array_distinct(ids)), "duplicate id_path"), F.when(F.exists("relationships", lambda r: r["type"] != "CONTAINS"), "relation other than CONTAINS"), F.when(roots == 0, "no DOCUMENT root")))
    return parses.select("document_id", errors.alias("errors"), F.when(roots > 1, F.array(F.lit("several roots"))).otherwise(F.array().cast("array<string>")).alias("warnings"))


def ancestors(nodes: DataFrame, stored: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """(document_id, id_path, ancestor, distance): parents up to the root, however deep.  An unknown parent ends a walk.

    Walks are doubled: after round r all ancestors up to distance 2**r are known, and those of the furthest one are joined on by an equi-join within
    documents, so a chain of depth n takes log2(n) rounds.  A node that would meet itself (a cycle) stops where it began.  `stored` may write a round's
    table and read it back, which cuts the lineage; by default a checkpoint does where the context has a folder for it."""
    if stored is None:
        base = nodes.sparkSession.sparkContext.getCheckpointDir() or nodes.sparkSession.conf.get("spark.checkpoint.dir", None)
        stored = (lambda df, n: df.checkpoint()) if base else (lambda df, n: df.cache())
    every = nodes.select("document_id", "id_path", "parent_id_path").dropDuplicates(["document_id", "id_path"])
    here = every.select("document_id", F.col("id_path").alias("ancestor"))
    step = every.select("document_id", "id_path", F.col("parent_id_path").alias("ancestor")).join(here, ["document_id", "ancestor"]).where("id_path <> ancestor")
    walked, reach = stored(step.select("document_id", "id_path", "ancestor", F.lit(1).cast("long").alias("distance")), 0), 1
    while walked.where(F.col("distance") == reach).limit(1).count():  # somebody may go on
        ends = walked.where(F.col("distance") == reach).select("document_id", "id_path", F.col("ancestor").alias("via"))
        more = ends.join(walked.select("document_id", F.col("id_path").alias("via"), "ancestor", F.col("distance").alias("on")), ["document_id", "via"]).where("id_path <> ancestor")
        more = more.select("document_id", "id_path", "ancestor", (F.col("on") + reach).alias("distance"))
        # in a cycle the same ancestor comes round again; the nearest time counts
        found = walked.unionByName(more).groupBy("document_id", "id_path", "ancestor").agg(F.min("distance").alias("distance"))
        walked, reach = stored(found, reach), 2 * reach
    return walked


def segments(nodes: DataFrame) -> DataFrame:
    """Nodes as segments: role other, offsets 0, the page they begin on; a document's own node is none."""
    return nodes.select("document_id", "id_path", level(F.col("node_type")).alias("level"), label(F.col("label"), F.col("numbering"), F.col("id_path")).alias("label"), "title", F.coalesce("text", F.lit("")).alias("text"), F.lit("other").alias("semantic_role"), F.lit(0).alias("start_offset"), F.lit(0).alias("end_offset"), F.col("page_start").alias("page")).where("level IS NOT NULL")


def with_fallback(parsed: DataFrame, regex: DataFrame) -> DataFrame:
    """A document's parsed segments where there are any, else those of the expressions."""
    return parsed.unionByName(regex.join(parsed.select("document_id").distinct(), "document_id", "left_anti"), allowMissingColumns=True)
