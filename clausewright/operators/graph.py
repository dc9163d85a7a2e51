"""Nodes and edges of the document ontology and of extracted records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_KIND = {"subsection": "Subsection", "clause": "Clause", "definition": "LegalDefinition", "explanation": "Explanation", "proviso": "Proviso", "section": "Section", "part": "Part", "chapter": "Chapter", "schedule": "Schedule"}
_EDGE = {"subsection": "SECTION_HAS_SUBSECTION", "clause": "SECTION_HAS_CLAUSE", "definition": "SECTION_CONTAINS_DEFINITION", "explanation": "SECTION_HAS_EXPLANATION", "proviso": "SECTION_HAS_PROVISO"}


def _case(c: Column, values: dict[str, str]) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(c == k, F.lit(v))
    return out


def _placed(segs: DataFrame, strict: bool) -> DataFrame:
    """Each span with its node id, its parent's id and the relation between them; spans that the graph leaves out are gone."""
    act, level, label, section = F.col("document_id"), F.col("level"), F.col("label"), F.col("section_number")
    sid = lambda *p: T.structural_id(act, *[F.lit(x) if isinstance(x, str) else x for x in p])
    in_section = F.when(section.isNotNull(), sid("section", section)).otherwise(act)
    holder = F.col("holder")
    own = (
        F.when(level.isin("part", "chapter", "schedule", "section"), T.structural_id(act, level, label))
        .when(level.isin("subsection", "clause"), sid("clause", F.coalesce(section, F.lit("root")), label))
        .when(level == "definition", sid("definition", F.coalesce(section, F.lit("root")), label))
        .when(level == "explanation", sid("explanation", section, label))
        .when(level == "proviso", sid("proviso", section, label))
    )
    parent = (
        F.when(level.isin("part", "schedule"), act)
        .when(level == "chapter", F.when(F.col("first_part").isNotNull(), sid("part", F.col("first_part"))).otherwise(act))
        .when(level == "section", F.when(holder.isNotNull(), T.structural_id(act, holder["level"], holder["label"])).otherwise(act))
        .otherwise(in_section)
    )
    under_schedule = F.lit("SCHEDULE_HAS_SECTION" if strict else "CHAPTER_HAS_SECTION")
    relation = (
        F.when(level == "part", "DOCUMENT_HAS_PART")
        .when(level == "schedule", "ACT_HAS_SCHEDULE")
        .when(level == "chapter", F.when(F.col("first_part").isNotNull(), "PART_HAS_CHAPTER").otherwise("ACT_HAS_CHAPTER"))
        .when(level == "section", F.when(holder.isNull(), "ACT_HAS_SECTION").when(holder["level"] == "schedule", under_schedule).otherwise("CHAPTER_HAS_SECTION"))
        .otherwise(_case(level, _EDGE))
    )
    kept = level.isin(*_KIND) & ~(level.isin("explanation", "proviso") & section.isNull())
    return segs.where(kept).withColumns({"id": own, "parent": parent, "relation": relation})


def nodes(docs: DataFrame, segs: DataFrame, strict: bool = False) -> DataFrame:
    """(document_id, id, type, label, properties).  docs: document_id, act_name, regulator, effective_date, local_path."""
    text = F.coalesce(F.col("regulator"), F.lit(""))
    one = lambda id_, kind, label, **p: docs.select("document_id", id_.alias("id"), F.lit(kind).alias("type"), label.alias("label"), _props(p).alias("properties"))
    date, path = F.col("effective_date"), F.col("local_path")
    fixed = one(T.regulator_id(text), "Regulator", text, name=text)
    fixed = fixed.unionByName(one(F.col("document_id"), "Act", F.col("act_name"), name=F.col("act_name"), document_id=F.col("document_id"), source_path=path, effective_date=date))
    fixed = fixed.unionByName(one(T.structural_id(F.col("document_id"), F.lit("effective_date"), date), "EffectiveDate", date, date=date).where(F.coalesce("label", F.lit("")) != ""))
    fixed = fixed.unionByName(one(T.structural_id(F.col("document_id"), F.lit("source_document"), path), "SourceDocument", path, path=path).where(F.coalesce("label", F.lit("")) != ""))
    most = F.when(F.col("level") == "section", 300).otherwise(200)
    preview = F.when(~F.col("level").isin("part", "chapter", "schedule"), F.col("text").substr(F.lit(1), most))
    title = F.when(~F.col("level").isin("explanation", "proviso"), F.col("title"))
    role = F.when(F.col("level").isin("section", "subsection", "clause"), F.col("semantic_role"))
    act = F.when(F.col("level").isin("part", "chapter", "schedule", "section"), F.col("document_id"))
    own = _placed(segs, strict).select("document_id", "id", _case(F.col("level"), _KIND).alias("type"), "label", _props({"title": title, "text_preview": preview, "semantic_role": role, "act_id": act}).alias("properties"))
    return fixed.unionByName(own)


def _props(values: dict[str, Column]) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())


def edges(docs: DataFrame, segs: DataFrame, strict: bool = False) -> DataFrame:
    """(document_id, source, target, type).  Every structural relation has a CONTAINS beside it."""
    reg, act = T.regulator_id(F.coalesce(F.col("regulator"), F.lit(""))), F.col("document_id")
    one = lambda a, b, kind, where=None: (docs if where is None else docs.where(where)).select("document_id", a.alias("source"), b.alias("target"), F.lit(kind).alias("type"))
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    out = one(act, reg, "ACT_ISSUED_BY_REGULATOR").unionByName(one(reg, act, "CONTAINS"))
    out = out.unionByName(one(act, T.structural_id(act, F.lit("effective_date"), F.col("effective_date")), "ACT_HAS_EFFECTIVE_DATE", has("effective_date")))
    out = out.unionByName(one(act, T.structural_id(act, F.lit("source_document"), F.col("local_path")), "ACT_SOURCE_DOCUMENT", has("local_path")))
    own = _placed(segs, strict).select("document_id", F.col("parent").alias("source"), F.col("id").alias("target"), F.explode(F.array("relation", F.lit("CONTAINS"))).alias("type"))
    return out.unionByName(own)


def record_graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of extracted records as upserts leave them: one node a key, the last record's values, by `seq`."""
    doc = T.document_of(F.col("chunk_id"))
    base = records.withColumn("document_id", doc)
    ob = base.where("classification = 'obligation'").select("document_id", "chunk_id", "seq", F.explode("output_obligations").alias("o"))
    parts = [
        base.groupBy(F.col("document_id").alias("id")).agg(F.lit("Document").alias("type"), F.max_by("regulation_name", "seq").alias("label")),
        base.groupBy(F.col("chunk_id").alias("id")).agg(F.lit("Chunk").alias("type"), F.max_by("section", "seq").alias("label")),
        ob.groupBy(F.col("o.obligation_id").alias("id")).agg(F.lit("Obligation").alias("type"), F.max_by("o.action", "seq").alias("label")),
        base.where("classification <> 'obligation'").groupBy(F.concat(F.lit("NON-"), "chunk_id").alias("id")).agg(F.lit("NonObligation").alias("type"), F.max_by("output_status.status", "seq").alias("label")),
    ]
    node = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    edge = base.select(F.col("document_id").alias("source"), F.col("chunk_id").alias("target"), F.lit("CONTAINS").alias("type"))
    edge = edge.unionByName(ob.select(F.col("chunk_id").alias("source"), F.col("o.obligation_id").alias("target"), F.lit("YIELDS").alias("type")))
    edge = edge.unionByName(base.where("classification <> 'obligation'").select(F.col("chunk_id").alias("source"), F.concat(F.lit("NON-"), "chunk_id").alias("target"), F.lit("YIELDS").alias("type")))
    return node, edge.distinct()
