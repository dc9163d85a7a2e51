"""Obligation records from chunks: the rule extractor, and pluggable ones behind the same interface."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import schemas
from ..functions import text as T

# The rule records' texts.
INSTRUCTION = "Analyze the provided regulatory text to extract specific compliance obligations. If terminology is ambiguous, use the 'askLia' tools to clarify definitions before finalizing the extraction."
THOUGHT = {
    "obligation": "1. Identified mandatory deontic cue. 2. Modality is MUST. 3. Synthesize obligation output.",
    "non_obligation": "1. Identified permissive or recommended deontic cue. 2. Modality does not mandate action. 3. Conclude non-obligation (permission).",
    "neutral": "1. Analyzed syntax tree. 2. No deontic markers found indicating a requirement. 3. Conclude declarative statement.",
}
STATUS = {
    "non_obligation": ("rejected", "Permission or non-mandatory clause", "Non-mandatory modality detected (e.g., may/can/should)."),
    "neutral": ("no_obligation", "Neutral/definition clause", "No mandatory action detected."),
}


def inputs(chunks: DataFrame) -> DataFrame:
    """Chunks as extractor inputs: names and pages defaulted, character range over the text."""
    have = lambda c: F.col(c) if c in chunks.columns else F.lit(None).cast("string")
    return chunks.select(
        "chunk_id", F.col("text").alias("chunk_text"), T.or_else(have("act_name"), have("title"), "Unknown").alias("document_title"), have("jurisdiction").alias("jurisdiction"), have("section_number").alias("section_number"),
        F.coalesce(have("page_start").cast("int"), F.lit(0)).alias("page"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), *(["seq"] if "seq" in chunks.columns else []))


def _by_class(kind: Column, values: dict[str, str]) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(kind == k, F.lit(v))
    return out


def records(payload: DataFrame) -> DataFrame:
    """Rule records; exactly one of output_obligations and output_status is set."""
    kind = F.col("classification")
    cue, modality = T.detected_modality(F.col("chunk_text"))
    one = F.struct(F.concat(F.lit("OBL-"), "chunk_id").alias("obligation_id"), F.lit("Extracted Entity").alias("subject"), F.lit("MUST").alias("modality"), F.lit("Extracted Action").alias("action"), F.lit(None).cast("string").alias("modality_detected"), F.col("section_number").alias("reference_anchor"))
    status = F.struct(*[_by_class(kind, {k: v[i] for k, v in STATUS.items()}).alias(n) for i, n in enumerate(("status", "message", "reason"))])
    return payload.withColumn("classification", T.deontic_class(F.col("chunk_text"))).select(
        "chunk_id", F.col("chunk_id").alias("source_id"), F.col("document_title").alias("regulation_name"), T.or_else(F.col("jurisdiction"), "UNKNOWN").alias("jurisdiction"), F.lit("Regulation").alias("doc_type"),
        T.or_else(F.col("section_number"), "Unknown").alias("section"), "classification", F.lit(INSTRUCTION).alias("instruction"), F.col("chunk_text").alias("input_text"), _by_class(kind, THOUGHT).alias("thought_trace"),
        cue.alias("modality_detected"), modality.alias("modality_normal"), F.when(kind == "obligation", F.array(one)).cast(schemas.OBLIGATION).alias("output_obligations"), F.when(kind != "obligation", status).cast(schemas.STATUS).alias("output_status"),
        *(["seq"] if "seq" in payload.columns else []))


def overridden(extracted: DataFrame, payload: DataFrame) -> DataFrame:
    """What an extractor may not decide is taken from its input: ids, names, texts, and the section where it is known."""
    own = payload.select("chunk_id", F.col("document_title").alias("_t"), F.col("jurisdiction").alias("_j"), F.col("section_number").alias("_s"), F.col("chunk_text").alias("_x"))
    return extracted.join(own, "chunk_id").withColumns({"source_id": F.col("chunk_id"), "regulation_name": F.col("_t"), "jurisdiction": T.or_else(F.col("_j"), "UNKNOWN"), "doc_type": F.lit("Regulation"), "input_text": F.col("_x"), "section": T.or_else(F.col("_s"), F.col("section"), "Unknown")}).drop("_t", "_j", "_s", "_x")


def asked(payload: DataFrame, extractor: Callable[[DataFrame], DataFrame], attempts: int = 3, stored: Callable[[DataFrame], DataFrame] = DataFrame.cache) -> DataFrame:
    """An extractor's rows, those with an `error` asked again up to `attempts` times in all; the last error stays.  Each attempt is stored, so
    that nothing is asked twice for one answer (on a cluster give a `stored` that writes a table, since a cache goes with its executor)."""
    done = stored(extractor(payload))
    if "error" not in done.columns:
        return done
    for _ in range(attempts - 1):
        again = payload.join(done.where("error IS NOT NULL").select("chunk_id"), "chunk_id", "left_semi")
        if not again.limit(1).count():
            break
        done = stored(done.where("error IS NULL").unionByName(extractor(again)))
    return done


def extract(payload: DataFrame, extractor: Callable[[DataFrame], DataFrame] | None = None, attempts: int = 3, stored: Callable[[DataFrame], DataFrame] = DataFrame.cache) -> DataFrame:
    """Rule records, or a plugged-in extractor's with the rule record where it gives none.  Where the extractor tells errors, a row that still has one
    after all attempts is the rule record with the error as `extract_error`, for the reject log."""
    rule = records(payload)
    if extractor is None:
        return rule
    answers = asked(payload, extractor, attempts, stored)
    errors = "error" in answers.columns
    made = overridden(answers.where("error IS NULL") if errors else answers, payload).select(rule.columns)
    rest = rule.join(made.select("chunk_id"), "chunk_id", "left_anti")
    if errors:
        rest = rest.join(answers.where("error IS NOT NULL").select("chunk_id", F.col("error").alias("extract_error")), "chunk_id", "left")
    return made.unionByName(rest, allowMissingColumns=True)


def provider(name: str, known: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame], DataFrame]:
    """The extractor of a provider's name, in any case; a name that isn't known is an error before anything runs."""
    by = {k.lower(): v for k, v in known.items()}
    if name.strip().lower() not in by:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(by)) or 'none'}")
    return by[name.strip().lower()]


#: What a structural parse must give; the shape is functions.schemas.STRUCTURE.
STRUCTURE_RULES = (
    "Give one JSON object with document_metadata, nodes and relationships.",
    "Each node has id_path, node_type, label, title, numbering, text, parent_id_path and page_start; id_path is unique.",
    "Exactly one node is of type DOCUMENT and has no parent; every other node names its parent.",
    "Relationships are of type CONTAINS, from parent to child.",
    "Copy text word for word; invent nothing; leave out what isn't there.",
)


def structure_prompt(docs: DataFrame, most: int = 100_000) -> DataFrame:
    """document_id and the prompt that a remote structural parser is asked with; a provider's window bounds the text to `most` characters."""
    title = F.coalesce(F.col("title"), F.lit("Unknown")) if "title" in docs.columns else F.lit("Unknown")
    return docs.select("document_id", F.concat_ws("\n", *[F.lit(x) for x in STRUCTURE_RULES], F.concat(F.lit("Title: "), title), F.lit("Text:"), F.substring("full_text", 1, most)).alias("prompt"))


def prompt(payload: DataFrame) -> DataFrame:
    """The instruction, metadata and text that a remote extractor is asked with."""
    return payload.select("chunk_id", F.concat_ws("\n", F.lit(INSTRUCTION), F.concat(F.lit("Regulation: "), "document_title"), F.concat(F.lit("Section: "), T.or_else(F.col("section_number"), "Unknown")), F.lit("Text:"), "chunk_text").alias("prompt"))


def confidence(records_: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """An extension: a weighted sum of signals with a tier.  Grounding is the share of an output's words that the input has."""
    w = weights or {"grounding": 0.3, "modality": 0.25, "schema": 0.2, "anchor": 0.15, "length": 0.1}
    words = lambda c: F.array_distinct(F.split(F.lower(c), "[^a-z0-9]+"))
    out = words(F.coalesce(F.element_at("output_obligations", 1)["action"], F.col("output_status")["message"], F.lit("")))
    signal = {
        "grounding": F.size(F.array_intersect(out, words(F.col("input_text")))) / F.greatest(F.size(out), F.lit(1)),
        "modality": ((F.col("classification") == "obligation") == F.lower("input_text").rlike(T.MANDATORY)).cast("double"),
        "schema": (F.col("output_obligations").isNotNull() != F.col("output_status").isNotNull()).cast("double"),
        "anchor": (F.col("section") != "Unknown").cast("double"),
        "length": (F.length("input_text") >= 20).cast("double"),
    }
    total = sum((F.lit(float(v)) * signal[k] for k, v in w.items()), F.lit(0.0))
    return records_.withColumns({f"signal_{k}": v for k, v in signal.items()} | {"confidence": total}).withColumn("tier", F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low"))
