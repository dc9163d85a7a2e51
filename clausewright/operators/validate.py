"""Validation, repair and error reports of records."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import schemas
from ..functions import text as T


def record_error(kind: Column, obligations: Column, status: Column) -> Column:
    """Null for a valid record; an obligation has a list, anything else a status."""
    return (
        F.when(kind.isNull(), "classification is missing")
        .when((kind == "obligation") & obligations.isNull(), "obligation needs a list output")
        .when((kind != "obligation") & obligations.isNotNull(), "non-obligation needs a status output")
        .when((kind != "obligation") & status.isNull(), "output is missing")
    )


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted records and the reject log (chunk_id, error)."""
    seen = records.withColumn("error", record_error(F.col("classification"), F.col("output_obligations"), F.col("output_status")))
    return seen.where("error IS NULL").drop("error"), seen.where("error IS NOT NULL").select("chunk_id", "error")


def rule_violations(records: DataFrame) -> DataFrame:
    """chunk_id and the documented field rules that a record breaks."""
    kind = F.col("classification")
    rules = {
        "empty_instruction": T.blank(F.col("instruction")),
        "empty_input_text": T.blank(F.col("input_text")),
        "empty_thought_trace": T.blank(F.col("thought_trace")),
        "unknown_classification": ~F.coalesce(kind.isin(*schemas.CLASSES), F.lit(False)),
        "missing_obligation_list": (kind == "obligation") & (F.coalesce(F.size("output_obligations"), F.lit(0)) < 1),
        "missing_status": (kind != "obligation") & T.blank(F.col("output_status")["status"]),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in rules.items()]))
    return records.select("chunk_id", F.explode(broken).alias("violation"))


def histogram(errors: DataFrame, column: str = "error") -> DataFrame:
    return errors.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


# The training record's schema.
METADATA_KEYS = ("source_id", "regulation_name", "section")
OBLIGATION_KEYS = ("obligation_id", "subject", "modality", "action", "reference_anchor")
OBLIGATION_MORE = ("conditions", "deadline")
STATUS_KEYS = ("status", "message", "reason")
RECORD_MODALITIES = ("MUST", "SHOULD", "MAY", "PROHIBITED", "MUST_NOT", "SHOULD_NOT", "ASPIRATIONAL_OBLIGATION")
STATUSES = ("rejected", "no_obligation")
NULLABLE = ("tool_use", "thought_trace", "tool_call", "available_tools", "tool_rationale", "external_context")
STATUS_MAP = {"no_content": "no_obligation", "incomplete": "rejected", "": "no_obligation"}


def _kind(v: Column, path: str) -> Column:
    """STRING, OBJECT<..., ARRAY<..., VOID for a JSON null, and null where there is nothing."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _any(tests: list[Column]) -> Column:
    return F.coalesce(F.array_contains(F.array(*[F.coalesce(t, F.lit(False)) for t in tests]), True), F.lit(False))


def schema_errors(raw: DataFrame, column: str = "json") -> DataFrame:
    """A training record's text against the record schema: the row with `errors`, an array (empty: valid).  Everything the schema says is tested: keys
    that must be there, types of each field, tool_use and what is in it, every obligation of a list, the three fields of a status object."""
    rows = raw.withColumn("_v", F.try_parse_json(F.col(column)))
    rows = rows.withColumn("_items", F.when(_kind(F.col("_v"), "$.output").startswith("ARRAY"), F.try_variant_get(F.col("_v"), "$.output", "array<variant>")))
    v, items = F.col("_v"), F.col("_items")
    missing = lambda path, x=v: _kind(x, path).isNull()
    other = lambda path, *kinds, x=v: ~_any([_kind(x, path).startswith(k) for k in kinds]) & ~missing(path, x)
    in_list = lambda test: F.coalesce(F.exists(items, test), F.lit(False))
    one_object = _kind(v, "$.output").startswith("OBJECT")
    tools = F.try_variant_get(v, "$.tool_use.available_tools", "array<variant>")
    tests = {
        "not a JSON object": v.isNull() | other("$", "OBJECT"),
        "metadata is missing": missing("$.metadata"),
        "metadata is no object": other("$.metadata", "OBJECT"),
        "metadata lacks a key": _kind(v, "$.metadata").startswith("OBJECT") & _any([missing(f"$.metadata.{k}") for k in METADATA_KEYS]),
        "context is missing": missing("$.context"),
        "context is no string": other("$.context", "STRING"),
        "instruction is no string": other("$.instruction", "STRING", "VOID"),
        "thought_trace is no string": other("$.thought_trace", "STRING", "VOID"),
        "tool_use is neither object nor null": other("$.tool_use", "OBJECT", "VOID"),
        "tool_use holds a wrong type": _any([
            other("$.tool_use.available_tools", "ARRAY"), F.exists(tools, lambda x: ~_kind(x, "$").startswith("STRING")), other("$.tool_use.tool_rationale", "STRING", "VOID"),
            other("$.tool_use.tool_call", "OBJECT", "VOID"), other("$.tool_use.external_context", "STRING", "VOID")]),
        "output is missing": missing("$.output"),
        "output is neither list nor object": other("$.output", "ARRAY", "OBJECT"),
        "obligation is incomplete": in_list(lambda x: ~F.coalesce(_kind(x, "$").startswith("OBJECT"), F.lit(False)) | _any([missing(f"$.{k}", x) for k in OBLIGATION_KEYS])),
        "obligation holds a wrong type": in_list(lambda x: _any([other(f"$.{k}", "STRING", x=x) for k in (*OBLIGATION_KEYS, *OBLIGATION_MORE)])),
        "unknown modality": in_list(lambda x: (_kind(x, "$.modality") == "STRING") & ~F.try_variant_get(x, "$.modality", "string").isin(*RECORD_MODALITIES)),
        "status is incomplete": one_object & _any([missing(f"$.output.{k}") for k in STATUS_KEYS]),
        "status holds a wrong type": one_object & _any([other(f"$.output.{k}", "STRING") for k in STATUS_KEYS]),
        "unknown status": one_object & (_kind(v, "$.output.status") == "STRING") & ~F.try_variant_get(v, "$.output.status", "string").isin(*STATUSES),
    }
    whole = ~tests["not a JSON object"]
    bad = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)) & (whole | F.lit(name == "not a JSON object")), F.lit(name)) for name, t in tests.items()]))
    return rows.withColumn("errors", bad).drop("_v", "_items")


def without_nulls(x, key: str | None = None):
    """A JSON value with empty strings for its nulls at any depth, but for the fields that may be null."""
    if x is None:
        return None if key in NULLABLE else ""
    if isinstance(x, dict):
        return {k: without_nulls(y, k) for k, y in x.items()}
    return [without_nulls(y) for y in x] if isinstance(x, list) else x


def mended(record: dict) -> dict:
    """What the permissive validator makes of a record before it tests it: no nulls, modalities as the schema spells them, unknown
    metadata, a status that the schema knows, and a status object where there is no output."""
    out = without_nulls(record)
    out |= {k: None for k in ("tool_use", "thought_trace") if out.get(k) == ""}
    metadata = out.get("metadata") or {}
    if isinstance(metadata, dict):
        out["metadata"] = metadata | {k: metadata.get(k) or "UNKNOWN" for k in METADATA_KEYS}
    result = out.get("output") or {"status": "no_obligation", "message": "Auto-filled", "reason": "Missing output field"}
    if isinstance(result, dict) and result.get("status", "") not in STATUSES:
        result["status"] = STATUS_MAP.get(str(result.get("status", "")), "rejected")
    for item in result if isinstance(result, list) else ():
        if isinstance(item, dict) and "modality" in item:
            item["modality"] = str(item["modality"]).upper().replace(" ", "_")
    return out | {"output": result}


def mend(raw: DataFrame, column: str = "json") -> DataFrame:
    """The rows with each record's text mended; a text that is no JSON object stays as it is.  Nested values of any shape need a walk, so this is an
    Arrow UDF; `schema_errors` of the result is the permissive validator."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                record = json.loads(t) if t is not None else None
            except ValueError:
                record = None
            out.append(json.dumps(mended(record), ensure_ascii=False) if isinstance(record, dict) else t)
        return pa.array(out, pa.string())

    return raw.withColumn(column, run(F.col(column)))


def map_legacy(raw: DataFrame) -> DataFrame:
    """Old key names to today's.  raw: record_id, json.  Ids that are missing are made from the record, so a rerun gives the same ones."""
    v = F.try_parse_json(F.col("json"))
    get = lambda path: F.try_variant_get(v, path, "string")
    listed = "array<struct<obligation_id:string,subject:string,modality:string,action:string,obligation_text:string,reference_anchor:string>>"
    items = F.coalesce(F.try_variant_get(v, "$.output", listed), F.try_variant_get(v, "$.obligations", listed))
    fixed = F.transform(items, lambda o, i: F.struct(
        F.coalesce(o["obligation_id"], F.concat(F.lit("OBL-"), F.substring(F.sha2(F.concat_ws(":", F.col("record_id").cast("string"), i.cast("string")), 256), 1, 8))).alias("obligation_id"),
        F.coalesce(o["subject"], F.lit("")).alias("subject"), F.coalesce(o["modality"], F.lit("")).alias("modality"), F.coalesce(o["action"], o["obligation_text"], F.lit("")).alias("action"), F.coalesce(o["reference_anchor"], F.lit("N/A")).alias("reference_anchor")))
    status = F.coalesce(get("$.output.status"), get("$.status"))
    return raw.select("record_id", F.coalesce(get("$.context"), get("$.input_text"), get("$.source_text"), F.lit("")).alias("context"), fixed.alias("obligations"), F.when(fixed.isNull(), F.when(status.isin("no_obligation", "rejected"), status).otherwise("rejected")).alias("status"), v.isNull().alias("corrupt"))


def repair(modality: Column) -> Column:
    """Upper case with underscores, as the permissive validator compares."""
    return F.upper(F.replace(F.coalesce(modality, F.lit("")), F.lit(" "), F.lit("_")))


def clean_nulls(df: DataFrame, nullable: tuple[str, ...] = ()) -> DataFrame:
    """Null strings become empty, but for the columns named."""
    return df.select(*[F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if f.dataType.simpleString() == "string" and f.name not in nullable else F.col(f.name) for f in df.schema])
