"""Queries over the driver's tables and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bridge, chunk, dedup, extract, graph, metrics, sample, search, segment, validate
from ..sources import sinks
from ..sources.tables import ACTS_SQL, CLAUSES_SQL, acts, clauses, extracted, fetched, local_manifest, metadata, table, tolerant_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
RATIOS = {"obligation": 0.5, "non_obligation": 0.2, "neutral": 0.3}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# SQL fragments shared by oracles
CLASS_SQL = r"CASE WHEN regexp_matches(lower(text), '\b(shall|must|is required to|are required to)\b') THEN 'obligation' WHEN regexp_matches(lower(text), '\b(may|can|should)\b') THEN 'non_obligation' ELSE 'neutral' END"
KINDS_SQL = f"WITH {CLAUSES_SQL}, kinds AS (SELECT *, {CLASS_SQL} AS classification FROM clauses)"
ROLE_SQL = """CASE WHEN t LIKE '%shall be punishable%' OR t LIKE '%punishment%' OR t LIKE '%penalty%' OR t LIKE '%imprisonment%' THEN 'penalty' WHEN t LIKE '%shall %' AND (t LIKE '%not %' OR t LIKE '%no %') THEN 'prohibition'
  WHEN t LIKE '%shall %' OR t LIKE '%must %' THEN 'obligation' WHEN t LIKE '%means %' OR t LIKE '%definition%' THEN 'definition' WHEN t LIKE '%provided that%' OR t LIKE '%proviso%' THEN 'proviso'
  WHEN t LIKE '%procedure%' OR t LIKE '%apply%' OR t LIKE '%application%' THEN 'procedure' WHEN t LIKE '%power%' OR t LIKE '%authority%' OR t LIKE '%may %' THEN 'authority' WHEN t LIKE '%exception%' OR t LIKE '%except%' THEN 'exception' ELSE 'other' END"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    c = clauses(spark, d)
    return extract.records(extract.inputs(c.withColumn("act_name", F.concat(F.lit("Rules of "), "document_id")).withColumn("section_number", F.col("o_custkey").cast("string"))))


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    return clauses(spark, d).withColumn("classification", T.deontic_class(F.col("text")))


# -- extraction and classification

@query(f"{KINDS_SQL} SELECT classification, count(*) AS n FROM kinds GROUP BY classification")
def deontic_class_counts(spark, d):
    return _kinds(spark, d).groupBy("classification").agg(F.count("*").alias("n"))


@query(f"""{KINDS_SQL} SELECT chunk_id, 'Rules of ' || document_id AS regulation_name, 'UNKNOWN' AS jurisdiction, CAST(o_custkey AS VARCHAR) AS section, classification,
  CASE WHEN classification = 'obligation' THEN 'OBL-' || chunk_id END AS obligation_id, CASE classification WHEN 'non_obligation' THEN 'rejected' WHEN 'neutral' THEN 'no_obligation' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'MUST' WHEN '2-HIGH' THEN 'MUST' WHEN '3-MEDIUM' THEN 'MAY' WHEN '4-NOT SPECIFIED' THEN 'SHOULD' END AS modality_normal FROM kinds""")
def deontic_records(spark, d):
    return _records(spark, d).select("chunk_id", "regulation_name", "jurisdiction", "section", "classification", F.element_at("output_obligations", 1)["obligation_id"].alias("obligation_id"), F.col("output_status.status").alias("status"), "modality_normal")


@query(f"WITH {CLAUSES_SQL}, r AS (SELECT lower(substr(text, 1, 500)) AS t FROM clauses) SELECT {ROLE_SQL} AS role, count(*) AS n FROM r GROUP BY 1")
def semantic_role_counts(spark, d):
    return clauses(spark, d).select(T.semantic_role(F.lit("section"), F.col("text")).alias("role")).groupBy("role").agg(F.count("*").alias("n"))


@query(f"""{KINDS_SQL}, w AS (SELECT classification, CAST(o_custkey AS VARCHAR) AS section, text, list_distinct(string_split_regex(lower(text), '[^a-z0-9]+')) AS have,
  list_distinct(string_split_regex(CASE classification WHEN 'obligation' THEN 'extracted action' WHEN 'non_obligation' THEN 'permission or non mandatory clause' ELSE 'neutral definition clause' END, ' ')) AS said FROM kinds),
c AS (SELECT classification, 0.3::DOUBLE * len(list_intersect(said, have)) / len(said) + 0.25::DOUBLE * CAST((classification = 'obligation') = regexp_matches(lower(text), '\\b(shall|must|is required to|are required to)\\b') AS INT)
  + 0.2::DOUBLE + 0.15::DOUBLE * CAST(section <> 'Unknown' AS INT) + 0.1::DOUBLE * CAST(length(text) >= 20 AS INT) AS c FROM w)
SELECT classification, CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.5 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n, round(avg(c), 6) AS mean_confidence FROM c GROUP BY 1, 2""")
def composite_confidence(spark, d):
    return extract.confidence(_records(spark, d)).groupBy("classification", "tier").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(f"{KINDS_SQL} SELECT chunk_id, length(text) AS char_end, 'Unknown' AS document_title, 0 AS page FROM kinds")
def extract_inputs(spark, d):
    return extract.inputs(clauses(spark, d)).select("chunk_id", "char_end", "document_title", "page")


# -- validation and repair

def _damaged(spark, d):
    r = _records(spark, d)
    return r.withColumns({
        "output_obligations": F.when(F.col("seq") % 10 == 1, F.lit(None)).otherwise(F.col("output_obligations")), "thought_trace": F.when(F.col("seq") % 7 == 2, F.lit(" ")).otherwise(F.col("thought_trace")),
        "classification": F.when(F.col("seq") % 13 == 3, "maybe").otherwise(F.col("classification"))})


DAMAGED_SQL = f"""{KINDS_SQL}, damaged AS (SELECT chunk_id, seq, CASE WHEN seq % 13 = 3 THEN 'maybe' ELSE classification END AS kind, classification = 'obligation' AND seq % 10 <> 1 AS has_list, classification <> 'obligation' AS has_status, seq % 7 = 2 AS no_trace FROM kinds),
errors AS (SELECT chunk_id, CASE WHEN kind = 'obligation' AND NOT has_list THEN 'obligation needs a list output' WHEN kind <> 'obligation' AND has_list THEN 'non-obligation needs a status output' WHEN kind <> 'obligation' AND NOT has_status THEN 'output is missing' END AS error FROM damaged)"""


@query(f"{DAMAGED_SQL} SELECT chunk_id, error FROM errors WHERE error IS NOT NULL")
def reject_log(spark, d):
    return validate.split_valid(_damaged(spark, d))[1]


@query(f"{DAMAGED_SQL} SELECT error, count(*) AS n FROM errors WHERE error IS NOT NULL GROUP BY error")
def error_histogram(spark, d):
    return validate.histogram(validate.split_valid(_damaged(spark, d))[1])


@query(f"""{DAMAGED_SQL} SELECT chunk_id, unnest(['empty_thought_trace']) AS violation FROM damaged WHERE no_trace UNION ALL SELECT chunk_id, 'unknown_classification' FROM damaged WHERE kind = 'maybe'
  UNION ALL SELECT chunk_id, 'missing_obligation_list' FROM damaged WHERE kind = 'obligation' AND NOT has_list UNION ALL SELECT chunk_id, 'missing_status' FROM damaged WHERE kind <> 'obligation' AND NOT has_status""")
def rule_violations(spark, d):
    return validate.rule_violations(_damaged(spark, d))


def _raw_json(spark, d):
    """Training records in old and new key names, some broken, made from orders."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"))
    k = F.col("record_id") % 6
    s = F.col("record_id").cast("string")
    item = F.concat(F.lit('[{"subject":"s'), s, F.lit('","modality":"MUST","action":"a"}]'))
    text = (
        F.when(k == 0, F.concat(F.lit('{"metadata":{},"context":"c'), s, F.lit('","output":'), item, F.lit("}")))
        .when(k == 1, F.concat(F.lit('{"metadata":{},"input_text":"c'), s, F.lit('","obligations":[{"obligation_text":"do '), s, F.lit('"}]}')))
        .when(k == 2, F.concat(F.lit('{"source_text":"c'), s, F.lit('","output":{"status":"odd"}}')))
        .when(k == 3, F.concat(F.lit('{"metadata":{},"context":"c'), s, F.lit('","output":{"status":"no_obligation"}}')))
        .when(k == 4, F.concat(F.lit('{"metadata":{},"context":"c'), s, F.lit('","output":[{"modality":"OUGHT"}]}')))
        .otherwise(F.concat(F.lit('{"metadata":'), s)))
    return o.withColumn("json", text)


#: Records that keep and break each rule of the record schema; `#` stands for the order's key.
_META = '"metadata":{"source_id":"#","regulation_name":"r","section":"1"}'
_ITEM = '"obligation_id":"o#","subject":"s","action":"a","reference_anchor":"x"'
SCHEMA_CASES = (
    f'{{{_META},"context":"c#","output":[{{{_ITEM},"modality":"MUST"}}]}}',
    f'{{{_META},"context":"c#","instruction":null,"thought_trace":"t","tool_use":null,"output":{{"status":"rejected","message":"m","reason":"r"}}}}',
    f'{{{_META},"context":"c#","output":[{{{_ITEM},"modality":"MUST"}},{{{_ITEM},"modality":"must not"}}]}}',
    f'{{{_META},"context":"c#","output":[{{{_ITEM},"modality":"SHALL","deadline":5}}]}}',
    f'{{{_META},"context":"c#","output":[{{"obligation_id":"o#","modality":"MAY","subject":null}}, 7]}}',
    f'{{{_META},"context":"c#","output":[]}}',
    f'{{{_META},"context":"c#","output":{{"status":"no_content","message":"m","reason":null}}}}',
    f'{{{_META},"context":"c#","output":{{"status":"incomplete"}}}}',
    f'{{{_META},"context":"c#","output":"none"}}',
    f'{{{_META},"context":"c#"}}',
    '{"metadata":{"source_id":"#","section":""},"context":null,"output":[]}',
    '{"metadata":[],"context":4,"instruction":[],"thought_trace":{},"output":null}',
    '{"context":"c#","output":{"status":"","message":"m","reason":"r"}}',
    f'{{{_META},"context":"c#","tool_use":"none","output":[]}}',
    f'{{{_META},"context":"c#","tool_use":{{"available_tools":["a",1],"tool_rationale":null}},"output":[]}}',
    f'{{{_META},"context":"c#","tool_use":{{"available_tools":["a"],"tool_call":"f","external_context":"e"}},"output":[]}}',
    f'{{{_META},"context":"c#","tool_use":{{"available_tools":[],"tool_call":{{}},"tool_rationale":"r"}},"output":[{{{_ITEM},"modality":"Aspirational obligation","conditions":"if"}}]}}',
    '{"metadata":#', '[1, 2]', 'null',
)


def _schema_cases(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"))
    case = F.element_at(F.array(*[F.lit(x) for x in SCHEMA_CASES]), (F.col("record_id") % len(SCHEMA_CASES) + 1).cast("int"))
    return o.withColumn("json", F.replace(case, F.lit("#"), F.col("record_id").cast("string")))


_LISTED = ", ".join("'" + x.replace("'", "''") + "'" for x in SCHEMA_CASES)
_KEYS = {"m": ("source_id", "regulation_name", "section"), "o": ("obligation_id", "subject", "modality", "action", "reference_anchor"), "s": ("status", "message", "reason")}
_IN = lambda kinds: "(" + ", ".join(f"'{k}'" for k in kinds) + ")"
_BAD = lambda x, path, *kinds: f"coalesce(json_type({x}, '{path}') NOT IN {_IN(kinds)}, false)"
_LACKS = lambda x, at, keys: "(" + " OR ".join(f"json_type({x}, '{at}.{k}') IS NULL" for k in keys) + ")"
CASES_SQL = f"""WITH c AS (SELECT o_orderkey AS record_id, replace(list_extract([{_LISTED}], CAST(o_orderkey % {len(SCHEMA_CASES)} + 1 AS BIGINT)), '#', CAST(o_orderkey AS VARCHAR)) AS t FROM orders),
j AS (SELECT record_id, t, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM c),
k AS (SELECT *, json_type(j, '$.output') AS kind, coalesce(json_type(j) = 'OBJECT', false) AS whole, CASE WHEN json_type(j, '$.output') = 'ARRAY' THEN json_extract(j, '$.output[*]') ELSE [] END AS items FROM j)"""


@query(f"""{CASES_SQL}, e AS (SELECT record_id, [
  CASE WHEN NOT whole THEN 'not a JSON object' END,
  CASE WHEN whole AND json_type(j, '$.metadata') IS NULL THEN 'metadata is missing' END,
  CASE WHEN whole AND {_BAD("j", "$.metadata", "OBJECT")} THEN 'metadata is no object' END,
  CASE WHEN whole AND json_type(j, '$.metadata') = 'OBJECT' AND {_LACKS("j", "$.metadata", _KEYS["m"])} THEN 'metadata lacks a key' END,
  CASE WHEN whole AND json_type(j, '$.context') IS NULL THEN 'context is missing' END,
  CASE WHEN whole AND {_BAD("j", "$.context", "VARCHAR")} THEN 'context is no string' END,
  CASE WHEN whole AND {_BAD("j", "$.instruction", "VARCHAR", "NULL")} THEN 'instruction is no string' END,
  CASE WHEN whole AND {_BAD("j", "$.thought_trace", "VARCHAR", "NULL")} THEN 'thought_trace is no string' END,
  CASE WHEN whole AND {_BAD("j", "$.tool_use", "OBJECT", "NULL")} THEN 'tool_use is neither object nor null' END,
  CASE WHEN whole AND ({_BAD("j", "$.tool_use.available_tools", "ARRAY")} OR len(list_filter(json_extract(j, '$.tool_use.available_tools[*]'), lambda x: json_type(x) <> 'VARCHAR')) > 0
    OR {_BAD("j", "$.tool_use.tool_rationale", "VARCHAR", "NULL")} OR {_BAD("j", "$.tool_use.tool_call", "OBJECT", "NULL")} OR {_BAD("j", "$.tool_use.external_context", "VARCHAR", "NULL")}) THEN 'tool_use holds a wrong type' END,
  CASE WHEN whole AND kind IS NULL THEN 'output is missing' END,
  CASE WHEN whole AND kind NOT IN ('ARRAY', 'OBJECT') THEN 'output is neither list nor object' END,
  CASE WHEN whole AND len(list_filter(items, lambda x: json_type(x) <> 'OBJECT' OR {_LACKS("x", "$", _KEYS["o"])})) > 0 THEN 'obligation is incomplete' END,
  CASE WHEN whole AND len(list_filter(items, lambda x: {" OR ".join(_BAD("x", f"$.{k}", "VARCHAR") for k in (*_KEYS["o"], "conditions", "deadline"))})) > 0 THEN 'obligation holds a wrong type' END,
  CASE WHEN whole AND len(list_filter(items, lambda x: coalesce(json_type(x, '$.modality') = 'VARCHAR' AND json_extract_string(x, '$.modality') NOT IN ('MUST', 'SHOULD', 'MAY', 'PROHIBITED', 'MUST_NOT', 'SHOULD_NOT', 'ASPIRATIONAL_OBLIGATION'), false))) > 0 THEN 'unknown modality' END,
  CASE WHEN whole AND kind = 'OBJECT' AND {_LACKS("j", "$.output", _KEYS["s"])} THEN 'status is incomplete' END,
  CASE WHEN whole AND kind = 'OBJECT' AND ({" OR ".join(_BAD("j", f"$.output.{k}", "VARCHAR") for k in _KEYS["s"])}) THEN 'status holds a wrong type' END,
  CASE WHEN whole AND kind = 'OBJECT' AND json_type(j, '$.output.status') = 'VARCHAR' AND json_extract_string(j, '$.output.status') NOT IN ('rejected', 'no_obligation') THEN 'unknown status' END
] AS errors FROM k), u AS (SELECT record_id, unnest(errors) AS error FROM e) SELECT * FROM u WHERE error IS NOT NULL""")
def schema_validation(spark, d):
    return validate.schema_errors(_schema_cases(spark, d)).select("record_id", F.explode("errors").alias("error"))


@query(f"""{CASES_SQL}, v AS (SELECT *, coalesce(kind IN ('ARRAY', 'OBJECT') AND json_extract_string(j, '$.output') NOT IN ('[]', '{{}}'), false) AS full_, json_extract_string(j, '$.output.status') AS st FROM k WHERE whole)
SELECT record_id, coalesce(nullif(json_extract_string(j, '$.metadata.section'), ''), 'UNKNOWN') AS section, coalesce(json_extract_string(j, '$.metadata.regulation_name'), 'UNKNOWN') AS regulation,
  CASE WHEN kind = 'OBJECT' THEN CASE WHEN st IN ('rejected', 'no_obligation') THEN st WHEN coalesce(st, '') IN ('', 'no_content') THEN 'no_obligation' ELSE 'rejected' END WHEN kind IS NULL OR kind = 'NULL' OR NOT full_ AND kind = 'ARRAY' THEN 'no_obligation' END AS status,
  CASE WHEN kind = 'ARRAY' AND json_type(j, '$.output[0]') = 'OBJECT' THEN upper(replace(json_extract_string(j, '$.output[0].modality'), ' ', '_')) END AS modality, CASE WHEN json_type(j, '$.context') = 'VARCHAR' THEN json_extract_string(j, '$.context') WHEN json_type(j, '$.context') = 'NULL' THEN '' ELSE CAST(json_extract(j, '$.context') AS VARCHAR) END AS context FROM v""")
def permissive_repair(spark, d):
    """What the permissive validator makes of each record."""
    v = F.try_parse_json("json")
    get = lambda path: F.try_variant_get(v, path, "string")
    made = validate.mend(_schema_cases(spark, d)).where(F.schema_of_variant(v).startswith("OBJECT"))
    return made.select("record_id", get("$.metadata.section").alias("section"), get("$.metadata.regulation_name").alias("regulation"), get("$.output.status").alias("status"), get("$.output[0].modality").alias("modality"), get("$.context").alias("context"))


@query("""SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 6 = 5 THEN '' ELSE 'c' || o_orderkey END AS context, CASE o_orderkey % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'do ' || o_orderkey WHEN 4 THEN '' END AS action,
  CASE WHEN o_orderkey % 6 IN (0, 1, 4) THEN 'N/A' END AS anchor, CASE WHEN o_orderkey % 6 IN (0, 1, 4) THEN 'OBL-' || substr(sha256(o_orderkey || ':0'), 1, 8) END AS obligation_id, CASE o_orderkey % 6 WHEN 2 THEN 'rejected' WHEN 3 THEN 'no_obligation' WHEN 5 THEN 'rejected' END AS status, o_orderkey % 6 = 5 AS corrupt FROM orders""")
def legacy_mapping(spark, d):
    o = F.element_at("obligations", 1)
    return validate.map_legacy(_raw_json(spark, d)).select("record_id", "context", o["action"].alias("action"), o["reference_anchor"].alias("anchor"), o["obligation_id"].alias("obligation_id"), "status", "corrupt")


@query("SELECT count(*) FILTER (o_orderkey % 6 <> 5) AS parsed, count(*) FILTER (o_orderkey % 6 = 5) AS rejected, round(count(*) FILTER (o_orderkey % 6 = 5) / count(*), 6) AS failure_rate FROM orders")
def tolerant_scan(spark, d):
    good, bad = tolerant_lines(_raw_json(spark, d).select(F.col("json").alias("value")))
    both = good.agg(F.count("*").alias("parsed")).crossJoin(bad.agg(F.count("*").alias("rejected")))
    return both.withColumn("failure_rate", F.round(F.col("rejected") / F.greatest(F.col("parsed") + F.col("rejected"), F.lit(1)), 6))


@query("SELECT o_orderpriority AS raw, upper(replace(o_orderpriority, ' ', '_')) AS modality, count(*) AS n FROM orders GROUP BY 1, 2")
def modality_repair(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("raw"), validate.repair(F.col("o_orderpriority")).alias("modality")).groupBy("raw", "modality").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS k, '{\"a\": ' || o_orderkey || '}' AS found, '[' || o_orderkey || ', 2]' AS listed FROM orders")
def json_salvage(spark, d):
    k = F.col("o_orderkey").cast("string")
    noisy = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit('Here: {"a": '), k, F.lit("} done")).alias("x"), F.concat(F.lit("ok ["), k, F.lit(", 2] end")).alias("y"))
    return noisy.select("k", T.salvage_object(F.col("x")).alias("found"), T.salvage_array(F.col("y")).alias("listed"))


# -- balancing and splits

BALANCE_SQL = """, total AS (SELECT count(*) AS total FROM kinds), ranked AS (SELECT chunk_id, classification, row_number() OVER (PARTITION BY classification ORDER BY seq) AS rn,
  CASE classification WHEN 'obligation' THEN 0 WHEN 'non_obligation' THEN 1 ELSE 2 END AS c, CAST(floor(total * CASE classification WHEN 'obligation' THEN CAST(0.5 AS DOUBLE) WHEN 'non_obligation' THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END) AS BIGINT) AS target FROM kinds, total)"""


@query(f"{KINDS_SQL}{BALANCE_SQL} SELECT chunk_id, classification, rn > target AS is_leftover, row_number() OVER (ORDER BY rn > target, c, rn) AS position FROM ranked")
def ratio_balance(spark, d):
    return sample.ratio_balance(_kinds(spark, d), RATIOS).select("chunk_id", "classification", "is_leftover", "position")


@query(f"""{KINDS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY classification ORDER BY seq) AS rn FROM kinds), n AS (SELECT count(*) FILTER (classification = 'obligation') / CAST(0.5 AS DOUBLE) AS total FROM kinds)
  SELECT chunk_id, classification FROM k, n WHERE rn <= CASE classification WHEN 'obligation' THEN rn WHEN 'non_obligation' THEN floor(total * CAST(0.2 AS DOUBLE)) ELSE floor(total * CAST(0.3 AS DOUBLE)) END""")
def anchor_resample(spark, d):
    k = _kinds(spark, d)
    counts = {r["classification"]: r["n"] for r in k.groupBy("classification").agg(F.count("*").alias("n")).collect()}
    return sample.anchored(k, sample.anchor_targets(counts)).select("chunk_id", "classification")


@query(f"{KINDS_SQL}, t AS (SELECT document_type AS stratum, count(*) AS available FROM kinds GROUP BY 1), q AS (SELECT * FROM (VALUES ('Act', 0.5), ('Regulation', 0.3), ('Circular', 0.2)) AS v(stratum, share)), x AS (SELECT q.stratum, CAST(floor(share * 9000 + 0.5) AS BIGINT) AS target, coalesce(available, 0) AS available FROM q LEFT JOIN t ON t.stratum = q.stratum) SELECT *, least(target, available) AS kept, greatest(target - available, 0) AS shortfall FROM x")
def strata_quota_report(spark, d):
    quotas = spark.createDataFrame([("Act", 0.5), ("Regulation", 0.3), ("Circular", 0.2)], "stratum string, share double")
    return sample.quota_report(_kinds(spark, d).withColumnRenamed("document_type", "stratum"), quotas, 9000)


@query(f"{KINDS_SQL} SELECT classification, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM kinds GROUP BY classification")
def class_distribution_pct(spark, d):
    return sample.distribution(_kinds(spark, d))


@query("WITH b AS (SELECT doc_id, CAST('0x' || substr(md5('42:' || doc_id), 1, 8) AS BIGINT) % 100 AS b FROM documents) SELECT doc_id, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split FROM b")
def random_split_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", sample.split_name(F.col("doc_id")).alias("split"))


@query("WITH m AS (SELECT CAST(max(o_orderdate) AS DATE) AS last FROM orders), s AS (SELECT CASE WHEN CAST(o_orderdate AS DATE) > last - INTERVAL 6 MONTH THEN 'test' WHEN CAST(o_orderdate AS DATE) > last - INTERVAL 12 MONTH THEN 'validation' ELSE 'train' END AS split FROM orders, m) SELECT split, count(*) AS n FROM s GROUP BY split")
def chronological_split_counts(spark, d):
    return sample.chronological(table(spark, d, "orders"), "o_orderdate").groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT c AS copy, t AS template, t || '-' || c AS record_id FROM (SELECT unnest(range(100)) AS c), (VALUES ('obligation'), ('neutral')) AS v(t)")
def synthetic_pool(spark, d):
    return sample.synthetic_pool(spark.createDataFrame([("obligation",), ("neutral",)], "template string")).select("copy", "template", "record_id")


@query("SELECT item_id, text FROM benchmark ORDER BY md5('42:' || item_id), item_id LIMIT 50")
def benchmark_sample(spark, d):
    return table(spark, d, "benchmark").orderBy(F.md5(F.concat(F.lit("42:"), F.col("item_id").cast("string")).cast("binary")), "item_id").limit(50)


# -- filters, names, ids, manifest

META_SQL = """meta AS (SELECT p_partkey AS id, p_brand AS regulator, CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 2 = 0 THEN 's3://bucket' || p_size || '/in/' || replace(p_name, ' ', '_') || '#' || p_partkey || '.PDF' ELSE 'loose/' || p_partkey || '\\x y' END AS file_path,
  p_name AS title, CASE WHEN p_size % 3 = 0 THEN 'Act of ' || p_type ELSE p_type END AS document_type, CASE WHEN p_size % 7 = 0 THEN 'act' END AS document_subtype FROM part)"""


def _meta(spark, d):
    p = table(spark, d, "part")
    k, n = F.col("p_partkey").cast("string"), F.col("p_size")
    path = F.when(n % 5 == 0, "").when(n % 2 == 0, F.concat(F.lit("s3://bucket"), n.cast("string"), F.lit("/in/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("#"), k, F.lit(".PDF"))).otherwise(F.concat(F.lit("loose/"), k, F.lit("\\x y")))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("regulator"), path.alias("file_path"), F.col("p_name").alias("title"), F.when(n % 3 == 0, F.concat(F.lit("Act of "), "p_type")).otherwise(F.col("p_type")).alias("document_type"), F.when(n % 7 == 0, "act").alias("document_subtype"), F.lit("2020-01-01").alias("release_date"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("pdf_url"))


@query(f"WITH {META_SQL} SELECT id FROM meta WHERE upper(document_type) LIKE 'ACT%' OR upper(document_subtype) LIKE 'ACT%'")
def act_only_filter(spark, d):
    return _meta(spark, d).where(T.is_act(F.col("document_type"), F.col("document_subtype"))).select("id")


@query(f"WITH {META_SQL} SELECT id, regexp_extract(file_path, '^s3://([^/]+)/(.+)$', 1) AS bucket, CASE WHEN file_path LIKE 's3://%' THEN regexp_extract(file_path, '^s3://([^/]+)/(.+)$', 2) ELSE file_path END AS key FROM meta WHERE file_path <> ''")
def uri_parse(spark, d):
    b, k = T.bucket_and_key(F.col("file_path"))
    return _meta(spark, d).where(~T.blank(F.col("file_path"))).select("id", F.coalesce(b, F.lit("")).alias("bucket"), k.alias("key"))


@query(f"""WITH {META_SQL}, n AS (SELECT id, list_extract(string_split(replace(file_path, '\\', '/'), '/'), -1) AS n FROM meta WHERE file_path <> '')
  SELECT id, trim(regexp_replace(CASE WHEN lower(n) LIKE '%.pdf' THEN n ELSE n || '.pdf' END, '[^A-Za-z0-9._ -]', '_', 'g'), '._ ') AS name FROM n""")
def safe_filename(spark, d):
    return _meta(spark, d).where(~T.blank(F.col("file_path"))).select("id", T.safe_filename(F.col("file_path")).alias("name"))


@query(f"WITH {META_SQL} SELECT CAST(id AS VARCHAR) AS row_id, upper(trim(regulator)) AS regulator FROM meta WHERE file_path <> '' AND (upper(document_type) LIKE 'ACT%' OR upper(document_subtype) LIKE 'ACT%')")
def metadata_scan(spark, d):
    return metadata(_meta(spark, d)).select("row_id", "regulator")


@query("SELECT c_custkey AS id, CASE WHEN upper(c_mktsegment) = 'BUILDING' THEN 'MACHINERY' ELSE upper(c_mktsegment) END AS code FROM customer WHERE upper(c_mktsegment) IN ('BUILDING', 'MACHINERY', 'FURNITURE')")
def regulator_normalise(spark, d):
    code = T.normalise_regulator(F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" ")), ["machinery", "furniture"], {"building": "machinery"})
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), code.alias("code")).where("code IS NOT NULL")


@query("SELECT p_partkey AS id, CASE WHEN s = '' THEN 'unnamed' ELSE s END AS slug FROM (SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM part)")
def slug_ids(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.slug(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


@query(f"WITH {META_SQL} SELECT id, substr(sha256(CASE WHEN file_path = '' THEN '/local/' || id ELSE file_path END), 1, 24) AS document_id, regexp_replace('d_' || id || '_7', '_[^_]*$', '') AS of_chunk FROM meta")
def document_ids(spark, d):
    i = F.col("id").cast("string")
    return _meta(spark, d).select("id", T.document_id(F.col("file_path"), F.concat(F.lit("/local/"), i)).alias("document_id"), T.document_of(F.concat(F.lit("d_"), i, F.lit("_7"))).alias("of_chunk"))


@query(f"WITH {META_SQL}, r AS (SELECT id, upper(regulator) AS regulator, file_path LIKE 's3://%' AS ok FROM meta WHERE file_path <> '') SELECT count(*) FILTER (ok) AS count, count(*) FILTER (NOT ok) AS failed_count, string_agg(DISTINCT regulator, ',' ORDER BY regulator) FILTER (ok) AS regulators FROM r")
def manifest_summary(spark, d):
    rows = metadata(_meta(spark, d), act_only=False)
    done, failed = rows.where("s3_bucket IS NOT NULL"), rows.where("s3_bucket IS NULL").withColumn("error", F.lit("no bucket"))
    return sinks.manifest(done, failed, "/out").select(F.col("count").cast("long").alias("count"), F.col("failed_count").cast("long").alias("failed_count"), F.array_join("regulators", ",").alias("regulators"))


@query(f"""WITH {META_SQL}, n AS (SELECT id, upper(trim(regulator)) AS regulator, CASE WHEN file_path LIKE 's3://%' THEN regexp_extract(file_path, '^s3://([^/]+)/(.+)$', 2) ELSE file_path END AS key, list_extract(string_split(replace(file_path, '\\', '/'), '/'), -1) AS n FROM meta WHERE file_path <> ''),
f AS (SELECT *, regulator || '/' || trim(regexp_replace(CASE WHEN lower(n) LIKE '%.pdf' THEN n ELSE n || '.pdf' END, '[^A-Za-z0-9._ -]', '_', 'g'), '._ ') AS place FROM n),
h AS (SELECT DISTINCT place FROM f WHERE id % 3 = 0) SELECT key AS s3_key, f.regulator, h.place AS local_place, CASE WHEN h.place IS NULL THEN 'not found' END AS error FROM f LEFT JOIN h ON h.place = f.place""")
def file_fetch(spark, d):
    """Records joined to the files that are there, which are those of every third record; and the failed ones."""
    rows = metadata(_meta(spark, d), act_only=False)
    files = rows.where(F.col("row_id").cast("long") % 3 == 0).select(F.concat(F.lit("/data/"), "regulator", F.lit("/"), T.safe_filename(F.col("s3_key"))).alias("path"))
    done, failed = fetched(rows, files)
    return done.select("s3_key", "regulator", F.replace("local_path", F.lit("/data/"), F.lit("")).alias("local_place")).unionByName(failed, allowMissingColumns=True)


@query("SELECT s_suppkey AS id, 'Rules of ' || replace(s_name, '#', ' ') || '.v2' AS title, 'TEST_REGULATOR' AS regulator, true AS ingested FROM supplier")
def folder_manifest(spark, d):
    s = table(spark, d, "supplier")
    files = s.select(F.concat(F.lit("/in/"), "s_suppkey", F.lit("/Rules_of_"), F.replace("s_name", F.lit("#"), F.lit("_")), F.lit(".v2.pdf")).alias("path"))
    return local_manifest(files).select(F.element_at(F.split("local_path", "/"), 3).cast("long").alias("id"), "title", "regulator", "ingested")


@query(r"""WITH p AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))[2:] AS own FROM documents)
SELECT doc_id, len(own) AS n_pages, array_to_string(own, chr(12)) AS full_text FROM p WHERE regexp_matches(array_to_string(own, chr(12)), '\S')""")
def page_extraction(spark, d):
    """Lines as pages, the first of them skipped."""
    texts = table(spark, d, "documents").select("doc_id", F.translate("text", "\n", "\f").alias("text"))
    return extracted(texts, skip=1).select("doc_id", F.size("pages").cast("long").alias("n_pages"), "full_text")


# -- segmentation, chunks, graph

@query(f"""WITH {ACTS_SQL} SELECT DISTINCT document_id, 0 AS ord, 'chapter' AS level, '1' AS label, CAST(NULL AS VARCHAR) AS section_number, 0 AS start_offset, 'CHAPTER 1 - General' AS text FROM act_sections
  UNION ALL SELECT document_id, n, 'section', CAST(n AS VARCHAR), CAST(n AS VARCHAR), 21 + coalesce(sum(length('Section ' || n || '. ' || text) + 1) OVER (PARTITION BY document_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 'Section ' || n || '. ' || text FROM act_sections""")
def act_segments(spark, d):
    return segment.segments(acts(spark, d)).select("document_id", "ord", "level", "label", "section_number", "start_offset", "text")


@query(f"WITH {ACTS_SQL}, x AS (SELECT *, lower('Section ' || n || '. ' || text) AS t FROM act_sections) SELECT document_id || '_' || (n - 1) AS chunk_id, n - 1 AS chunk_index, of AS total_chunks, 'Section ' || n || '. ' || text AS text, CAST(n AS VARCHAR) AS section_number, '1' AS chapter, 'Rules of ' || document_id AS act_name, regulator, {ROLE_SQL} AS semantic_role FROM x")
def act_chunks(spark, d):
    return chunk.chunks(acts(spark, d)).select("chunk_id", "chunk_index", "total_chunks", "text", "section_number", "chapter", "act_name", "regulator", "semantic_role")


@query(f"WITH {ACTS_SQL} SELECT document_id, n AS section, 'Chapter 1 > ' || string_agg('Section ' || m, ' > ' ORDER BY m) AS parent_path FROM (SELECT a.document_id, a.n, b.n AS m FROM act_sections a JOIN act_sections b ON b.document_id = a.document_id AND b.n <= a.n) GROUP BY document_id, n")
def hierarchy_paths(spark, d):
    return segment.with_paths(segment.segments(acts(spark, d))).where("level = 'section'").select("document_id", F.col("label").cast("long").alias("section"), "parent_path")


@query(f"WITH {ACTS_SQL} SELECT document_id, CAST(1 AS BIGINT) AS chapters, count(*) AS sections, CAST(0 AS BIGINT) AS clauses, min(substr('Section 1. ' || text, 1, 1000)) FILTER (n = 1) AS first_text FROM act_sections GROUP BY document_id")
def act_hierarchy(spark, d):
    h = segment.hierarchy(segment.segments(acts(spark, d)))
    return h.select("document_id", *[F.size(c).cast("long").alias(c) for c in ("chapters", "sections", "clauses")], F.element_at("sections", 1)["text"].alias("first_text"))


#: An act with every level; `#` stands for the customer's key.  Its spans are stated by hand: level, label, title, place, whether the place is
#: after the key, and the clause that it is in.
LEVELS_TEXT = 'PART I - Scope\n\nCHAPTER 2 - General\n\nSection 7. Firms shall file return #.\n(b) "filer" means a firm;\n(a) the form must be signed;\nExplanation 1. Return means a form.\nProviso. No return is due in June.\nSCHEDULE II - Forms'
LEVELS = (
    ("part", "I", "Scope", 0, 0, None, None), ("chapter", "2", "General", 16, 0, None, None),
    ("section", "7", 'Firms shall file return #.\n(b) "filer" means a firm;\n(a) the form must be signed;', 37, 0, "7", None),
    ("clause", "b", '"filer" means a firm;', 74, 1, "7", "b"), ("definition", "b", "filer", 74, 1, "7", "b"), ("subsection", "b", '"filer" means a firm;', 74, 1, "7", "b"),
    ("clause", "a", "the form must be signed;", 100, 1, "7", "a"), ("subsection", "a", "the form must be signed;", 100, 1, "7", "a"),
    ("explanation", "1", "Return means a form.", 129, 1, "7", "a"), ("proviso", "Proviso", "No return is due in June.\nSCHEDULE II - Forms", 165, 1, "7", "a"),
    ("schedule", "II", "Forms", 200, 1, "7", "a"),
)
_LITERAL = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
LEVELS_SQL = f"levels AS (SELECT 'L' || c_custkey AS document_id, CAST(c_custkey AS VARCHAR) AS k, v.* FROM customer, (VALUES {', '.join('(' + ', '.join(map(_LITERAL, (i, *x))) + ')' for i, x in enumerate(LEVELS))}) AS v(ord, level, label, title, place, moved, section_number, clause_number))"


def _levels(spark, d):
    key = F.col("c_custkey").cast("string")
    return table(spark, d, "customer").select(F.concat(F.lit("L"), key).alias("document_id"), F.col("c_mktsegment").alias("regulator"), F.lit("Act").alias("act_name"), F.lit("").alias("effective_date"), F.lit(None).cast("string").alias("local_path"), F.replace(F.lit(LEVELS_TEXT), F.lit("#"), key).alias("full_text"))


@query(f"WITH {LEVELS_SQL} SELECT document_id, ord, level, label, replace(title, '#', k) AS title, place + moved * length(k) AS start_offset, section_number, clause_number FROM levels")
def act_levels(spark, d):
    return segment.segments(_levels(spark, d)).select("document_id", "ord", "level", "label", "title", "start_offset", "section_number", "clause_number")


@query("""SELECT 'L' || c_custkey AS document_id, 'L' || c_custkey || a AS source, 'L' || c_custkey || b AS target, t AS type FROM customer, (VALUES
  ('', '/part/i', 'DOCUMENT_HAS_PART'), ('/part/i', '/chapter/2', 'PART_HAS_CHAPTER'), ('/chapter/2', '/section/7', 'CHAPTER_HAS_SECTION'),
  ('/section/7', '/clause/7/b', 'SECTION_HAS_CLAUSE'), ('/section/7', '/definition/7/b', 'SECTION_CONTAINS_DEFINITION'), ('/section/7', '/clause/7/b', 'SECTION_HAS_SUBSECTION'),
  ('/section/7', '/clause/7/a', 'SECTION_HAS_CLAUSE'), ('/section/7', '/clause/7/a', 'SECTION_HAS_SUBSECTION'), ('/section/7', '/explanation/7/1', 'SECTION_HAS_EXPLANATION'),
  ('/section/7', '/proviso/7/proviso', 'SECTION_HAS_PROVISO'), ('', '/schedule/ii', 'ACT_HAS_SCHEDULE')) AS v(a, b, t)""")
def act_level_edges(spark, d):
    a = _levels(spark, d)
    return graph.edges(a, segment.segments(a)).where("type NOT IN ('CONTAINS', 'ACT_ISSUED_BY_REGULATOR')")


def _slugged(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_')"


HEAD_SQL = f"WITH {ACTS_SQL}, heads AS (SELECT document_id, min(regulator) AS regulator, strftime(min(published), '%Y-%m-%d') AS date, '/acts/' || document_id || '.pdf' AS path FROM act_sections GROUP BY document_id)"


@query(f"""{HEAD_SQL} SELECT document_id, 'reg/' || {_slugged('regulator')} AS id, 'Regulator' AS type, regulator AS label FROM heads UNION ALL SELECT document_id, document_id, 'Act', 'Rules of ' || document_id FROM heads
  UNION ALL SELECT document_id, document_id || '/effective_date/' || {_slugged('date')}, 'EffectiveDate', date FROM heads UNION ALL SELECT document_id, document_id || '/source_document/' || {_slugged('path')}, 'SourceDocument', path FROM heads
  UNION ALL SELECT document_id, document_id || '/chapter/1', 'Chapter', '1' FROM heads UNION ALL SELECT document_id, document_id || '/section/' || n, 'Section', CAST(n AS VARCHAR) FROM act_sections""")
def act_nodes(spark, d):
    a = acts(spark, d)
    return graph.nodes(a, segment.segments(a)).select("document_id", "id", "type", "label")


@query(f"""{HEAD_SQL}, e AS (SELECT document_id, document_id AS source, 'reg/' || {_slugged('regulator')} AS target, ['ACT_ISSUED_BY_REGULATOR'] AS types FROM heads UNION ALL SELECT document_id, 'reg/' || {_slugged('regulator')}, document_id, ['CONTAINS'] FROM heads
  UNION ALL SELECT document_id, document_id, document_id || '/effective_date/' || {_slugged('date')}, ['ACT_HAS_EFFECTIVE_DATE'] FROM heads UNION ALL SELECT document_id, document_id, document_id || '/source_document/' || {_slugged('path')}, ['ACT_SOURCE_DOCUMENT'] FROM heads
  UNION ALL SELECT document_id, document_id, document_id || '/chapter/1', ['ACT_HAS_CHAPTER', 'CONTAINS'] FROM heads UNION ALL SELECT document_id, document_id || '/chapter/1', document_id || '/section/' || n, ['CHAPTER_HAS_SECTION', 'CONTAINS'] FROM act_sections)
  SELECT document_id, source, target, unnest(types) AS type FROM e""")
def act_edges(spark, d):
    a = acts(spark, d)
    return graph.edges(a, segment.segments(a))


@query(f"""{KINDS_SQL}, n AS (SELECT DISTINCT 'Document' AS type, document_id AS id FROM kinds UNION ALL SELECT 'Chunk', chunk_id FROM kinds UNION ALL SELECT CASE WHEN classification = 'obligation' THEN 'Obligation' ELSE 'NonObligation' END, CASE WHEN classification = 'obligation' THEN 'OBL-' ELSE 'NON-' END || chunk_id FROM kinds) SELECT type, count(*) AS n FROM n GROUP BY type
  UNION ALL SELECT 'CONTAINS', count(*) FROM kinds UNION ALL SELECT 'YIELDS', count(*) FROM kinds""")
def record_graph(spark, d):
    node, edge = graph.record_graph(_records(spark, d))
    return node.groupBy("type").agg(F.count("*").alias("n")).unionByName(edge.groupBy("type").agg(F.count("*").alias("n")))


@query("""WITH RECURSIVE e AS (SELECT page_id AS doc, 'n' || page_id AS root FROM pages), n AS (SELECT doc, root AS id, CAST(NULL AS VARCHAR) AS parent FROM e UNION ALL SELECT doc, root || '/a', root FROM e UNION ALL SELECT doc, root || '/a/' || k, root || '/a' FROM e, (VALUES (1), (2)) AS v(k)),
  w AS (SELECT doc, id, parent AS ancestor, 1 AS distance FROM n WHERE parent IS NOT NULL UNION ALL SELECT w.doc, w.id, n.parent, distance + 1 FROM w JOIN n ON n.doc = w.doc AND n.id = w.ancestor WHERE n.parent IS NOT NULL) SELECT CAST(doc AS VARCHAR) AS document_id, id AS id_path, ancestor, distance FROM w""")
def recursive_ancestors(spark, d):
    return bridge.ancestors(_structure(spark, d).select("document_id", F.explode("nodes").alias("n")).select("document_id", "n.*"))


@query("""WITH RECURSIVE n AS (SELECT c_custkey // 40 AS doc, c_custkey % 40 AS k FROM customer), w AS (SELECT doc, k, k - 1 AS up, 1 AS distance FROM n WHERE k > 0
  UNION ALL SELECT w.doc, w.k, w.up - 1, w.distance + 1 FROM w WHERE w.up > 0) SELECT CAST(w.doc AS VARCHAR) AS document_id, CAST(w.k AS VARCHAR) AS id_path, CAST(w.up AS VARCHAR) AS ancestor, distance FROM w JOIN n p ON p.doc = w.doc AND p.k = w.up
  WHERE NOT EXISTS (SELECT 1 FROM generate_series(w.up, w.k) AS g(x) LEFT JOIN n q ON q.doc = w.doc AND q.k = g.x WHERE q.k IS NULL)""")
def deep_ancestors(spark, d):
    """Chains of 40 nodes."""
    c = table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 40).cast("long").cast("string").alias("document_id"), (F.col("c_custkey") % 40).alias("k"))
    nodes = c.select("document_id", F.col("k").cast("string").alias("id_path"), F.when(F.col("k") > 0, (F.col("k") - 1).cast("string")).alias("parent_id_path"))
    return bridge.ancestors(nodes)


def _structure(spark, d):
    """A small parse result for each page: a document, a part and two points; some break the contract."""
    p = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("document_id"))
    root = F.concat(F.lit("n"), "document_id")
    node = lambda path, kind, parent, **k: F.struct(path.alias("id_path"), F.lit(kind).alias("node_type"), F.lit(k.get("label")).cast("string").alias("label"), F.lit(None).cast("string").alias("title"), (F.array(*[F.lit(x) for x in k["numbering"]]) if "numbering" in k else F.lit(None).cast("array<string>")).alias("numbering"), F.lit("t").alias("text"), parent.alias("parent_id_path"), F.lit(1).alias("page_start"))
    a = F.concat(root, F.lit("/a"))
    rel = F.struct(root.alias("source"), a.alias("target"), F.when(F.col("document_id").cast("long") % 5 == 0, "CITES").otherwise("CONTAINS").alias("type"))
    nodes = [node(root, "DOCUMENT", F.lit(None).cast("string")), node(a, "PART", root, label="I"), node(F.concat(a, F.lit("/1")), "POINT", a, numbering=["1", "b"]), node(F.concat(a, F.lit("/2")), "ARTICLE", a)]
    return p.select("document_id", F.array(*nodes).alias("nodes"), F.array(rel).alias("relationships"))


@query("SELECT CAST(page_id AS VARCHAR) AS document_id, CASE WHEN page_id % 5 = 0 THEN 'relation other than CONTAINS' ELSE '' END AS errors FROM pages")
def structure_contract(spark, d):
    return bridge.contract_errors(_structure(spark, d)).select("document_id", F.array_join("errors", ",").alias("errors"))


@query("SELECT CAST(page_id AS VARCHAR) AS document_id, unnest(['part', 'clause', 'section']) AS level, unnest(['I', '(1)(b)', '2']) AS label, 'other' AS semantic_role, 0 AS start_offset, 0 AS end_offset FROM pages")
def structure_segments(spark, d):
    return bridge.segments(_structure(spark, d).select("document_id", F.explode("nodes").alias("n")).select("document_id", "n.*")).select("document_id", "level", "label", "semantic_role", "start_offset", "end_offset")


@query("WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), p AS (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM d), s AS (SELECT doc_id, i, coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(l) AS n FROM p), t AS (SELECT doc_id, length(text) // 2 AS o FROM documents) SELECT t.doc_id, o AS char_offset, max(i) + 1 AS page FROM t JOIN s ON s.doc_id = t.doc_id AND s.a <= o GROUP BY t.doc_id, o")
def page_lookup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda p, i: F.struct((i + 1).alias("page_number"), p.alias("text"))).alias("pages"), F.floor(F.length("text") / 2).cast("int").alias("char_offset"))
    return docs.select("doc_id", "char_offset", T.page_at(F.col("pages"), F.col("char_offset")).alias("page"))


@query("SELECT doc_id, i AS chunk_index, substr(text, i * 5850 + 1, 6000) AS text FROM (SELECT doc_id, text, unnest(range((length(text) - 1) // 5850 + 1)) AS i FROM documents WHERE length(text) > 0)")
def sliding_chunks(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("full_text"))
    return chunk.windows(docs).select(F.col("document_id").alias("doc_id"), "chunk_index", "text")


# -- curation

@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedup_by_hash(spark, d):
    return dedup.exact(table(spark, d, "documents"))


@query("WITH c AS (SELECT DISTINCT sha256(text) AS h FROM documents JOIN labels USING (doc_id)) SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents WHERE sha256(text) NOT IN (SELECT h FROM c) GROUP BY 1")
def label_cache_misses(spark, d):
    docs = table(spark, d, "documents")
    cache = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id").select(dedup.content_hash(F.col("text")).alias("content_hash")).distinct()
    return dedup.cache_misses(docs, cache)


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality <> toxic AND CAST('0x' || substr(md5('42:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.25")
def label_disagreements(spark, d):
    return dedup.disagreements(table(spark, d, "labels"), "quality", "toxic", "doc_id", 0.25)


NEAR_SQL = r"""WITH d AS (SELECT source, lang, text, min(doc_id) AS id FROM documents GROUP BY ALL), w AS (SELECT source, lang, id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT DISTINCT source, lang, id, unnest(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id), c AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM g x JOIN g y ON x.source = y.source AND x.lang = y.lang AND x.g = y.g AND x.id < y.id GROUP BY 1, 2)
SELECT a, b, round(k / (p.n + q.n - k), 6) AS jaccard FROM c JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE k / (p.n + q.n - k) >= 0.8"""


@query(NEAR_SQL)
def near_dup_pairs(spark, d):
    return dedup.near_pairs(table(spark, d, "documents"), ("source", "lang"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY source, lang, text) AS class_id FROM documents")
def near_dup_members(spark, d):
    return dedup.near_members(table(spark, d, "documents"), ("source", "lang"))


FURNITURE_SQL = "WITH l AS (SELECT DISTINCT source, doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), f AS (SELECT source, line, count(*) AS n FROM l WHERE line <> '' GROUP BY 1, 2 HAVING count(*) >= 3 OR regexp_matches(line, '^(page )?[0-9]{1,4}$'))"


@query(f"{FURNITURE_SQL} SELECT * FROM f")
def furniture_lines(spark, d):
    return dedup.furniture(table(spark, d, "documents"))


@query(f"{FURNITURE_SQL}, x AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, sum(CASE WHEN f.line IS NULL THEN 0 ELSE length(x.line) END) AS removed_chars FROM x LEFT JOIN f ON f.source = x.source AND f.line = trim(x.line) GROUP BY doc_id")
def furniture_removal(spark, d):
    docs = table(spark, d, "documents")
    return dedup.without_furniture(docs, dedup.furniture(docs)).select("doc_id", "removed_chars")


@query("SELECT CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'open' ELSE 'held' END AS tier, count(*) AS n FROM documents GROUP BY 1")
def licence_tier_counts(spark, d):
    tiers = spark.createDataFrame([(f"src{i}", "open") for i in range(4)], "source string, tier string")
    return dedup.tiers(table(spark, d, "documents"), tiers).groupBy("tier").agg(F.count("*").alias("n"))


@query("SELECT doc_id, concat_ws(chr(10), 'Regulator: ' || source, 'Publication type: ' || lang, 'Title: document ' || doc_id, substr(text, 1, 1500)) AS prompt FROM documents")
def prefix_truncate_prompt(spark, d):
    c = lambda a, b: F.concat(F.lit(a), F.col(b).cast("string"))
    return table(spark, d, "documents").select("doc_id", F.concat_ws("\n", c("Regulator: ", "source"), c("Publication type: ", "lang"), c("Title: document ", "doc_id"), F.substring("text", 1, 1500)).alias("prompt"))


@query("SELECT conv_id, count(*) AS n_turns, string_agg('<' || role || '> ' || text, chr(10) ORDER BY turn, role, text) AS chat FROM conversations GROUP BY conv_id")
def chat_assembly(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return turns.select("conv_id", F.size("m").cast("long").alias("n_turns"), F.array_join(F.transform("m", lambda x: F.concat(F.lit("<"), x["role"], F.lit("> "), x["text"])), "\n").alias("chat"))


# -- scores and drift

def _spans(spark, d):
    """Gold and predicted spans for each line item."""
    q = F.col("l_quantity").cast("int")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", (F.col("l_partkey") % 100).cast("int").alias("s"), q.alias("n"))
    return li.select("l_orderkey", "l_partkey", "l_linenumber", "s", (F.col("s") + F.col("n")).alias("e"), (F.col("s") + F.col("l_linenumber") * 3).cast("int").alias("ps"), (F.col("s") + F.col("n") + F.col("l_linenumber")).cast("int").alias("pe"))


SPANS_SQL = "x AS (SELECT l_orderkey, l_partkey, l_linenumber, l_partkey % 100 AS s, l_partkey % 100 + CAST(l_quantity AS INT) AS e, l_partkey % 100 + l_linenumber * 3 AS ps, l_partkey % 100 + CAST(l_quantity AS INT) + l_linenumber AS pe FROM lineitem)"


@query(f"WITH {SPANS_SQL}, y AS (SELECT *, greatest(0, least(e, pe) - greatest(s, ps)) AS k FROM x) SELECT l_orderkey, l_partkey, l_linenumber, round(CASE WHEN k > 0 THEN k / ((e - s) + (pe - ps) - k) ELSE 0.0 END, 6) AS iou FROM y")
def span_iou(spark, d):
    return _spans(spark, d).select("l_orderkey", "l_partkey", "l_linenumber", F.round(metrics.span_iou(F.col("s"), F.col("e"), F.col("ps"), F.col("pe")), 6).alias("iou"))


#: Each prediction in turn takes the first of its golds that is free; its golds are those that reach the threshold, best first.
MATCH_SQL = f"""WITH RECURSIVE {SPANS_SQL}, g AS (SELECT l_orderkey, s, e, gm, row_number() OVER (PARTITION BY l_orderkey ORDER BY s, e, gm) AS gi FROM (SELECT *, l_linenumber % 5 AS gm FROM x)),
p AS (SELECT l_orderkey, ps, pe, pm, row_number() OVER (PARTITION BY l_orderkey ORDER BY ps, pe, pm) AS pi FROM (SELECT *, (l_linenumber + CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END) % 5 AS pm FROM x)),
v AS (SELECT l_orderkey, pi, gi, greatest(0, least(e, pe) - greatest(s, ps)) AS k, e - s + pe - ps AS len2 FROM p JOIN g USING (l_orderkey)),
t AS (SELECT l_orderkey, pi, list(gi ORDER BY k / (len2 - k) DESC, gi) FILTER (k > 0 AND 2 * k >= len2 - k) AS cand FROM v GROUP BY ALL),
m AS (SELECT DISTINCT l_orderkey, CAST(0 AS BIGINT) AS pi, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS hit FROM x
  UNION ALL SELECT l_orderkey, pi, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END, hit FROM (SELECT t.l_orderkey, t.pi, m.used, list_filter(t.cand, lambda c: NOT list_contains(m.used, c))[1] AS hit FROM m JOIN t ON t.l_orderkey = m.l_orderkey AND t.pi = m.pi + 1))"""


@query(f"""{MATCH_SQL}, n AS (SELECT (SELECT count(hit) FROM m) AS tp, (SELECT count(*) FROM x) AS n) SELECT tp, n - tp AS fp, n - tp AS fn, round(tp / n, 6) AS precision, round(tp / n, 6) AS recall, round(CASE WHEN tp > 0 THEN tp / n ELSE 0.0 END, 6) AS f1 FROM n""")
def span_f1_greedy(spark, d):
    own = _spans(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("g"), F.array_sort(F.collect_list(F.struct(F.col("ps").alias("s"), F.col("pe").alias("e")))).alias("p"))
    m = own.select(F.size(metrics.greedy_matches(F.col("g"), F.col("p"))).alias("n_matched"), F.size("g").alias("n_gold"), F.size("p").alias("n_pred"))
    return metrics.span_f1(m).select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


#: Modalities by number in the test data.
MODALITIES = ("MUST", "SHOULD", "MAY", "MUST_NOT", "SHOULD_NOT")
_NAMED_SQL = lambda c: f"list_extract([{', '.join(repr(x) for x in MODALITIES)}], {c} + 1)"


@query(f"""{MATCH_SQL}, q AS (SELECT {_NAMED_SQL("gm")} AS gold, {_NAMED_SQL("pm")} AS pred FROM m JOIN g ON g.l_orderkey = m.l_orderkey AND g.gi = m.hit JOIN p ON p.l_orderkey = m.l_orderkey AND p.pi = m.pi),
l AS (SELECT unnest([{", ".join(repr(x) for x in MODALITIES)}]) AS label), c AS (SELECT label, count(*) FILTER (gold = label) AS support, count(*) FILTER (pred = label) AS predicted, count(*) FILTER (gold = label AND pred = label) AS correct FROM l, q GROUP BY label)
SELECT label, support, predicted, correct, round(CASE WHEN predicted > 0 THEN correct / predicted ELSE 0.0 END, 6) AS precision, round(CASE WHEN support > 0 THEN correct / support ELSE 0.0 END, 6) AS recall, round(CASE WHEN correct > 0 THEN 2.0 * correct / (predicted + support) ELSE 0.0 END, 6) AS f1 FROM c""")
def modality_report(spark, d):
    """Modalities of matched spans only: a report of five classes."""
    named = lambda n: F.element_at(F.array(*[F.lit(x) for x in MODALITIES]), (n + 1).cast("int"))
    gm = F.col("l_linenumber") % 5
    pm = (F.col("l_linenumber") + F.when(F.col("l_partkey") % 7 == 0, 1).otherwise(0)) % 5
    own = _spans(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("s", "e", gm.alias("m")))).alias("g"), F.array_sort(F.collect_list(F.struct(F.col("ps").alias("s"), F.col("pe").alias("e"), pm.alias("m")))).alias("p"))
    pairs = own.select("g", "p", F.explode(metrics.greedy_matches(F.col("g"), F.col("p"))).alias("x"))
    of = lambda c: named(F.element_at(c[0], F.col(f"x.{c[1]}") + 1)["m"])
    r = metrics.class_report(pairs.select(of(("g", "gold")).alias("gold"), of(("p", "pred")).alias("pred")), MODALITIES)
    return r.select("label", "support", "predicted", "correct", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _predictions(spark, d):
    """Gold classes of clauses and predictions that err on some orders."""
    k = _kinds(spark, d)
    wrong = F.when(F.col("seq") % 4 == 0, F.when(F.col("classification") == "neutral", "obligation").otherwise("neutral")).otherwise(F.col("classification"))
    return k.select("chunk_id", "seq", F.col("classification").alias("gold"), wrong.alias("pred"), "document_type", "regulator", "o_totalprice", "published")


PRED_SQL = f"{KINDS_SQL}, preds AS (SELECT chunk_id, seq, regulator, document_type, classification AS gold, CASE WHEN seq % 4 = 0 THEN CASE WHEN classification = 'neutral' THEN 'obligation' ELSE 'neutral' END ELSE classification END AS pred FROM kinds)"


@query(f"{PRED_SQL} SELECT gold, pred, count(*) AS n FROM preds GROUP BY 1, 2")
def modality_confusion(spark, d):
    return metrics.confusion(_predictions(spark, d))


REPORT_SQL = ", l AS (SELECT gold AS label, 1 AS s, 0 AS p, CAST(gold = pred AS INT) AS c FROM preds UNION ALL SELECT pred, 0, 1, 0 FROM preds), r AS (SELECT label, sum(s) AS support, sum(p) AS predicted, sum(c) AS correct FROM l GROUP BY label), q AS (SELECT *, CASE WHEN predicted > 0 THEN correct / predicted ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN correct / support ELSE 0.0 END AS recall FROM r), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM q)"


@query(f"{PRED_SQL}{REPORT_SQL} SELECT label, support, predicted, correct, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def class_report(spark, d):
    r = metrics.class_report(_predictions(spark, d))
    return r.select("label", "support", "predicted", "correct", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""{PRED_SQL}{REPORT_SQL}, j AS (SELECT avg(CASE WHEN seq % 3 = 0 THEN 1.0 / 3 ELSE 1.0 END) AS jac, count(*) AS n, avg(CAST(gold = pred AS DOUBLE)) AS acc, avg(CAST(seq % 5 <> 0 AS DOUBLE)) AS pri, avg(CAST((gold = 'obligation') = (pred = 'obligation') AS DOUBLE)) AS flg, avg(CAST(seq % 11 <> 0 AS DOUBLE)) AS val FROM preds)
  SELECT n, round(acc, 6) AS class_accuracy, round(pri, 6) AS priority_accuracy, round(flg, 6) AS flag_accuracy, round(jac, 6) AS functions_jaccard, round(val, 6) AS json_validity, round((SELECT max(support) / sum(support) FROM f), 6) AS majority_baseline, round((SELECT avg(f1) FROM f WHERE support > 0), 6) AS macro_f1 FROM j""")
def triage_scores(spark, d):
    p = _predictions(spark, d)
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    t = p.select(F.col("gold").alias("gold_class"), F.col("pred").alias("pred_class"), F.lit("P1").alias("gold_priority"), F.when(F.col("seq") % 5 == 0, "P2").otherwise("P1").alias("pred_priority"), (F.col("gold") == "obligation").alias("gold_flag"), (F.col("pred") == "obligation").alias("pred_flag"), a("legal", "risk").alias("gold_functions"), F.when(F.col("seq") % 3 == 0, a("risk", "audit")).otherwise(a("risk", "legal")).alias("pred_functions"), (F.col("seq") % 11 != 0).alias("valid"))
    s = metrics.triage_scores(t)
    return s.select("n", *[F.round(c, 6).alias(c) for c in s.columns if c != "n"])


@query(f"{PRED_SQL} SELECT count(*) AS n, sum(CAST(gold = pred AS INT)) AS agreed, round(avg(CAST(gold = pred AS DOUBLE)), 6) AS share FROM preds")
def model_agreement(spark, d):
    return metrics.agreement(_predictions(spark, d), "gold", "pred").select("n", "agreed", F.round("share", 6).alias("share"))


@query(f"{PRED_SQL} SELECT round(avg(CAST(upper(gold) = substr(upper(pred), 1, 20) AS DOUBLE)), 6) AS label_accuracy, round(avg(CAST(lower(trim(gold)) = lower(trim(pred)) AS DOUBLE)), 6) AS exact_match FROM preds")
def label_accuracy(spark, d):
    return _predictions(spark, d).agg(F.round(F.avg(metrics.label_match(F.col("pred"), F.col("gold")).cast("double")), 6).alias("label_accuracy"), F.round(F.avg(metrics.exact_match(F.concat(F.lit(" "), F.upper("pred")), F.col("gold")).cast("double")), 6).alias("exact_match"))


@query(r"""WITH RECURSIVE b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS g, list_filter(string_split_regex(lower(regexp_replace(text, '(\S+)\s+(\S+)', '\2 \1', 'g')), '[^a-z0-9]+'), lambda x: x <> '') AS p FROM benchmark),
gw AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(g) AS w FROM b) GROUP BY ALL), pw AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(p) AS w FROM b) GROUP BY ALL),
o AS (SELECT item_id, sum(least(gw.n, pw.n)) AS k FROM gw JOIN pw USING (item_id, w) GROUP BY item_id),
r AS (SELECT item_id, CAST(0 AS BIGINT) AS i, list_transform(range(len(g) + 1), lambda j: CAST(0 AS BIGINT)) AS best FROM b
  UNION ALL SELECT item_id, i + 1, list_transform(range(1, len(g) + 2), lambda j: list_max(list_slice(list_transform(range(1, len(g) + 2), lambda y: CASE WHEN y > 1 AND g[y - 1] = p[i + 1] THEN best[y - 1] + 1 ELSE best[y] END), 1, j))) FROM r JOIN b USING (item_id) WHERE i < len(p))
SELECT item_id, round(coalesce(2.0 * k / (len(p) + len(g)), 0.0), 6) AS rouge1, round(coalesce(2.0 * best[len(g) + 1] / nullif(len(p) + len(g), 0), 0.0), 6) AS rouge_l FROM b LEFT JOIN o USING (item_id) JOIN r USING (item_id) WHERE i = len(p)""")
def rouge_scores(spark, d):
    """Items against themselves with each two neighbouring words exchanged."""
    items = table(spark, d, "benchmark").select("item_id", "text")
    swapped = F.regexp_replace("text", r"(\S+)\s+(\S+)", "$2 $1")
    return items.select("item_id", F.round(metrics.rouge1(swapped, F.col("text")), 6).alias("rouge1"), F.round(metrics.rouge_l(swapped, F.col("text")), 6).alias("rouge_l"))


HALVES_SQL = f"{KINDS_SQL}, a AS (SELECT * FROM kinds WHERE o_orderstatus = 'F'), b AS (SELECT * FROM kinds WHERE o_orderstatus <> 'F'), p AS (SELECT classification AS label, count(*) / sum(count(*)) OVER () AS p FROM a GROUP BY 1), q AS (SELECT classification AS label, count(*) / sum(count(*)) OVER () AS q FROM b GROUP BY 1), d AS (SELECT sum(abs(coalesce(p, 0) - coalesce(q, 0))) AS l1 FROM p FULL JOIN q ON q.label = p.label)"


@query(f"{HALVES_SQL} SELECT round(l1, 6) AS l1, l1 > 0.3 AS alert FROM d")
def modality_l1(spark, d):
    k = _kinds(spark, d)
    return metrics.l1(k.where("o_orderstatus = 'F'"), k.where("o_orderstatus <> 'F'"), "classification").select(F.round("l1", 6).alias("l1"), "alert")


@query(f"{HALVES_SQL}, s AS (SELECT avg(length(text)) AS ma, stddev_pop(length(text)) AS sa, avg(CAST(classification = 'obligation' AS DOUBLE)) AS ca FROM a), t AS (SELECT avg(length(text)) AS mb, stddev_pop(length(text)) AS sb, avg(CAST(classification = 'obligation' AS DOUBLE)) AS cb FROM b) SELECT round(ma, 6) AS mean_a, round(sa, 6) AS std_a, round(mb, 6) AS mean_b, round(sb, 6) AS std_b, round(l1, 6) AS l1, l1 > 0.3 AS alert, round(abs(mb - ma) / (ma + 0.00000001), 6) AS mean_change, round(ca, 6) AS count_a, round(cb, 6) AS count_b, round(abs(cb - ca) / (ca + 0.00000001), 6) AS count_change FROM s, t, d")
def drift_stats(spark, d):
    k = _kinds(spark, d).withColumn("length", F.length("text")).withColumn("obligations", (F.col("classification") == "obligation").cast("double"))
    r = metrics.drift(k.where("o_orderstatus = 'F'"), k.where("o_orderstatus <> 'F'"), "length", "classification", "obligations")
    return r.select(*[F.round(c, 6).alias(c) if c != "alert" else F.col(c) for c in r.columns])


# -- sinks and reports

@query(f"{DAMAGED_SQL}, ok AS (SELECT kind FROM damaged JOIN errors USING (chunk_id) WHERE error IS NULL) SELECT count(*) AS total_records, count(*) FILTER (kind = 'obligation') AS obligation, count(*) FILTER (kind = 'non_obligation') AS non_obligation, count(*) FILTER (kind = 'neutral') AS neutral, (SELECT count(*) FROM errors WHERE error IS NOT NULL) AS rejects, (SELECT count(*) FROM ok WHERE kind <> 'maybe') AS balanced_records, (SELECT count(*) FROM clauses) AS total_chunks, 'v1' AS version FROM ok")
def run_report(spark, d):
    good, bad = validate.split_valid(_damaged(spark, d))
    return sinks.run_report(good, bad, sample.ratio_balance(good, RATIOS), clauses(spark, d), "v1")


@query("SELECT l_partkey AS id, max(l_orderkey) AS seq, count(*) FILTER (false) AS zero FROM lineitem GROUP BY 1")
def upsert_last_wins(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("seq"))
    return sinks.upserted(None, rows, ["id"], "seq").withColumn("zero", F.lit(0).cast("long"))


@query("""WITH r AS (SELECT l_partkey AS id, l_orderkey AS seq, l_linenumber - 1 AS fresh FROM lineitem WHERE l_linenumber <= 2)
  SELECT id, max(seq) AS seq, CASE WHEN max(struct_pack(s := seq, f := fresh)).f = 1 THEN 'new' ELSE 'old' END AS version FROM r GROUP BY id""")
def upsert_into_stored(spark, d):
    """New rows over a stored table: a key's last row by order stays, and a new row before a stored one."""
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("seq"), "l_linenumber")
    stored = li.where("l_linenumber = 1").groupBy("id").agg(F.max("seq").alias("seq")).withColumn("version", F.lit("old"))
    return sinks.upserted(stored, li.where("l_linenumber = 2").select("id", "seq", F.lit("new").alias("version")), ["id"], "seq")


@query("WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS s FROM q, embeddings WHERE vec_id <> query_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, rank, round(s, 6) AS similarity FROM r WHERE rank <= 10")
def embedding_topk(spark, d):
    """Nearest ten vectors of a stated query set (ids divisible by 50) by cosine, against all rows."""
    v = table(spark, d, "embeddings")
    return search.nearest(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    from ..streaming.ingest import windowed_counts

    return windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))
