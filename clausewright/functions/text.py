"""Column functions: identity, names, cues and roles.  All are built-in expressions inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cue expressions of the deontic rules, in order of precedence.
MANDATORY = r"\b(shall|must|is required to|are required to)\b"
PERMISSIVE = r"\b(may|can|should)\b"
# Normalised modality of each cue.
MODALITY = {"shall": "MUST", "must": "MUST", "is required to": "REQUIRED", "are required to": "REQUIRED", "should": "SHOULD", "may": "MAY", "can": "MAY"}


def strip(c: Column) -> Column:
    """White space off both ends, any Unicode kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def or_else(c: Column, *others: Column | str) -> Column:
    """The first that is neither null nor empty; strings are literals."""
    return F.coalesce(*[F.nullif(F.lit(x) if isinstance(x, str) else x, F.lit("")) for x in (c, *others)])


def slug(c: Column) -> Column:
    return or_else(F.btrim(F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "_"), F.lit("_")), "unnamed")


def structural_id(root: Column, *parts: Column) -> Column:
    return F.concat_ws("/", root, *[slug(p) for p in parts])


def regulator_id(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("reg/"), slug(c))).otherwise("reg/unknown")


def document_id(s3_key: Column, local_path: Column) -> Column:
    return F.substring(F.sha2(or_else(s3_key, local_path), 256), 1, 24)


def short_document_id(name: Column) -> Column:
    return F.substring(F.sha1(name.cast("binary")), 1, 12)


def document_of(chunk_id: Column) -> Column:
    """What stands before the last underscore, or all of it without one."""
    return F.regexp_replace(chunk_id, "_[^_]*$", "")


def bucket_and_key(path: Column) -> tuple[Column, Column]:
    """s3://bucket/key, else no bucket and the path as key."""
    path, form = F.trim(path), r"^s3://([^/]+)/(.+)$"
    is_uri = path.rlike(form)
    return F.when(is_uri, F.regexp_extract(path, form, 1)), F.when(is_uri, F.regexp_extract(path, form, 2)).otherwise(path)


def safe_filename(key: Column) -> Column:
    """Last path component as a .pdf name of letters, digits and `._- `."""
    last = or_else(F.element_at(F.split(F.replace(key, F.lit("\\"), F.lit("/")), "/"), -1), "document")
    named = F.when(F.lower(last).endswith(".pdf"), last).otherwise(F.concat(last, F.lit(".pdf")))
    return or_else(F.btrim(F.regexp_replace(named, r"[^\p{L}\p{N}._\- ]", "_"), F.lit("._ ")), "document.pdf")


def target_path(base: str, regulator: Column, key: Column) -> Column:
    return F.concat_ws("/", F.lit(base.rstrip("/")), regulator, safe_filename(key))


def normalise_regulator(c: Column, allowed: list[str] | None = None, aliases: dict[str, str] | None = None) -> Column:
    """Trimmed upper case; with a whitelist aliases are resolved and others become null."""
    code = F.nullif(F.upper(strip(c)), F.lit(""))
    if allowed is None:
        return code
    for a, b in (aliases or {}).items():
        code = F.when(F.upper(strip(c)) == a.strip().upper(), F.lit(b.strip().upper())).otherwise(code)
    return F.when(code.isin([x.strip().upper() for x in allowed]), code)


def is_act(kind: Column, subtype: Column) -> Column:
    return F.coalesce(F.upper(kind).like("ACT%"), F.lit(False)) | F.coalesce(F.upper(subtype).like("ACT%"), F.lit(False))


def deontic_class(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike(MANDATORY), "obligation").when(low.rlike(PERMISSIVE), "non_obligation").otherwise("neutral")


def detected_modality(text: Column) -> tuple[Column, Column]:
    """The first cue in a text, and its normal form."""
    cue = F.nullif(F.regexp_extract(F.lower(text), r"\b(" + "|".join(sorted(MODALITY, key=len, reverse=True)) + r")\b", 1), F.lit(""))
    return cue, F.element_at(F.create_map(*[F.lit(x) for kv in MODALITY.items() for x in kv]), cue)


def semantic_role(level: Column, text: Column) -> Column:
    """A segment's role by its level, else by words in its first 500 characters, in a fixed order of tests."""
    low = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 500))
    has = lambda *w: _any([low.contains(x) for x in w])
    return (
        F.when(level.isin("definition", "explanation", "proviso", "schedule"), level)
        .when(has("shall be punishable", "punishment", "penalty", "imprisonment"), "penalty")
        .when(has("shall ") & has("not ", "no "), "prohibition")
        .when(has("shall ", "must "), "obligation")
        .when(has("means ", "definition"), "definition")
        .when(has("provided that", "proviso"), "proviso")
        .when(has("procedure", "apply", "application"), "procedure")
        .when(has("power", "authority", "may "), "authority")
        .when(has("exception", "except"), "exception")
        .otherwise("other")
    )


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def salvage_object(text: Column) -> Column:
    """From the first { to the last }."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def salvage_array(text: Column) -> Column:
    """From the first [ to the last ], if it is JSON."""
    found = F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit(""))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def page_at(pages: Column, offset: Column) -> Column:
    """The page that holds a character offset of pages joined by one character.  pages: array<struct<page_number, text>>.  Beyond the end
    the last page; negative offsets and no pages give null."""
    steps = F.aggregate(pages, F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("page")), lambda a, p: F.struct((a["at"] + F.length(p["text"]) + 1).cast("int").alias("at"), F.when(a["page"].isNull() & (offset < a["at"] + F.length(p["text"]) + 1), p["page_number"].cast("int")).otherwise(a["page"]).alias("page")), lambda a: a["page"])
    return F.when((offset >= 0) & (F.size(pages) > 0), F.coalesce(steps, F.element_at(pages, -1)["page_number"].cast("int")))
