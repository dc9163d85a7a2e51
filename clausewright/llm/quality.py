"""Operator 1: quality rules as a short-circuit cascade.

Each rule rejects a document by features of its text.  `estimate` runs every rule alone on a sample and returns its
cost (CPU seconds a document) and rejection rate; `plan` orders the rules by rejection per cost; `cascade` runs them in that order and
stops at the first that rejects.  Features are made on demand and shared, so a document rejected by a cheap
rule never pays for a dear one.  The verdict is the conjunction of the rules: the order changes cost only.

Nulls count as empty texts; a text without words fails the rule on length and no other; repeated rows get equal verdicts; rules that tie in
rejection per cost stay in the order given, as all do for an empty table, which gives no rows; very long texts are read whole, a few at a
time; columns of other names are ignored (`filter_documents` carries them along).  Features that a caller asks for as columns, and the base rules behind
`base_failed`, are made for every row, so there the order saves the other rules only.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_filter, arrow_map, fraction_column, pick, text_bytes

SYMBOLS = b"#*$%&|<>"
_SPACES = re.compile(rb"[\x20\x09-\x0D]")
#: Rows on which costs and rejection rates are estimated, about.  The verdicts don't depend on it.
SAMPLE_ROWS = 2000


class Features(dict):
    """Features of one text (UTF-8 bytes), made when asked for."""

    def __init__(self, raw: bytes):
        super().__init__(raw=raw)

    def __missing__(self, name: str):
        self[name] = value = _FEATURES[name](self)
        return value


def _repeated(f: Features) -> int:
    words = f["words"]
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n + 2)
    if len(ids) >= 1 << 21:  # three ids no longer fit 63 bits: number the pairs first
        _, pair = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)
        tri = pair[:-1].astype(np.int64) * len(ids) + code[2:]
    else:
        tri = (code[:-2] * len(ids) + code[1:-1]) * len(ids) + code[2:]
    order = np.argsort(tri, kind="stable")
    same = tri[order[1:]] == tri[order[:-1]]
    if not same.any():
        return 0
    starts = np.zeros(n + 2, dtype=bool)
    starts[order[1:][same]] = True
    starts[order[:-1][same]] = True
    covered = starts.copy()
    covered[1:] |= starts[:-1]
    covered[2:] |= starts[:-2]
    return int(covered.sum())


def _dup_lines(f: Features) -> int:
    lines = [x for x in f["raw"].split(b"\n") if x and x.strip()]  # bytes.strip drops exactly the spaces of a word's definition
    return len(lines) - len(set(lines))


_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_FEATURES: dict[str, Callable[[Features], object]] = {
    "words": lambda f: f["raw"].split(),
    "n_words": lambda f: len(f["words"]),
    "n_chars": lambda f: len(f["raw"].decode("utf-8", "replace")),
    "word_chars": lambda f: f["n_chars"] - len(f["raw"]) + len(f["raw"].translate(None, b" \t\n\x0b\x0c\r")),
    "n_symbols": lambda f: len(f["raw"]) - len(f["raw"].translate(None, SYMBOLS)),
    "n_dup_lines": _dup_lines,
    "n_lines": lambda f: sum(1 for x in f["raw"].split(b"\n") if x.strip()),
    "n_repeat_words": _repeated,
    "n_upper": lambda f: len(f["raw"]) - len(f["raw"].translate(None, _UPPER)),
    "n_lower": lambda f: len(f["raw"]) - len(f["raw"].translate(None, _LOWER)),
    "n_bang": lambda f: f["raw"].count(b"!"),
    "n_digits": lambda f: len(f["raw"]) - len(f["raw"].translate(None, b"0123456789")),
    "n_controls": lambda f: len(f["raw"]) - len(f["raw"].translate(None, bytes([*range(9), *range(14, 32), 127]))),
}


@dataclass(frozen=True)
class Rule:
    """`rejects` takes Features and tells whether the document goes.  base: a rule fixed by contract, named in base_failed."""

    name: str
    rejects: Callable[[Features], bool]
    base: bool = False


#: The production rules.  Shares are of words, characters or lines; every rule but the first passes a text without words.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda f: f["n_words"] < 50, base=True),
    Rule("repeated_trigrams", lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"], base=True),
    Rule("symbols", lambda f: 10 * f["n_symbols"] > f["n_words"] > 0),
    Rule("exclamations", lambda f: 2 * f["n_bang"] > f["n_words"] > 0),
    Rule("upper_case", lambda f: f["n_upper"] > f["n_lower"] and f["n_upper"] > 20),
    Rule("digits", lambda f: 10 * f["n_digits"] > 3 * f["word_chars"] > 0),
    Rule("control_characters", lambda f: 100 * f["n_controls"] > len(f["raw"])),
    Rule("word_length", lambda f: f["n_words"] > 0 and not 2 * f["n_words"] <= f["word_chars"] <= 12 * f["n_words"]),
    Rule("duplicate_lines", lambda f: f["n_lines"] >= 5 and 2 * f["n_dup_lines"] > f["n_lines"]),
)


def estimate(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, key: str = "doc_id") -> list[dict]:
    """Cost and rejection rate of each rule, from about `sample_rows` rows chosen by a hash of key and text.  A row for each rule
    and batch is summed in Spark; only one row for each rule reaches the driver."""
    rows = pick(df, key=key, text=text)
    share = min(1.0, sample_rows / max(1, rows.count()))
    sample = rows.where(fraction_column(F.col("key"), F.col("text"), F.lit(17)) < share).select("text")

    def measure(batch: pa.RecordBatch) -> dict:
        texts, cost, out = [t or b"" for t in text_bytes(batch)], [0.0] * len(rules), [0] * len(rules)
        for t in texts:
            for k, rule in enumerate(rules):
                began = time.perf_counter()
                out[k] += bool(rule.rejects(Features(t)))
                cost[k] += time.perf_counter() - began
        return {"rule": list(range(len(rules))), "cost": cost, "rejected": out, "n": [len(texts)] * len(rules)}

    found = arrow_map(sample, measure, "rule int, cost double, rejected long, n long").groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected"), F.sum("n").alias("n")).collect()
    by = {r["rule"]: r for r in found}
    return [{"rule": rule.name, "cost": by[k]["cost"] / by[k]["n"] if k in by else 0.0, "rejection": by[k]["rejected"] / by[k]["n"] if k in by else 0.0} for k, rule in enumerate(rules)]


def plan(estimates: Sequence[dict], rules: Sequence[Rule] = RULES) -> list[Rule]:
    """Most rejection per cost first; ties stay in the order given."""
    rank = sorted(range(len(rules)), key=lambda k: (-estimates[k]["rejection"] / max(estimates[k]["cost"], 1e-9), k))
    return [rules[k] for k in rank]


def cascade(df: DataFrame, ordered: Sequence[Rule], columns: Sequence[str] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, kept, rejected_by (the first rule in this order, else null), rules_run, and the features named in `columns` (each is
    made for every row)."""
    rules, wanted = list(ordered), list(columns)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {"key": batch.column(0), "kept": [], "rejected_by": [], "rules_run": [], "base_failed": []} | {c: [] for c in wanted}
        for t in text_bytes(batch):
            f, by, ran = Features(t or b""), None, 0
            for ran, rule in enumerate(rules, 1):  # noqa: B007
                if rule.rejects(f):
                    by = rule
                    break
            out["kept"].append(by is None)
            out["rejected_by"].append(by and by.name)
            out["rules_run"].append(ran)
            out["base_failed"].append(by is not None and (by.base or bool(wanted) and any(r.base and r.rejects(f) for r in rules)))
            for c in wanted:
                out[c].append(f[c])
        return out

    rows = pick(df, key=key, text=text)
    kind = rows.schema["key"].dataType.simpleString()
    made = arrow_map(rows, run, f"key {kind}, kept boolean, rejected_by string, rules_run int, base_failed boolean" + "".join(f", {c} long" for c in wanted))
    return made.withColumnRenamed("key", key)


def filter_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that every rule passes, with all their columns.  Here the cascade pays: a rejected row makes no further features."""
    ordered = plan(estimate(docs, rules, text, key=key), rules)

    def keep(batch: pa.RecordBatch) -> list[bool]:
        seen = (Features(t or b"") for t in text_bytes(batch, text))
        return [not any(rule.rejects(f) for rule in ordered) for f in seen]

    return arrow_filter(docs, keep, text)
