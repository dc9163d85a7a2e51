"""Operator 4 (native): licence scans by ordered signature rules, in DataFrame functions only.

A text becomes words (`[0-9a-z]` and everything beyond ASCII, A-Z lower-cased) joined by single spaces.  A rule is a regular expression over that
line (they are written out in signatures.py), a keyword without which it can't match, a label, a priority (1 is best) and a score.  A text is scanned when it holds a word that begins with "licen" or
the keyword of a family with rules without such a word, and only the rules of families whose keyword (and "licen" where all their rules have it) it holds are run.  Each match is an interval of words.  A detection is suppressed if its interval lies within that of
another detection of the same or a better priority (of equal intervals the earlier rule stays); what remains gives the labels.

Base phrases are rules too; all of their places are reported whether suppressed or not, and their labels always stay.

Null and empty texts have no words and no labels; of equal intervals (ties) the better priority, then the earlier rule stays; very long texts are scanned
whole, in time that grows with the text and with the matches to the power 1.5; repeated rows give equal results; an empty table gives no rows; other columns are ignored.
Everything is computed in the row itself: no shuffle, no state.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import signatures
from .common import pick

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

DETECTIONS = "array<struct<start:int,neg_stop:int,priority:int,rule:int,label:string,score:double,base:boolean>>"


@dataclass(frozen=True)
class Rule:
    family: str  # the keyword, a whole word
    regex: str  # over words joined by single spaces
    label: str
    priority: int
    score: float
    base: bool = False


#: Phrases with fixed labels, by contract.
BASE = (("gnu", "gnu general public license", "gpl"), ("apache", "apache license", "apache"), ("cc", "cc by", "cc-by"), ("mit", "mit license", "mit"))

def rules() -> tuple[Rule, ...]:
    """The signature rules in order; several hundred."""
    out = [Rule(k, p, label, 3, 0.7, True) for k, p, label in BASE]

    def add(lines: str, priority: int, score: float) -> None:
        for line in filter(None, lines.splitlines()):
            keyword, label, regex = line.split(" | ", 2)
            for name, words in signatures.MACROS.items():
                regex = regex.replace(name, words)
            out.append(Rule(keyword, regex, label, priority, score))

    add(signatures.VERSIONED, 1, 0.95)
    for part, short, long in signatures.CREATIVE:
        for v in signatures.CREATIVE_VERSIONS:
            tail = f"(?: international| unported)? (?:licen[cs]e )?(?:version )?{v}(?: international| unported)?"
            out += [Rule(k, f"{name}{tail}", f"cc-{part}-{v.replace(' ', '.')}", 1, 0.95) for k, name in (("cc", f"cc {short}"), ("creative", f"creative commons {long}"))]
        out += [Rule("cc", f"cc {short}", f"cc-{part}", 3, 0.7), Rule("creative", f"creative commons {long}", f"cc-{part}", 3, 0.7)]
    add(signatures.SENTENCES, 2, 0.8)
    add(signatures.NAMES, 3, 0.7)
    return tuple(out)


def certain(regex: str) -> str:
    """What every match of a rule's expression holds: the expression without choices and without what may be left out."""
    while (less := re.sub(r"\((?:\?:)?([^()]*)\)(\?|\*|\{\d+,\d+\})?", lambda m: " " if m[2] or "|" in m[1] else m[1], regex)) != regex:
        regex = less
    return regex


def _gate(keywords: list[str]) -> str:
    """One expression for a word that begins with "licen" or is one of the keywords.  A class of their first letters stands before the
    choices, so most places of a text cost one look-up."""
    by_first: dict[str, list[str]] = {"l": ["icen"]}
    for k in sorted(keywords):
        by_first.setdefault(k[0], []).append(f"{k[1:]}(?![0-9A-Za-z])")
    both = {c: "".join(sorted({c, c.upper()})) for c in sorted(by_first)}
    choices = "|".join(f"(?<=[{both[c]}])(?i:{'|'.join(by_first[c])})" for c in both)
    return f"[{''.join(both.values())}](?<![0-9A-Za-z].)(?:{choices})"


def _let(value: Column, use) -> Column:
    """`use` of a value that is made once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(line: Column, r: Column) -> Column:
    """Every match of the rule in the line as struct(start, minus stop, priority, rule, label, score, base), by words.  Matches are
    marked in the line, so the words' places tell where they begin and end; time grows with the line, however many matches it has."""

    def places(words: Column) -> Column:
        at = lambda test, mark: F.filter(F.transform(words, lambda w, i: F.when(test(w, F.lit(mark)), i)), lambda i: i.isNotNull())
        one = lambda a, b: F.struct(a.alias("start"), (-b - 1).alias("neg_stop"), *[r[c].alias(c) for c in ("priority", "rule", "label", "score", "base")])
        return F.zip_with(at(F.startswith, "\x01"), at(F.endswith, "\x02"), one)

    marked = F.regexp_replace(line, r["regex"], F.lit("\x01$0\x02"))
    return F.when(F.rlike(line, r["regex"]), _let(F.split(F.btrim(marked), F.lit(" ")), places).cast(DETECTIONS)).otherwise(F.array().cast(DETECTIONS))


def _kept(spans: Column) -> Column:
    """Sorted detections without the suppressed: in this order whatever contains an interval stands before it, so the furthest
    stop seen in each priority decides.  Arrays grow by copying, so detections go block by block, as many in a block as there are blocks."""
    kind = f"struct<s1:int,s2:int,s3:int,out:{DETECTIONS}>"
    none = F.slice(spans, 1, 0)

    def step(acc: Column, d: Column) -> Column:
        stop = -d["neg_stop"]
        best = F.when(d["priority"] == 1, acc["s1"]).when(d["priority"] == 2, F.greatest(acc["s1"], acc["s2"])).otherwise(F.greatest(acc["s1"], acc["s2"], acc["s3"]))
        reach = [F.when(d["priority"] == k, F.greatest(acc[f"s{k}"], stop)).otherwise(acc[f"s{k}"]).alias(f"s{k}") for k in (1, 2, 3)]
        return F.struct(*reach, F.when(best >= stop, acc["out"]).otherwise(F.concat(acc["out"], F.array(d))).alias("out")).cast(kind)

    width = F.ceil(F.sqrt(F.array_size(spans))).cast("int")

    def block(acc: Column, i: Column) -> Column:
        begin = F.struct(*[acc[c].alias(c) for c in ("s1", "s2", "s3")], none.alias("out")).cast(kind)
        done = F.aggregate(F.slice(spans, i * width + 1, width), begin, step)
        return _let(done, lambda r: F.struct(*[r[c].alias(c) for c in ("s1", "s2", "s3")], F.concat(acc["out"], r["out"]).alias("out"))).cast(kind)

    zero = F.struct(F.lit(-1).alias("s1"), F.lit(-1).alias("s2"), F.lit(-1).alias("s3"), none.alias("out")).cast(kind)
    return F.aggregate(F.sequence(F.lit(0), ((F.array_size(spans) - 1) / width).cast("int")), zero, block, lambda a: a["out"])


def detections(df: DataFrame, listed_rules: tuple[Rule, ...] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, found (all detections in order) and kept (those not suppressed): arrays of struct(start,
    neg_stop, priority, rule, label, score, base)."""
    listed_rules = listed_rules or rules()
    families: dict[str, list[dict]] = {}
    licence: dict[str, bool] = {}  # whether all of a family's rules hold "licen"
    for n, r in enumerate(listed_rules):
        families.setdefault(r.family, []).append({"regex": f"(?<= ){r.regex}(?= )", "label": r.label, "priority": r.priority, "rule": n, "score": float(r.score), "base": r.base})
        licence[r.family] = licence.get(r.family, True) and "licen" in certain(r.regex)
    listed = json.dumps([{"keyword": f" {k} ", "also": "licen" if licence[k] else " ", "rules": own} for k, own in families.items()])
    table = F.from_json(F.lit(listed), "array<struct<keyword:string,also:string,rules:array<struct<regex:string,label:string,priority:int,rule:int,score:double,base:boolean>>>>")  # folded to one literal
    base = pick(df, key=key, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    gate = _gate(sorted(k for k in families if not licence[k] or "licen" in k))
    line = F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.translate("text", UPPER, LOWER), SEPARATORS, " ")), F.lit(" "))
    edge = lambda c: F.when(c.rlike(f"^{SEPARATORS}"), 1).otherwise(0)
    n_words = F.array_size(F.split("text", SEPARATORS)) - edge(F.substring("text", 1, 1)) - edge(F.substring("text", -1, 1))
    lined = base.select("key", F.when(F.col("text") == "", 0).otherwise(n_words).cast("long").alias("n_words"), F.when(F.col("text").rlike(gate), line).alias("line"))

    def scan(fam: Column) -> Column:
        return F.flatten(F.transform(fam["rules"], lambda r: _spans(F.col("line"), r)))

    hit = F.filter(table, lambda fam: F.col("line").contains(fam["keyword"]) & F.col("line").contains(fam["also"]))
    found = F.when(F.col("line").isNotNull(), F.array_sort(F.flatten(F.transform(hit, scan))))
    return lined.select("key", "n_words", found.alias("found")).select("key", "n_words", "found", F.when(F.array_size("found") > 0, _kept(F.col("found"))).alias("kept")).withColumnRenamed("key", key)


def scan(df: DataFrame, listed_rules: tuple[Rule, ...] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word (of base phrases), base_labels, labels, score, n_found, n_kept."""
    seen = detections(df, listed_rules, key, text)
    own = F.filter("found", lambda d: d["base"])
    parts = seen.select(key, "n_words", "found", "kept", own.alias("own"))
    names = lambda c: F.transform(c, lambda d: d["label"])
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(F.array_distinct(c)), ","), F.lit(""))
    places = F.transform("own", lambda d: d["start"].cast("long"))
    return parts.select(
        key, "n_words", F.coalesce(F.array_size("own"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), joined(names("own")).alias("base_labels"),
        joined(F.concat(names("own"), names("kept"))).alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["score"])), F.lit(0.0)).alias("score"),
        F.coalesce(F.array_size("found"), F.lit(0)).cast("long").alias("n_found"), F.coalesce(F.array_size("kept"), F.lit(0)).cast("long").alias("n_kept"),
    )
