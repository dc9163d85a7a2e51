"""Balancing, quotas and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import schemas


def ratio_balance(df: DataFrame, ratios: dict[str, float], kind: str = "classification", seq: str = "seq") -> DataFrame:
    """First int(total * ratio) rows of each class, then leftovers in class order up to the total.  Nothing is lost but rows of other classes; what changes
    is the order, given as `position`.  Rows are ranked within classes and positions follow from class counts, so no
    task orders the whole table."""
    names = list(ratios)
    known = df.where(F.col(kind).isin(*names))
    counts = {r[kind]: r["n"] for r in known.groupBy(kind).agg(F.count("*").alias("n")).collect()}  # one number a class
    total = df.count()
    target = {c: int(total * ratios[c]) for c in names}
    taken = {c: min(counts.get(c, 0), target[c]) for c in names}
    start, at = {}, 0
    for c in names:
        start[c] = at
        at += taken[c]
    rest = {}
    for c in names:
        rest[c] = at
        at += counts.get(c, 0) - taken[c]
    look = lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col(kind))
    ranked = _ranked(known, kind, seq)
    left = F.col("_rank") > look(taken)
    position = F.when(left, look(rest) + F.col("_rank") - look(taken)).otherwise(look(start) + F.col("_rank"))
    return ranked.withColumn("position", position.cast("long")).withColumn("is_leftover", left).where(F.col("position") <= total).drop("_rank")


RANGES = 64


def _ranked(df: DataFrame, kind: str, seq: str) -> DataFrame:
    """1-based ranks within classes by `seq` (a number), over ranges: a class may hold any share of the rows, so rows are numbered within
    quantile ranges of seq and shifted by the class's counts in the ranges before.  The ranges are literals, alike wherever they are computed."""
    cuts = df.agg(F.percentile_approx(seq, [i / RANGES for i in range(1, RANGES)]).alias("c")).first()["c"] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    dealt = df.withColumn("_range", F.size(F.filter(bounds, lambda c: c < F.col(seq))))
    own = Window.partitionBy("_range", kind).orderBy(seq)
    sizes = dealt.groupBy("_range", kind).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(kind).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_range", kind, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    placed = dealt.withColumn("_own", F.row_number().over(own)).join(F.broadcast(shift), ["_range", kind])  # RANGES x classes rows
    return placed.withColumn("_rank", F.col("_own") + F.col("_shift")).drop("_range", "_own", "_shift")


def anchor_targets(counts: dict[str, int], anchor: str = "obligation", shares: dict[str, float] | None = None) -> dict[str, int]:
    """All of the anchor class; the others in proportion to its share."""
    shares = shares or {"obligation": 0.5, "non_obligation": 0.2, "neutral": 0.3}
    total = counts.get(anchor, 0) / shares[anchor]
    return {c: counts.get(c, 0) if c == anchor else min(counts.get(c, 0), int(total * s)) for c, s in shares.items()}


def anchored(df: DataFrame, targets: dict[str, int], kind: str = "classification", seq: str = "seq") -> DataFrame:
    """The first rows of each class up to its target."""
    return _ranked(df, kind, seq).where(F.col("_rank") <= F.element_at(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]), F.col(kind))).drop("_rank")


def quota_report(df: DataFrame, quotas: DataFrame, size: int, stratum: str = "stratum") -> DataFrame:
    """Per stratum: target (share of size), available, kept, shortfall.  quotas: stratum, share."""
    have = df.groupBy(stratum).agg(F.count("*").alias("available"))
    target = F.floor(F.col("share") * size + 0.5).cast("long")
    seen = quotas.join(have, stratum, "left").select(stratum, target.alias("target"), F.coalesce("available", F.lit(0)).cast("long").alias("available"))
    return seen.withColumns({"kept": F.least("target", "available"), "shortfall": F.greatest(F.col("target") - F.col("available"), F.lit(0).cast("long"))})


def split_name(key: Column, seed: int = 42, train: int = 80, validation: int = 10) -> Column:
    """train, validation or test by a hash of the key: the same row falls into the same split in any run and any partitioning."""
    bucket = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < train, "train").when(bucket < train + validation, "validation").otherwise("test")


def chronological(df: DataFrame, when: str, test_months: int = 6, validation_months: int = 6) -> DataFrame:
    """test: the last months before the latest date; validation: the slice before; train: the rest.  Cut-offs are strict."""
    last = F.broadcast(df.agg(F.max(when).alias("_last")))  # one row
    day = F.to_date("_last")
    name = F.when(F.to_date(F.col(when)) > F.add_months(day, -test_months), "test").when(F.to_date(F.col(when)) > F.add_months(day, -test_months - validation_months), "validation").otherwise("train")
    return df.crossJoin(last).withColumn("split", name).drop("_last")


def distribution(df: DataFrame, kind: str = "classification") -> DataFrame:
    counts = df.groupBy(kind).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def synthetic_pool(templates: DataFrame, copies: int = 100) -> DataFrame:
    """Each template repeated under numbered ids."""
    return templates.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("record_id", F.concat_ws("-", "template", "copy"))


CLASSES = schemas.CLASSES
