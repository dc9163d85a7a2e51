"""Scores of predictions, and drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def span_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over union of half-open intervals, 0 where they don't meet."""
    both = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    union = (e1 - s1) + (e2 - s2) - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(F.lit(0.0))


def greedy_matches(golds: Column, preds: Column, threshold: float = 0.5) -> Column:
    """array<struct<gold, pred>> (0-based): each prediction in turn takes the free gold of highest IoU, the first of equals, if it reaches the
    threshold.  golds and preds: array<struct<s, e>>.  A fold over the record's own arrays, inside the JVM."""
    kind = "struct<used:array<int>,out:array<struct<gold:int,pred:int>>>"

    def take(acc: Column, p: Column) -> Column:
        def one(g: Column, i: Column) -> Column:
            return F.struct(F.when(F.array_contains(acc["used"], i), F.lit(-1.0)).otherwise(span_iou(g["s"], g["e"], F.element_at(preds, p + 1)["s"], F.element_at(preds, p + 1)["e"])).alias("iou"), (-i).alias("i"))

        best = F.array_max(F.transform(golds, one))
        hit = F.coalesce(best["iou"] >= threshold, F.lit(False))
        return F.when(hit, F.struct(F.array_append(acc["used"], -best["i"]).alias("used"), F.array_append(acc["out"], F.struct((-best["i"]).alias("gold"), p.alias("pred"))).alias("out")).cast(kind)).otherwise(acc)

    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<gold:int,pred:int>>").alias("out")).cast(kind)
    turns = F.filter(F.sequence(F.lit(0), F.greatest(F.size(preds) - 1, F.lit(0))), lambda i: i < F.size(preds))
    return F.aggregate(turns, start, take, lambda a: a["out"])


def span_f1(matched: DataFrame) -> DataFrame:
    """Micro precision, recall and F1.  matched: n_matched, n_gold, n_pred."""
    s = matched.agg(F.sum("n_matched").alias("tp"), F.sum("n_gold").alias("gold"), F.sum("n_pred").alias("pred"))
    p, r = F.coalesce(F.try_divide("tp", "pred"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "gold"), F.lit(0.0))
    return s.select("tp", (F.col("pred") - F.col("tp")).alias("fp"), (F.col("gold") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def confusion(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return df.groupBy(gold, pred).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, classes: Sequence[str] | None = None, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Per class: support, predicted, correct, precision, recall, f1; zero where undefined."""
    cells = confusion(df, gold, pred)
    flat = cells.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col(gold) == F.col(pred), F.col("n")).otherwise(0).alias("correct")), F.struct(F.col(pred).alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("correct")))).alias("x")).select("x.*")
    sums = flat.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "correct")])
    if classes is not None:
        sums = sums.where(F.col("label").isin(*classes))
    p, r = F.coalesce(F.try_divide("correct", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("correct", "support"), F.lit(0.0))
    return sums.withColumns({"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))})


def macro_f1(report: DataFrame) -> DataFrame:
    """Mean F1 over the classes present in the gold labels."""
    return report.where("support > 0").agg(F.avg("f1").alias("macro_f1"))


def set_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def triage_scores(df: DataFrame) -> DataFrame:
    """One row: accuracies, macro-F1, mean set overlap, JSON validity, majority baseline.  df: gold_*/pred_* of class, priority, flag, functions, and valid."""
    same = lambda c: F.avg((F.col(f"gold_{c}") == F.col(f"pred_{c}")).cast("double"))
    one = df.agg(F.count("*").alias("n"), same("class").alias("class_accuracy"), same("priority").alias("priority_accuracy"), same("flag").alias("flag_accuracy"), F.avg(set_jaccard(F.col("gold_functions"), F.col("pred_functions"))).alias("functions_jaccard"), F.avg(F.col("valid").cast("double")).alias("json_validity"))
    base = df.groupBy("gold_class").agg(F.count("*").alias("k")).agg((F.max("k") / F.sum("k")).alias("majority_baseline"))
    f1 = macro_f1(class_report(df, None, "gold_class", "pred_class"))
    return one.crossJoin(base).crossJoin(f1)  # one row each


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.sum((F.col(a) == F.col(b)).cast("long")).alias("agreed"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("share"))


def exact_match(pred: Column, gold: Column) -> Column:
    norm = lambda c: F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")
    return norm(pred) == norm(gold)


def label_match(pred: Column, gold: Column) -> Column:
    return F.substring(F.upper(F.btrim(pred)), 1, 20) == F.upper(F.btrim(gold))


def _tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def _f(both: Column, a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0) | (both == 0), 0.0).otherwise(2.0 * both / (a + b))


def rouge1(pred: Column, gold: Column) -> Column:
    """F1 of the words' multiset overlap."""
    p, g = _tokens(pred), _tokens(gold)
    tf = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    both = F.aggregate(F.array_intersect(p, g), F.lit(0), lambda n, w: n + F.least(tf(p, w), tf(g, w)))
    return _f(both, F.size(p), F.size(g))


def rouge_l(pred: Column, gold: Column) -> Column:
    """F1 of the longest common subsequence of words; one row of the dynamic programme is held at a time."""
    p, g = _tokens(pred), _tokens(gold)

    def row(before: Column, w: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            up, diagonal = F.element_at(before, j + 1), F.element_at(before, j)
            return F.array_append(acc, F.when(F.element_at(g, j) == w, diagonal + 1).otherwise(F.greatest(up, F.element_at(acc, -1))))

        return F.aggregate(F.sequence(F.lit(1), F.size(g)), F.array(F.lit(0)), cell)

    lcs = F.aggregate(p, F.array_repeat(F.lit(0), F.size(g) + 1), row, lambda r: F.element_at(r, -1))
    return F.when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(_f(lcs, F.size(p), F.size(g)))


def shares(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    return n.select(F.col(label).alias("label"), (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def l1(a: DataFrame, b: DataFrame, label: str, alert: float = 0.3) -> DataFrame:
    """Distance of two label distributions over the union of labels, and whether it is an alert."""
    x, y = shares(a, label).withColumnRenamed("share", "p"), shares(b, label).withColumnRenamed("share", "q")
    d = x.join(y, "label", "full_outer").agg(F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))).alias("l1"))
    return d.withColumn("alert", F.col("l1") > alert)


def drift(a: DataFrame, b: DataFrame, value: str, label: str, count: str | None = None) -> DataFrame:
    """Relative change of the mean, both means and population deviations, and the label distance; with `count`, a column of obligations a
    record, also the relative change of its mean.  One row."""
    stat = lambda df, k: df.agg(F.avg(value).alias(f"mean_{k}"), F.stddev_pop(value).alias(f"std_{k}"), *([F.avg(count).alias(f"count_{k}")] if count else []))
    change = lambda m: F.abs(F.col(f"{m}_b") - F.col(f"{m}_a")) / (F.col(f"{m}_a") + 1e-8)
    one = stat(a, "a").crossJoin(stat(b, "b")).crossJoin(l1(a, b, label))  # one row each
    return one.withColumns({"mean_change": change("mean")} | ({"count_change": change("count")} if count else {}))
