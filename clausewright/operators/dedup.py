"""Curation: cleaning, exact and near duplicates, label cache and adjudication, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def exact(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a content: content_hash, the least key, and how many had it.  Counted before the shuffle."""
    return df.groupBy(content_hash(F.col(text)).alias("content_hash")).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def survivors(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return df.join(exact(df, key, text).select(key), key, "left_semi")


def cache_misses(df: DataFrame, cache: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Contents without a cached label: (content_hash, key), one call each."""
    return exact(df, key, text).join(cache.select("content_hash"), "content_hash", "left_anti").select("content_hash", key)


def disagreements(labels: DataFrame, a: str, b: str, key: str, share: float = 1.0, seed: int = 42) -> DataFrame:
    """Rows on which two labellers differ, a stable share of them, for a judge."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return labels.where((F.col(a) != F.col(b)) & (drawn < share))


def furniture(df: DataFrame, group: str = "source", key: str = "doc_id", text: str = "text", least: int = 3) -> DataFrame:
    """(group, line_hash, line, n): lines that stand in `least` or more documents of a group, and lines of digits alone."""
    lines = df.select(group, key, F.explode(F.split(text, "\n")).alias("line")).select(group, key, T.strip(F.col("line")).alias("line")).where("line <> ''")
    seen = lines.groupBy(group, "line", key).agg(F.lit(1).alias("one")).groupBy(group, "line").agg(F.count("*").alias("n"))
    return seen.where((F.col("n") >= least) | F.col("line").rlike(r"^(page )?[0-9]{1,4}$"))


def without_furniture(df: DataFrame, found: DataFrame, group: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, cleaned text and characters removed.  Lines meet the furniture by an equi-join and come back in order."""
    lines = df.select(key, group, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("bare", T.strip(F.col("line")))
    # blank lines, which every document has, are never furniture and stay out of the join
    marked = lines.where("bare <> ''").join(found.select(F.col(group).alias("_g"), F.col("line").alias("_l"), F.lit(True).alias("gone")), (F.col(group) == F.col("_g")) & (F.col("bare") == F.col("_l")), "left").drop("_g", "_l")
    marked = marked.unionByName(lines.where("bare = ''").withColumn("gone", F.lit(None).cast("boolean")))
    kept = F.array_sort(F.collect_list(F.when(F.col("gone").isNull(), F.struct("pos", "line"))))
    return marked.groupBy(key).agg(F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("text"), F.sum(F.when(F.col("gone"), F.length("line")).otherwise(0)).alias("removed_chars"))


def near_pairs(df: DataFrame, blocks: tuple[str, ...], key: str = "doc_id", text: str = "text", width: int = 3, similarity: float = 0.8, bands: int = 32, rows: int = 3) -> DataFrame:
    """Near-duplicate pairs (a, b, jaccard) within blocks, of texts that differ: MinHash bands bring texts together and exact Jaccard of
    shingle sets decides.  Equal texts are collapsed first, so a bucket holds different texts of one block only."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # a shingle is hashed word by word, so its words are never joined into a string
    grams = F.when(F.size("_w") < width, F.array(F.xxhash64(F.concat_ws(" ", "_w")))).otherwise(F.transform(F.sequence(F.lit(1), F.size("_w") - width + 1), lambda i: F.xxhash64(*[F.element_at("_w", i + j) for j in range(width)])))
    base = df.groupBy(*blocks, text).agg(F.min(key).alias("id")).withColumn("_w", words).where(F.size("_w") > 0)
    sets = base.withColumn("grams", F.array_distinct(grams)).select(*blocks, "id", "grams")
    least = lambda k: F.array_min(F.transform("grams", lambda g: F.xxhash64(g, F.lit(k))))
    minima = F.array(*[least(k) for k in range(bands * rows)])
    signed = sets.withColumn("minima", minima)
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.element_at("minima", b * rows + r + 1) for r in range(rows)]) for b in range(bands)])
    band = signed.select(*blocks, "id", F.explode(keys).alias("band"))
    met = band.alias("x").join(band.alias("y"), [F.col(f"x.{c}") == F.col(f"y.{c}") for c in blocks] + [F.col("x.band") == F.col("y.band"), F.col("x.id") < F.col("y.id")]).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    both = met.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    return both.withColumn("jaccard", common / (F.size("ga") + F.size("gb") - common)).where(F.col("jaccard") >= similarity).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def near_members(df: DataFrame, blocks: tuple[str, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, and class_id, the least key of its block's rows with the same text.  Those are the ids of `near_pairs`, so
    its pairs and this table say all that is alike.  Classes are counted before the shuffle; a text without words has a class and no pairs."""
    rows = df.select(*blocks, content_hash(F.col(text)).alias("content_hash"), key)
    classes = rows.groupBy(*blocks, "content_hash").agg(F.min(key).alias("class_id"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*blocks, "content_hash")]
    return rows.alias("x").join(classes.alias("y"), same).select(F.col(f"x.{key}").alias(key), F.col("y.class_id").alias("class_id"))


def tiers(df: DataFrame, tier_of: DataFrame, source: str = "source") -> DataFrame:
    """Each row with the tier of its source; sources without one are held back."""
    return df.join(tier_of, source, "left").withColumn("tier", F.coalesce("tier", F.lit("held")))
