"""Sources: stored tables, relational metadata, files, manifests, JSON lines; and corpora derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schemas
from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jdbc_url(kind: str, host: str, port: int, database: str, override: str | None = None) -> str:
    return override or f"jdbc:{'mysql' if kind == 'mysql' else 'postgresql'}://{host}:{port}/{database}"


def metadata_from_jdbc(spark: SparkSession, url: str, source: str, user: str, password: str, act_only: bool = True, document_type: str | None = None, partitions: int = 1, partition_column: str | None = None, bounds: tuple[int, int] | None = None) -> DataFrame:
    """The metadata table's nine columns; filters are pushed to the database by the JDBC source."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=source, user=user, password=password, pushDownPredicate="true")
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return metadata(reader.load().select("id", "regulator", "file_path", "title", "document_type", "document_subtype", "release_date", "url", "pdf_url"), act_only, document_type)


def metadata(rows: DataFrame, act_only: bool = True, document_type: str | None = None, allowed: list[str] | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """Source rows as document records: acts only (or one type), known regulators, and a file path, split into bucket and key."""
    if act_only:
        rows = rows.where(T.is_act(F.col("document_type"), F.col("document_subtype")))
    elif document_type:
        rows = rows.where(F.col("document_type") == document_type)
    regulator = T.normalise_regulator(F.col("regulator"), allowed, aliases)
    bucket, key = T.bucket_and_key(F.col("file_path"))
    date = F.date_format("release_date", "yyyy-MM-dd") if dict(rows.dtypes)["release_date"] != "string" else F.col("release_date")
    return rows.where(~T.blank(F.col("file_path"))).select(regulator.alias("regulator"), key.alias("s3_key"), bucket.alias("s3_bucket"), "title", "document_type", "document_subtype", date.alias("release_date"), F.col("url").alias("source_url"), "pdf_url", F.col("id").cast("string").alias("row_id")).where("regulator IS NOT NULL")


def binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def local_manifest(files: DataFrame) -> DataFrame:
    """Manifest entries for files of a folder, for runs without a database."""
    name = F.element_at(F.split("path", "/"), -1)
    title = F.replace(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("_"), F.lit(" "))
    return files.select(F.lit(True).alias("ingested"), F.col("path").alias("local_path"), title.alias("title"), F.lit("TEST_REGULATOR").alias("regulator"), F.lit("Act").alias("document_type"), F.lit("IN").alias("jurisdiction"))


def fetched(records: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records whose file is there (with local_path), and the failed ones (s3_key, regulator, error).  A file is a record's if it lies at the
    record's target path (its regulator's folder and safe name), or where the key itself says; equal names in different folders don't meet."""
    parts = F.split("path", "/")
    have = files.select(F.concat_ws("/", F.slice(parts, -2, 2)).alias("_place"), F.col("path").alias("local_path")).dropDuplicates(["_place"])
    own = F.split("s3_key", "/")
    as_key = F.when(F.size(own) > 1, F.concat_ws("/", F.slice(own, -2, 2)))
    places = F.array_distinct(F.array_compact(F.array(F.concat_ws("/", F.col("regulator"), T.safe_filename(F.col("s3_key"))), as_key)))
    rows = records.withColumn("_row", F.xxhash64(*[F.col(c).cast("string") for c, kind in records.dtypes if not kind.startswith("map")]))
    met = rows.withColumn("_place", F.explode(places)).join(have, "_place").drop("_place").dropDuplicates(["_row"])
    return met.drop("_row"), rows.join(met.select("_row"), "_row", "left_anti").select("s3_key", "regulator", F.lit("not found").alias("error"))


def manifest(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Ingested entries of a manifest file, in its order of keys when limited."""
    rows = spark.read.schema(schemas.MANIFEST).option("multiLine", "true").json(path).select(F.explode("documents").alias("d")).select("d.*").where("ingested AND local_path IS NOT NULL")
    return rows if limit is None else rows.orderBy("s3_key", "local_path").limit(limit)


def pages_of(text: F.Column, skip: int = 0) -> F.Column:
    """Pages of a text cut at form feeds, stripped, without the first `skip`."""
    every = F.transform(F.split(text, "\f"), lambda p, i: F.struct((i + 1).cast("int").alias("page_number"), T.strip(p).alias("text")))
    return F.filter(every, lambda p: p["page_number"] > skip)


def extracted(texts: DataFrame, skip: int = 0) -> DataFrame:
    """(…, pages, full_text) of rows with `text`; rows whose text is blank are dropped."""
    made = texts.withColumn("pages", pages_of(F.col("text"), skip))
    return made.withColumn("full_text", F.array_join(F.transform("pages", lambda p: p["text"]), "\f")).where(~T.blank(F.col("full_text")))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant_lines(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(json) of the lines that parse, and the others as rejects; blank lines are neither."""
    seen = lines.where(F.trim(column) != "").withColumn("_ok", F.try_parse_json(F.col(column)).isNotNull())
    return seen.where("_ok").select(F.col(column).alias("json")), seen.where("NOT _ok").select(F.col(column).alias("line"))


# -- corpora derived from the driver's tables; the SQL beside each gives the same rows --------------------------------

CLAUSES_SQL = """clauses AS (
  SELECT 'A' || o_custkey AS document_id, 'A' || o_custkey || '_' || o_orderkey AS chunk_id, o_orderkey AS seq, o_custkey, c_mktsegment AS regulator, o_orderdate AS published, o_totalprice,
    CASE o_orderstatus WHEN 'F' THEN 'Act' WHEN 'O' THEN 'Regulation' ELSE 'Circular' END AS document_type, o_orderpriority, o_orderstatus,
    concat('The ', lower(c_mktsegment), ' firm ',
      CASE o_orderpriority WHEN '1-URGENT' THEN 'shall file' WHEN '2-HIGH' THEN 'must not delay' WHEN '3-MEDIUM' THEN 'may defer' WHEN '4-NOT SPECIFIED' THEN 'should review' ELSE 'means any holder of' END,
      ' return ', CAST(o_orderkey AS VARCHAR), CASE o_orderstatus WHEN 'F' THEN ' or face a penalty' WHEN 'O' THEN ', except as notified' ELSE '' END, '.') AS text
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clause an order; the customer is the document, the market segment the regulator."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "o_totalprice")
    both = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    cue = F.when(F.col("o_orderpriority") == "1-URGENT", "shall file").when(F.col("o_orderpriority") == "2-HIGH", "must not delay").when(F.col("o_orderpriority") == "3-MEDIUM", "may defer").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "should review").otherwise("means any holder of")
    tail = F.when(F.col("o_orderstatus") == "F", " or face a penalty").when(F.col("o_orderstatus") == "O", ", except as notified").otherwise("")
    doc = F.concat(F.lit("A"), F.col("o_custkey").cast("string"))
    return both.select(
        doc.alias("document_id"), F.concat(doc, F.lit("_"), F.col("o_orderkey").cast("string")).alias("chunk_id"), F.col("o_orderkey").alias("seq"), "o_custkey", F.col("c_mktsegment").alias("regulator"), F.col("o_orderdate").alias("published"), "o_totalprice",
        F.when(F.col("o_orderstatus") == "F", "Act").when(F.col("o_orderstatus") == "O", "Regulation").otherwise("Circular").alias("document_type"), "o_orderpriority", "o_orderstatus",
        F.concat(F.lit("The "), F.lower("c_mktsegment"), F.lit(" firm "), cue, F.lit(" return "), F.col("o_orderkey").cast("string"), tail, F.lit(".")).alias("text"))


ACTS_SQL = CLAUSES_SQL + """,
act_sections AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seq) AS n, count(*) OVER (PARTITION BY document_id) AS of FROM clauses)"""


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One act a customer: a chapter heading, then a numbered section for each clause, in order."""
    rows = clauses(spark, sf_dir).groupBy("document_id", "regulator").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("own"), F.min("published").alias("first"))
    body = F.array_join(F.transform("own", lambda c, i: F.concat(F.lit("Section "), (i + 1).cast("string"), F.lit(". "), c["text"])), "\n")
    return rows.select("document_id", "regulator", F.concat(F.lit("Rules of "), "document_id").alias("act_name"), F.date_format("first", "yyyy-MM-dd").alias("effective_date"), F.concat(F.lit("/acts/"), "document_id", F.lit(".pdf")).alias("local_path"), F.concat(F.lit("CHAPTER 1 - General\n\n"), body).alias("full_text"))
