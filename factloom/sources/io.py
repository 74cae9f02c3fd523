"""Readers and writers: JSON lines, JSON documents, packed pages, resumable appends, digests, leakage-safe outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "text", "lines")])
_EVIDENCE = T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))
CLAIM = T.StructType([T.StructField("id", T.LongType()), T.StructField("claim", T.StringType()), T.StructField("label", T.StringType()), T.StructField("evidence", _EVIDENCE)])
PROMPT = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("gold", "prompt", "completion")]])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object a line; blank lines are skipped, a bad one fails the read. The schema is never inferred."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Null fields are written, so that a row's keys don't depend on its values."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_pages(spark: SparkSession, pattern: str) -> DataFrame:
    """Pages of all shards whose id and text are neither null nor empty."""
    return spark.read.schema(PAGE).json(pattern).where("id <> '' AND text <> ''")


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims with evidence as sets of (ann_id, ev_id, page, line), from their four-element arrays."""
    item = lambda e: F.struct(e[0].cast("long").alias("ann_id"), e[1].cast("long").alias("ev_id"), e[2].alias("page"), e[3].cast("int").alias("line"))
    return read_jsonl(spark, path, CLAIM).withColumn("evidence", F.transform("evidence", lambda s: F.transform(s, item)))


def read_id_list(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(id) of a JSON document's list ``ids``, such as a frozen evaluation set."""
    return spark.read.schema(f"ids array<{id_type}>").option("multiLine", "true").json(path).select(F.explode("ids").alias("id"))


def write_document(df: DataFrame, path: str) -> None:
    """A one-row table as a JSON document, such as a manifest or summary; refuses an existing path."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("errorifexists").text(path)


def create_only(df: DataFrame, path: str) -> None:
    """Writes Parquet and refuses an existing path."""
    df.write.mode("errorifexists").parquet(path)


def _bucket(key: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(key), buckets).cast("int")


def write_pages(pages: DataFrame, path: str, buckets: int = 256, key: str = "id") -> None:
    """The page store: a part for each hash bucket of the key, rows sorted by it, so that a lookup reads the parts it needs and in them the row groups it needs."""
    rows = pages.withColumns({"buckets": F.lit(buckets), "bucket": _bucket(F.col(key), F.lit(buckets))})
    rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", key).write.mode("errorifexists").partitionBy("buckets", "bucket").parquet(path)


def lookup(store: DataFrame, keys: DataFrame, column: str = "id") -> DataFrame:
    """Point lookups as one join on bucket and key; only the parts that some key is in are read. Keys that the store doesn't have give no rows.

    What comes to the driver is the number of buckets and which of them are needed, so the scan is pruned whatever the join does.
    """
    any_ = store.select("buckets").first()
    asked = keys.withColumn("bucket", _bucket(F.col(column), F.lit(any_[0] if any_ else 1)))
    needed = sorted(r[0] for r in asked.select("bucket").distinct().collect())
    return asked.join(store.where(F.col("bucket").isin(needed)).drop("buckets"), ["bucket", column]).drop("bucket")


def undone(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key isn't done yet. Keys are compared as strings, null keys are never done."""
    seen = done.select(F.col(key).cast("string").alias("__done")).distinct()
    return rows.join(seen, F.col(key).cast("string") == F.col("__done"), "left_anti")


def append_new(rows: DataFrame, path: str, key: str = "id") -> None:
    """Appends the rows whose key the output doesn't hold yet; a repeated run adds nothing."""
    spark = rows.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    (undone(rows, spark.read.schema(rows.schema).parquet(path), key) if there else rows).write.mode("append").parquet(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files as they are stored."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def row_digest(df: DataFrame, *columns: str) -> DataFrame:
    """One digest of a table's rows whatever their order: how many there are, and the sum of parts of their hashes."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.conv(F.substring(h, 1, 12), 16, 10).cast("decimal(38,0)")).alias("digest"))


def chat(system: str, user: Column) -> Column:
    """A system and a user message as an array of (role, content)."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", user))
