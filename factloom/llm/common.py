"""Shared pieces of the training-data operators: staged tables, batches, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_folder, ship

#: Bytes of one Arrow batch sent to a Python worker; a longer single row still travels whole.
BATCH_BYTES = 4 << 20
#: Keys over which the neighbours of one node are dealt.
SALTS = 32
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def python_batches(spark: SparkSession) -> None:
    """Makes ready for Python workers: the package is sent to them, and this session's Arrow batches are bounded by bytes,
    so that long documents don't pile up in a worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


class Workspace:
    """Tables written to the shared folder. A staged table cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        python_batches(spark)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        with finished_shuffles_removed(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.staged_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes staged tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t.staged_path)
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def finished_shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when the write has ended; nothing reads them after that."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256, chars: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Splits batches so that a piece holds at most ``rows`` rows and about ``chars`` bytes, or one longer row."""
    for b in batches:
        if b.num_rows == 0:
            continue
        per_row = max(1, b.nbytes // b.num_rows)
        step = max(1, min(rows, chars // per_row))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The strings of a column; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def bounded_sample(rows: DataFrame, most: int, *keys: Column, seed: int = 0) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of ``keys``.

    Rows are first thinned by the hash to about twice as many as are wanted, so that what tasks send on for the
    final choice doesn't grow with the number of tasks.
    """
    have = max(1, rows.count())
    place = F.xxhash64(F.lit(seed), *keys)
    share = min(1.0, (2 * most + 100) / have)
    return rows.where(F.pmod(place, F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(F.pmod(place, F.lit(1 << 30)), place, *keys).limit(most)


def components(ws: Workspace, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst), component being the smallest node reachable.

    Alternating large-star and small-star rounds of partial aggregations and joins; a round is staged, so the plan stays
    short and a lost executor costs one round. A node with very many neighbours is dealt over ``SALTS`` keys where it
    tells them of the smallest. Tables are merged, never broadcast: they grow with the links. Nulls and self-links are left out; an empty table gives an empty one. Raises if it doesn't settle.
    """
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    e = ws.stage(e, "edges")
    for _ in range(max_rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        both = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        part = ws.stage(both.groupBy("u", "salt").agg(F.min("v").alias("m")), "part")
        low = part.groupBy("u").agg(F.min("m").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = part.select("u", "salt").join(low.hint("merge"), "u")
        large = both.join(low.hint("merge"), ["u", "salt"]).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        large = ws.stage(large, "large")
        # Small star: every node points its smaller neighbours at the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(low.hint("merge"), "b").select("m", F.explode(F.array("a", "b")).alias("v")).where("m <> v")
        small = ws.stage(moved.select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "small")
        settled = _same(e, small)
        ws.drop(e, large, part)
        e = small
        if settled:
            return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _same(left: DataFrame, right: DataFrame) -> bool:
    """Whether two edge tables hold the same rows, by an order-free digest and the count."""
    digest = lambda t: t.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.shiftright(F.xxhash64("b", "a"), 20)).alias("s")).first()
    return tuple(digest(left)) == tuple(digest(right))
