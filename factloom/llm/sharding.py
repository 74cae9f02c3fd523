"""Sharding by extendible hashing (DataFrame functions only).

A directory is indexed by the leading bits of a key's hash; a bucket over the byte limit is split on the next bit, others stay
as they are, until every shard fits. The directory grows a stride of bits at a time, below oversized buckets only, from sums of bytes
by prefix; documents move once, to their shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, finished_shuffles_removed, unused

#: Bits of the hash, the first 15 hexadecimal digits of an MD5, and bits by which the directory grows at a time.
BITS, STRIDE = 60, 10


def key_hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _bits(prefix: Column, depth: Column) -> Column:
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), depth.cast("int"), F.lit("0")))


def buckets(ws: Workspace, hashed: DataFrame, limit: int, known: int, depth: int) -> DataFrame:
    """(prefix, depth, bytes, n): the prefixes of ``known`` to ``depth`` bits whose parents are over the limit and that fit
    themselves, or that are the longest there are. ``hashed`` has (h, bytes, n), and its prefixes of ``known`` bits are over the limit.

    A level's sums are those of its children added up, so each is half as long as the one before, and a level is grouped by
    its own prefixes alone. Parents are told apart from the same level, without a join: a prefix learns its parent's sum from its sibling.
    """
    level = hashed.groupBy(F.shiftright("h", BITS - depth).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    level = ws.stage(level, f"level{depth}")
    levels = []
    for d in range(depth, known, -1):
        pair = level.groupBy(F.shiftright("prefix", 1).alias("parent")).agg(F.sum("bytes").alias("whole"), F.sum("n").alias("docs"), F.sort_array(F.collect_list(F.struct("prefix", "bytes", "n"))).alias("both"))  # at most two
        split = pair.where(F.col("whole") > limit).select(F.explode("both").alias("b")).select("b.prefix", F.lit(d).alias("depth"), "b.bytes", "b.n")
        levels.append(split if d == depth else split.where(F.col("bytes") <= limit))
        if d - 1 > known or known == 0:
            level = ws.stage(pair.select(F.col("parent").alias("prefix"), F.col("whole").alias("bytes"), F.col("docs").alias("n")), f"level{d - 1}")
    if known == 0:
        levels.append(level.where(F.col("bytes") <= limit).select("prefix", F.lit(0).alias("depth"), "bytes", "n"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return ws.stage(out, f"buckets{depth}")


def shard(docs: DataFrame, limit: int, key: str = "doc_id", size: Column | None = None) -> DataFrame:
    """``docs`` plus shard (the bits of its prefix, then ``-page`` where one hash alone is over the limit), shard_depth, shard_bytes and shard_docs.

    ``size`` defaults to the bytes of ``text``; null counts as 0. Rows whose 60 hash bits are all equal (repeated keys, or one row
    over the limit) can't be split by bits: they are laid out in pages by running sums, each within one part of the table, a row
    over half the limit alone on its page. Columns of these four names are replaced, other names are free. Null keys share one hash.
    An empty table gives an empty one. A directory entry joins hashes, never rows, so a hot key is one row there.
    """
    ws = Workspace(docs.sparkSession, "shard")
    rows = docs.drop("shard", "shard_depth", "shard_bytes", "shard_docs")
    h, own, place = (unused(rows, x) for x in ("hash", "own_bytes", "place"))
    rows = rows.withColumn(h, key_hash(F.col(key))).withColumn(own, F.coalesce(F.octet_length("text") if size is None else size, F.lit(0)).cast("long"))
    hashed = ws.stage(rows.groupBy(F.col(h).alias("h")).agg(F.sum(own).alias("bytes"), F.count("*").alias("n")), "hashes")
    leaves, rest, known = None, hashed, 0
    while known < BITS:
        depth = min(BITS, known + STRIDE)
        found = buckets(ws, rest, limit, known, depth)
        # The directory: an entry for each prefix of ``depth`` bits, at most 2 ** STRIDE to a bucket.
        cells = F.sequence(F.lit(0).cast("long"), F.expr(f"shiftleft(1L, {depth} - depth) - 1"))
        entries = found.select(F.explode(cells).alias("i"), "*").withColumn("cell", F.expr(f"shiftleft(prefix, {depth} - depth) + i")).drop("i")
        placed = rest.withColumnRenamed("bytes", "own").withColumnRenamed("n", "rows").withColumn("cell", F.shiftright("h", BITS - depth)).join(entries, "cell")
        placed = ws.stage(placed.select("h", "own", "rows", "depth", "prefix", "bytes", "n", (F.col("bytes") > limit).alias("over")), "placed")
        done = placed if depth == BITS else placed.where("not over")
        leaves = done if leaves is None else leaves.unionByName(done)
        rest, known = placed.where("over").select("h", F.col("own").alias("bytes"), F.col("rows").alias("n")), depth
        if rest.isEmpty():
            break
    full = unused(rows, "full")
    leaves = leaves.select(F.col("h").alias(h), F.col("over").alias(full), _bits(F.col("prefix"), F.col("depth")).alias("shard"), F.col("depth").cast("int").alias("shard_depth"), F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_docs"))
    rows = rows.join(leaves, h)
    if leaves.where(F.col(full)).isEmpty():
        return rows.drop(h, own, full)
    # Rows of one hash are paged within the parts that they were written in, so none of it is one task's work.
    paged = ws.stage(rows.where(F.col(full)), "full").withColumn(place, F.monotonically_increasing_id())
    paged = ws.stage(paged, "places")
    part, large = F.shiftright(place, 33), F.col(own) * 2 > limit
    order = Window.partitionBy(h, part, large).orderBy(own, place)
    before = F.coalesce(F.sum(own).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A running sum can leave up to a row unused, so pages count by where a row starts in half-limit steps; large rows are alone.
    page = F.when(large, F.concat(F.lit("L"), F.row_number().over(order))).otherwise(F.floor(before * 2 / limit).cast("string"))
    paged = paged.withColumn("shard", F.concat_ws("-", "shard", F.concat_ws(".", part.cast("string"), page)))
    sums = paged.groupBy("shard").agg(F.sum(own).alias("shard_bytes"), F.count("*").alias("shard_docs"))
    paged = paged.drop("shard_bytes", "shard_docs").join(sums, "shard")
    return rows.where(~F.col(full)).unionByName(paged.drop(place)).drop(h, own, full)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes one folder ``shard=b<bits>`` for each shard; rows of a shard meet in one task, which its byte limit bounds.

    Every row is written, with nulls as nulls; an empty table writes an empty folder. Rows that know their shard are written
    first, so that what they were shuffled for is gone from the disks when they move to their shards.
    """
    ws = Workspace(sharded.sparkSession, "write")
    sharded = ws.stage(sharded, "sharded")
    with finished_shuffles_removed(sharded.sparkSession):
        sharded.withColumn("shard", F.concat(F.lit("b"), "shard")).repartition("shard").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    ws.drop(sharded)


def read_shards(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows of ``write_shards`` from the files, with the columns of the table ``like`` that was written."""
    return spark.read.schema(like.schema).option("basePath", path).parquet(path).withColumn("shard", F.expr("substring(shard, 2)"))
