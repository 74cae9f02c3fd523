"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight bytes at fixed positions. Two fingerprints that differ in at most three bits agree in at least
five bytes, the guaranteed minimum of matches. The index has lists for some sets of positions and the bytes there, enough for every
five positions to be seen; a list that is still long is split by adding positions, so that short lists alone are paired. Each list that two
fingerprints meet in says which of their positions agree; a pair's tally adds that up, pairs that reach the minimum are verified by their bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components, pieces, python_batches, texts, unused
from .words import word_parts

#: Bytes that must agree when at most three bits, and so at most three of the eight bytes, differ.
MIN_MATCHES = 5
MAX_BITS = 3
#: Positions of the first lists, and the length above which a list is split by one more (times what the split makes of an entry).
FIRST, LONG = 3, 6
#: The first lists: whichever five positions agree, each of these is in a list of agreeing ones, so a tally misses none. All 56 sets of
#: three do that, too, with 56 entries of each fingerprint; these 16 are the least that a search found.
LISTS = [(0, 1, 4), (0, 1, 6), (0, 2, 3), (0, 2, 6), (0, 3, 4), (0, 4, 7), (0, 5, 6), (0, 5, 7), (1, 2, 7), (1, 3, 5), (1, 4, 6), (2, 3, 4), (2, 4, 5), (2, 5, 6), (3, 6, 7), (4, 5, 7)]
#: Parts into which rows with one fingerprint are dealt for joins.
SALTS = 64
#: Bytes of a text whose words are hashed together.
PART = 1 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, shingle: int = 3) -> int:
    """Majority of the bits of the XXH64 (seed 42) of the word shingles of a text, repeats included; 0 without words."""
    counts, total, last = np.zeros(64, np.int64), 0, []
    for part in word_parts(text.encode("utf-8", "surrogatepass"), PART):
        words = [*last, *b" ".join(part).translate(_LOWER).split()]
        if len(words) < shingle:
            last = words
            continue
        total += len(words) - shingle + 1
        counts += _bits(words, shingle)
        last = words[len(words) - shingle + 1 :]
    if not total:
        if not last:
            return 0
        total, counts = 1, _bits(last, len(last))
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def _bits(words: list[bytes], shingle: int) -> np.ndarray:
    """How often each bit is set in the hashes of the shingles of some words."""
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    start, end = (ends - lengths)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_digest
    packed = b"".join([digest(joined[a:b], 42) for a, b in zip(start, end, strict=True)])
    return np.unpackbits(np.frombuffer(packed, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed 64-bit integer, null text counting as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fps = np.array([fingerprint(t) for t in texts(b, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _signed(m: int) -> int:
    return m - (1 << 64) if m >= 1 << 63 else m


def _first_masks() -> Column:
    return F.array(*[F.lit(_signed(sum(255 << 8 * i for i in c))).cast("long") for c in LISTS])


def _added(width: int, more: int, mask: Column) -> Column:
    """The masks that add ``more`` of the free positions, ``width`` bits each, to a mask."""
    ones = F.lit((1 << width) - 1).cast("long")
    at = lambda i: F.call_function("shiftleft", ones, (i * width).cast("int"))
    free = F.filter(F.sequence(F.lit(0), F.lit(64 // width - 1)), lambda i: mask.bitwiseAND(at(i)) == 0)
    if more == 1:
        return F.transform(free, lambda i: mask.bitwiseOR(at(i)))
    chosen = F.array(*[F.array(*map(F.lit, c)) for c in combinations(range(6), more)])  # three free bytes are six halves, three of these six quarters
    return F.transform(chosen, lambda c: F.aggregate(c, mask, lambda m, k: m.bitwiseOR(at(F.get(free, k)))))


#: How a long list is split: by a byte until five agree; then, as of six parts at most three hold a differing bit, by three halves
#: of the bytes that are left, and by three quarters. What is left then are six bits: no list is longer than 64. Pairing a list
#: makes half as many pairs of an entry as the list is long, a split four or five entries of it, or 20: so lists may be four times as
#: long where these are halves or quarters.
SPLITS = [(1, 8, 1)] * (MIN_MATCHES - FIRST) + [(4, 4, 3), (4, 2, 3)]


def tally(mask: Column) -> Column:
    """Positions whose bytes agree, given all bits that lists showed to agree."""
    return sum(((F.shiftright(mask, 8 * i).bitwiseAND(F.lit(255)) == 255).cast("int") for i in range(1, 8)), (mask.bitwiseAND(F.lit(255)) == 255).cast("int"))


def postings(fps: DataFrame, masks: Column) -> DataFrame:
    """(mask, key, fp): the entries of each distinct fingerprint in the lists of ``masks``, bits of whole positions."""
    return fps.select("fp", F.explode(masks).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def hits(lists: DataFrame) -> DataFrame:
    """(src, dst, mask) for every two fingerprints of a list that differ in at most ``MAX_BITS`` bits; lists are short, as ``SPLITS`` says.

    Bits are compared where a list is, so that the many pairs of a hot list that are no links never become rows.
    """
    pair = F.expr(f"explode(flatten(transform(fps, (x, i) -> transform(filter(slice(fps, i + 2, size(fps)), y -> bit_count(x ^ y) <= {MAX_BITS}), y -> struct(least(x, y) AS src, greatest(x, y) AS dst)))))")
    return lists.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("mask", pair.alias("p")).select("p.src", "p.dst", "mask")


def links(ws: Workspace, fps: DataFrame) -> DataFrame:
    """(src, dst): all pairs of the distinct, non-null fingerprints (fp) that differ in at most three bits.

    Two such fingerprints agree in five positions at least, so they share those of ``LISTS`` that lie in these, and of any split of
    one some list again; every position that agrees is seen in a list that is paired, and counts in the tally. An empty table has no links.
    """
    entries, found = postings(fps, _first_masks()), None
    for split in [*SPLITS, None]:
        lengths = entries.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = ws.stage(entries.join(lengths.hint("merge"), ["mask", "key"]), "shared")
        limit = LONG * split[0] if split else 64
        short = hits(shared.where(F.col("n") <= limit) if split else shared)
        found = short if found is None else found.unionByName(short)
        if split is None:
            break
        long = ws.stage(shared.where(F.col("n") > limit).groupBy("fp").agg(F.collect_set("mask").alias("masks")), "long")
        if long.isEmpty():
            break
        added = F.array_distinct(F.flatten(F.transform("masks", partial(_added, *split[1:]))))
        entries = ws.stage(postings(long, added), "postings")  # made once: they are counted and then looked up
    tallied = found.groupBy("src", "dst").agg(F.bit_or("mask").alias("mask"))
    return tallied.where(tally(F.col("mask")) >= MIN_MATCHES).select("src", "dst")


def _groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, component, component_id) of every row: component is the group's own fingerprint, component_id its smallest id."""
    ws = Workspace(docs.sparkSession, "simhash")
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    rows = ws.stage(fingerprints(docs, id_col, text_col), "fingerprints").withColumn("salt", salt)
    slots = ws.stage(rows.groupBy("fp", "salt").agg(F.min("id").alias("first")), "slots")
    nodes = ws.stage(slots.groupBy("fp").agg(F.min("first").alias("first")), "nodes")
    edges = ws.stage(links(ws, nodes.select("fp")), "links")
    # Components of fingerprints; the smallest id in each follows by one more aggregation.
    found = components(ws, edges).withColumnRenamed("node", "fp")
    # All of these tables grow with the documents, and compressed ones look small: they are merged, never broadcast.
    named = nodes.join(found.hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least.hint("merge"), "component").select("fp", "component", "component_id").join(slots.select("fp", "salt").hint("merge"), "fp")
    return rows.join(ws.stage(named, "named").hint("merge"), ["fp", "salt"]).select("id", "fp", "component", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component_id): for every row its fingerprint and the smallest id reachable over links, itself included.

    Texts with equal fingerprints are one node, so a group of copies costs one row however large it is; where its rows
    learn their component they are dealt over ``SALTS`` parts. Null ids take part with their text but never name a component unless
    there is no other id. Empty texts have fingerprint 0 and are linked like any other. Rows with the same id each get a
    row. An empty table gives an empty one; other columns are not read.
    """
    return _groups(docs, id_col, text_col).select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near duplicates, with all their columns.

    The row with the smallest id of its group stays (a null id only where there is no other), of equal ids in a group the one with the smaller
    fingerprint, one row of it. Different texts under one id are groups of their own, so both stay. Null texts are empty.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    found = ws.stage(_groups(docs, id_col, text_col), "groups")
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "fp")).alias("f")
    kept = ws.stage(found.groupBy("component").agg(first).select("f.id", "f.fp"), "kept")
    id_, fp = unused(docs, "kept_id"), unused(docs, "kept_fp")
    kept = kept.select(F.col("id").alias(id_), F.col("fp").alias(fp))
    same = F.col(id_col).eqNullSafe(F.col(id_))
    # One plan at every size: the kept ids grow with the documents, so they are merged, never broadcast.
    if found.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return docs.join(kept.hint("merge"), same, "left_semi")
    python_batches(docs.sparkSession)
    mark = unused(docs, "own_fp")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            own = np.array([fingerprint(t or "") for t in b.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own)], [*b.schema.names, mark])

    marked = docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", {mark} long")
    return marked.join(kept.hint("merge"), same & (F.col(mark) == F.col(fp)), "left_semi").dropDuplicates([id_col, mark]).drop(mark)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
