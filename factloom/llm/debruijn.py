"""Substring dedup by compaction of the de Bruijn graph of token k-mers, through Spark joins.

Every window of k words is an edge from the node of its first k-1 words to that of its last k-1. Edges arrive as runs: consecutive
windows that share one minimizer, the smallest hash of the m-word sequences inside them, at one place. Equal
windows have equal minimizers, so a minimizer seen once holds no repeat. A minimizer whose runs all have the same content is one
segment of the graph; where contents differ its runs are opened into single edges. Segments seen again are joined at
their nodes: where one comes in and one goes out, they belong to one nonbranching path, and pointer doubling gives each
its path and its place on it. Occurrences that follow one another on a path are one long span. Spans are cut where any
other span of the path starts or ends, the words at their source coordinates are read again, and only spans of equal
words are repeats of the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, pieces
from .words import Rolling, WordTable, overlapping, text_buffer, word_parts

#: Words of the sequences whose smallest hash names a path.
MINIMIZER = 6
_MIN_BASE = 0xC2B2AE3D27D4EB4F
#: Bytes of a text from which on it is gone through part by part, and of a part.
LONG, PART = 4 << 20, 1 << 20


def _paths(table: WordTable, k: int, m: int) -> tuple[np.ndarray, ...]:
    """Row, first word (within the row), windows, minimizer hash, content hash and hashes of the first and last node of each run of a batch."""
    hashes = table.hashes()
    total = len(hashes)
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(4))
    if total < k:
        return none
    inside = Rolling(hashes, _MIN_BASE)
    at = np.arange(total - m + 1)
    grams = inside.of(at, at + m)
    # The place of the smallest gram of each window, the leftmost of equals, by doubling.
    width, span, best = k - m + 1, 1, at
    while span * 2 <= width:
        a, b = best[: len(best) - span], best[span:]
        best = np.where(grams[a] <= grams[b], a, b)
        span *= 2
    if span < width:
        a, b = best[: len(best) - (width - span)], best[width - span :]
        best = np.where(grams[a] <= grams[b], a, b)
    row = table.row[: total - k + 1]
    valid = row == table.row[k - 1 :]
    if not valid.any():
        return none
    first = np.flatnonzero(valid & np.append(True, (best[1:] != best[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]))
    after = np.append(first[1:], total)
    ends = np.cumsum(valid)
    n = np.diff(np.append(0, ends[after[:-1] - 1])) if len(first) > 1 else np.zeros(0, np.int64)
    n = np.append(n, ends[-1] - (ends[first[-1] - 1] if first[-1] else 0))
    words = Rolling(hashes)
    return row[first], first - table.first[row[first]], n, grams[best[first]], words.of(first, first + n + k - 1), words.of(first, first + k - 1), words.of(first + n, first + n + k - 1)


_SEGMENT = "seg long, head long, tail long, doc long, start int, n int"


def _names(h: np.ndarray, bits: int) -> pa.Array:
    return pa.array((h >> np.uint64(64 - bits)).view(np.int64))


def _apart(b: pa.RecordBatch, limit: int) -> tuple[pa.RecordBatch, list[pa.RecordBatch]]:
    """The rows of a batch whose text (the second column) has at most ``limit`` bytes together, and each longer one by itself."""
    size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
    if not len(size) or size.max() <= limit:
        return b, []
    return b.filter(pa.array(size <= limit)), [b.slice(i, 1) for i in np.flatnonzero(size > limit).tolist()]


def _tables(batches: Iterator[pa.RecordBatch], k: int, long: int, part: int) -> Iterator[tuple[pa.RecordBatch, int, WordTable]]:
    """(batch, words before, words): all texts of a batch together, or a part of the only text of one."""
    for b in pieces(batches):
        some, alone = _apart(b, long)
        if some.num_rows:
            yield some, 0, WordTable(*text_buffer(some.column(1)))
        for one in alone:
            for before, table in overlapping(text_buffer(one.column(1))[0], k, part):
                yield one, before, table


def paths(docs: DataFrame, k: int, m: int, bits: int = 64) -> DataFrame:
    """(minimizer, seg, head, tail, doc, start, n): the runs of all documents; seg names the content. ``docs`` has (doc, text). A run of a long text ends with its part."""
    long, part = LONG, PART

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, before, table in _tables(batches, k, long, part):
            row, start, n, minimizer, *named = _paths(table, k, m)
            start, doc = start + before, b.column(0).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(minimizer.view(np.int64)), *[_names(h, bits) for h in named], doc, pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["minimizer", "seg", "head", "tail", "doc", "start", "n"])

    return docs.mapInArrow(run, "minimizer long, " + _SEGMENT)


def _open(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """The windows of the runs listed in ``runs`` as segments of one edge, read from the text again. A document's list is no longer than its text."""

    long, part = LONG, PART

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, before, table in _tables(batches, k, long, part):
            rolling = Rolling(table.hashes())
            runs = b.column(2)
            per = np.asarray(runs.value_lengths())
            start, n = (runs.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(2))
            row = np.repeat(np.arange(len(per)), per)
            if b.num_rows == 1:  # of its runs those windows that start in this part
                end = np.minimum(start + n, before + max(0, len(table.start) - k + 1)) - before
                start = np.maximum(start - before, 0)
                inside = end > start
                start, n, row = start[inside], (end - start)[inside], row[inside]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(table.first[row] + start, n) + step
            owner = np.repeat(row, n)
            named = [_names(rolling.of(at + i, at + j), bits) for i, j in ((0, k), (0, k - 1), (1, k))]
            yield pa.RecordBatch.from_arrays([*named, b.column(0).take(pa.array(owner)), pa.array((at - table.first[owner] + before).astype(np.int32)), pa.array(np.ones(len(at), np.int32))], ["seg", "head", "tail", "doc", "start", "n"])

    return docs.mapInArrow(run, _SEGMENT)


def compact(ws: Workspace, segments: DataFrame) -> DataFrame:
    """(seg, path, off) of every segment (seg, head, tail, n): the first segment of its nonbranching path, and windows before it there.

    Nodes where exactly one segment comes in and one goes out are joined. Pointers to the segment before are doubled, so rounds grow
    with the logarithm of the longest path; a segment that has reached the start takes no part any more, so no
    segment is asked for by more than one. A closed circle has no start: its segments stay paths of their own.
    """
    ends = segments.select(F.col("head").alias("node"), F.col("seg").alias("leaves"), F.lit(None).cast("long").alias("comes"), F.lit(None).cast("long").alias("n"))
    ends = ends.union(segments.select("tail", F.lit(None).cast("long"), "seg", F.col("n").cast("long")))
    nodes = ends.groupBy("node").agg(F.count("leaves").alias("o"), F.count("comes").alias("i"), F.min("leaves").alias("seg"), F.min("comes").alias("at"), F.min("n").alias("off"))
    table = ws.stage(nodes.where("o = 1 and i = 1 and seg <> at").select("seg", "at", "off", F.lit(False).alias("done")), "pointers")
    open_, arrived, rounds = table.count(), None, [table]
    while open_:
        # Segments that have reached the start are written once; those on their way look them up as well as one another.
        every = table.where("not done") if arrived is None else table.where("not done").unionByName(arrived)
        ahead = every.select(F.col("seg").alias("at"), F.col("at").alias("far"), F.col("off").alias("more"), F.col("done").alias("there"))
        # What points to a segment that nothing comes before has arrived.
        moved = table.where("not done").join(ahead, "at", "left").select("seg", F.coalesce("far", "at").alias("at"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off"), (F.col("far").isNull() | F.col("there")).alias("done"))
        table = ws.stage(moved, "pointers")
        rounds.append(table)
        arrived = table.where("done") if arrived is None else arrived.unionByName(table.where("done"))
        left = table.where("not done").count()
        if left == open_:
            break
        open_ = left
    known = (rounds[0].where("done") if arrived is None else arrived).select("seg", F.col("at").alias("path"), "off")
    out = segments.select("seg").join(known, "seg", "left").select("seg", F.coalesce("path", "seg").alias("path"), F.coalesce("off", F.lit(0).cast("long")).alias("off"))
    out = ws.stage(out, "paths")
    ws.drop(*rounds)
    return out


def spans(ws: Workspace, segments: DataFrame, found: DataFrame) -> DataFrame:
    """(path, cut, doc, start, n): occurrences of whole stretches of paths. ``found`` has all occurrences of ``segments``, maybe of others.

    Consecutive occurrences on a path are one span; a stretch reaches from one place where any span of the path starts
    or ends to the next, so all occurrences of a stretch have the same length. A path's list of places is no longer than the path.
    """
    where = compact(ws, segments)
    placed = found.select("seg", "doc", "start", "n").join(where, "seg")
    line = Window.partitionBy("doc", "path", "lag").orderBy("start")
    first = (~F.lag(F.col("start") + F.col("n")).over(line).eqNullSafe(F.col("start"))).cast("int")
    placed = placed.withColumn("lag", F.col("start") - F.col("off")).withColumn("first", first).withColumn("island", F.sum("first").over(line))
    whole = placed.groupBy("doc", "path", "lag", "island").agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.min("off").alias("off"))
    whole = ws.stage(whole.select("doc", "path", "start", "off", (F.col("off") + F.col("n")).alias("end")), "whole")
    cuts = whole.select("path", F.explode(F.array("off", "end")).alias("cut")).distinct().groupBy("path").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    inside = whole.join(ws.stage(cuts, "cuts"), "path").withColumn("own", F.expr("filter(cuts, c -> c >= off AND c <= end)"))
    cut = F.expr("explode(transform(slice(own, 1, size(own) - 1), (c, i) -> struct(c AS cut, own[i + 1] AS next)))")
    out = inside.select("doc", "path", "start", "off", cut.alias("s"))
    out = ws.stage(out.select("path", "s.cut", "doc", (F.col("start") + F.col("s.cut") - F.col("off")).cast("int").alias("start"), (F.col("s.next") - F.col("s.cut")).cast("int").alias("n")), "spans")
    ws.drop(where, whole)
    return out


def _shas(raw: bytes, start: np.ndarray, n: np.ndarray, part: int) -> list[bytes]:
    """The SHA-256 of n words from each start, joined by one space; words come part by part, and a digest goes on from part to part."""
    out, before = [hashlib.sha256() for _ in start], 0
    for words in word_parts(raw, part):
        for i in np.flatnonzero((start < before + len(words)) & (start + n > before)).tolist():
            a = int(start[i]) - before
            piece = b" ".join(words[max(a, 0) : a + int(n[i])])
            out[i].update(b" " + piece if a < 0 else piece)
        before += len(words)
    return [x.digest() for x in out]


def _digests(docs: DataFrame, k: int) -> DataFrame:
    """(path, cut, words, doc, start, n): the SHA-256 of the words of every span in ``runs``, read at its source coordinates."""
    part = PART

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            doc, out = [], []
            for d, text, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                path, cut, start, n = (runs.values.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                doc += [d] * len(n)
                shas = _shas(text.encode("utf-8", "surrogatepass"), start.astype(np.int64), n.astype(np.int64) + k - 1, part)
                out.append(pa.table({"path": path, "cut": cut, "words": pa.array(shas, pa.binary()), "start": start, "n": n}))
            t = pa.concat_tables(out)
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("path", "cut", "words")), pa.array(doc, pa.int64()), *(t.column(c).combine_chunks() for c in ("start", "n"))], ["path", "cut", "words", "doc", "start", "n"])

    return docs.mapInArrow(run, "path long, cut long, words binary, doc long, start int, n int")


def repeated_windows(docs: DataFrame, ws: Workspace, k: int, m: int, bits: int = 64) -> DataFrame:
    """(doc, start, n): runs of windows whose words also start earlier. ``docs`` has (doc, text), no doc twice."""
    every = paths(docs, k, m, bits)
    # Keys to join by are staged: between two plain shuffles Spark can split the part of a hot key.
    often = ws.stage(every.groupBy("minimizer").agg(F.count("*").alias("c")).where("c > 1").select("minimizer"), "often")
    shared = ws.stage(every.join(often, "minimizer"), "shared")
    # More than one content of a minimizer is a branch: its runs are opened into edges, of which only those seen again matter.
    branches = shared.groupBy("minimizer").agg(F.min("seg").alias("low"), F.max("seg").alias("high")).where("low <> high").select("minimizer")
    branches = ws.stage(branches, "branches")
    runs = shared.join(branches, "minimizer", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    edges = ws.stage(_open(docs.join(runs, "doc").select("doc", "text", "runs"), k, bits), "edges")
    end = (F.min("head").alias("head"), F.min("tail").alias("tail"), F.min("n").alias("n"))
    again = edges.groupBy("seg").agg(F.count("*").alias("c"), *end).where("c > 1").drop("c")
    plain = ws.stage(shared.join(branches, "minimizer", "left_anti").drop("minimizer"), "plain")
    ws.drop(often, shared, branches)
    segments = ws.stage(plain.groupBy("seg").agg(*end).unionByName(again), "segments")
    long = spans(ws, segments, plain.unionByName(edges))
    ws.drop(plain, edges, segments)
    listed = long.groupBy("doc").agg(F.collect_list(F.struct("path", "cut", "start", "n")).alias("runs"))
    read = ws.stage(_digests(docs.join(listed, "doc").select("doc", "text", "runs"), k), "read")
    firsts = ws.stage(read.groupBy("path", "cut", "words").agg(F.count("*").alias("c"), F.min(F.struct("doc", "start")).alias("at")).where("c > 1").select("path", "cut", "words", "at"), "firsts")
    out = ws.stage(read.join(firsts, ["path", "cut", "words"]).where("doc <> at.doc or start <> at.start").select("doc", "start", "n"), "repeats")
    ws.drop(long, read, firsts)
    return out


def cover(words: int, start: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a window that starts at one of start, start + 1, ..., start + n - 1."""
    change = np.zeros(words + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + n + k - 1, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, k: int = 20, m: int = MINIMIZER, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """(id_col, n_words, n_removed, kept): kept is what is left of each text, its words joined by one space.

    A word goes if a window of ``k`` words covers it whose sequence also starts earlier, in a smaller id or earlier in the
    same document. Graph and spans go by hashes of ``bits`` bits; what they propose is removed only where the SHA-256 of the words
    themselves agrees. Null ids come first; rows of equal ids count as documents one after the other, in the order of their
    texts' hash. Null text has no words, an empty table gives an empty one, other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "debruijn")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not docs.schema[id_col].dataType.simpleString() in ("bigint", "int") or not rows.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        order = ["id", F.xxhash64("text")]
        rows = ws.stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("doc", F.monotonically_increasing_id()), "ranked")
    else:
        rows = rows.withColumn("doc", F.col("id").cast("long"))
    python = rows.select("doc", "text")
    found = repeated_windows(python, ws, k, m, bits)
    gone = found.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    part = PART

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            counts, removed, kept = [], [], []
            for text, runs in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                raw = (text or "").encode()
                start, n = (runs.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2)) if runs.is_valid and len(runs) else (None, None)
                parts = [raw.split()] if len(raw) <= part else None
                total = sum(map(len, parts or word_parts(raw, part)))
                gone, at, left, out = cover(total, start, n, k) if start is not None else None, 0, 0, []
                for words in parts or word_parts(raw, part):
                    if gone is not None:
                        words, at = [w for w, g in zip(words, gone[at : at + len(words)].tolist(), strict=True) if not g], at + len(words)
                    left += len(words)
                    if words:
                        out.append(b" ".join(words))
                counts.append(total)
                removed.append(total - left)
                kept.append(b" ".join(out).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.join(gone, "doc", "left").select("id", "text", "spans").mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)
