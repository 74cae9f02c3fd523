"""Resampling documents towards a target distribution, by importance weights over hashed features.

Features are runs of one to two words, hashed to buckets. What a bucket is worth is the logarithm of how much more frequent it is in the
target than in the corpus: an array, from which a document's weight is the mean over its features. Gumbel noise hashed from the
seed and the document's id turns the best scores into a draw without replacement.

The draw is an external merge sort. Each partition sorts the scores that can be drawn into a run of blocks. How many documents have each
score (scores are integers of a narrow range) tells the lowest score drawn, and cuts the order into intervals of bounded length whose first rank is
known. A merge task gets the blocks of its intervals in the order of their heads and merges them in a tournament tree, whose leaves are the
runs, until the draw is complete: it holds blocks that overlap, not an interval.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, pieces

#: Ranks of an interval that one merge task emits, but for the documents of its last score.
INTERVAL = 20_000
#: Rows of a block.
BLOCK = 512
#: Bytes of a text that are looked at together.
PART = 1 << 20
#: ASCII letters in lower case; digits, and bytes of other characters, as they are; anything else is a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def hashed(raw: memoryview, buckets: int) -> Iterator[tuple[np.ndarray, int]]:
    """Buckets of all features of a UTF-8 text, and the number of words they start at, part by part whatever its length."""
    carry, last = b"", None  # a word that may go on, the checksum of the word before
    for i in range(0, len(raw), PART):
        part = carry + bytes(raw[i : i + PART]).translate(_FOLD)
        cut = part.rfind(b" ") + 1 if i + PART < len(raw) else len(part)
        words, carry = part[:cut].split(), part[cut:]
        if not words:
            continue
        single = list(map(zlib.crc32, words))
        before = [last, *single[:-1]] if last is not None else single[:-1]
        after = words if last is not None else words[1:]
        double = list(map(zlib.crc32, [b" " + w for w in after], before))  # a checksum goes on from where the first word's ended
        last = single[-1]
        yield np.array(single + double, np.int64) % buckets, len(words)


def feature_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How many features of a column of texts are in each bucket. Tasks count before anything moves; one row a bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in pieces(batches):
            for x in b.column(0):
                for found, _ in hashed(memoryview(x.as_buffer()) if x.is_valid else memoryview(b""), buckets):
                    total += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target over that in the corpus, one added to each count."""
    n = len(corpus)
    above, below = target.sum() + 0, corpus.sum() + 0
    return np.array([math.floor(1000 * math.log((t + 1) * (int(below) + n) / ((s + 1) * (int(above) + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of a table (id, text): the floored mean gain of the features, 0 where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2000):
            rows = []
            for x in b.column(1):
                words = n = total = 0
                for found, w in hashed(memoryview(x.as_buffer()) if x.is_valid else memoryview(b""), len(gain)):
                    words, n, total = words + w, n + len(found), total + int(gain[found].sum())
                rows.append((words, n, total // n if n else 0))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]], ["id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise, floored, from the first 32 bits of SHA-256 of ``seed:id``. A null id counts as the empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


class Tournament:
    """A winner tree over runs. Each leaf has the keys of its run's blocks, ascending; a run whose blocks are used up loses to all."""

    def __init__(self) -> None:
        self.leaf: dict[int, int] = {}  # of each run
        self.blocks: list[deque] = []  # of each leaf: blocks (keys, rows) and how far the first one has been used
        self.at: list[int] = []
        self.tree: list[int] = [-1, -1]  # the winning leaf below each node; leaves are the second half

    def key(self, leaf: int) -> tuple | None:
        return self.blocks[leaf][0][0][self.at[leaf]] if leaf >= 0 and self.blocks[leaf] else None

    def add(self, run: int, keys: list[tuple], rows: list[tuple]) -> None:
        if run not in self.leaf:
            self.leaf[run] = len(self.blocks)
            self.blocks.append(deque())
            self.at.append(0)
            if len(self.blocks) > len(self.tree) // 2:
                size = len(self.tree)
                self.tree = [-1] * (2 * size)
                for i in range(len(self.blocks)):
                    self.tree[size + i] = i
                for node in range(size - 1, 0, -1):
                    self.tree[node] = self._winner(self.tree[2 * node], self.tree[2 * node + 1])
            self.tree[len(self.tree) // 2 + self.leaf[run]] = self.leaf[run]
        leaf = self.leaf[run]
        self.blocks[leaf].append((keys, rows))
        if len(self.blocks[leaf]) == 1:
            self._replay(leaf)

    def _winner(self, a: int, b: int) -> int:
        x, y = self.key(a), self.key(b)
        return a if y is None or x is not None and x <= y else b

    def _replay(self, leaf: int) -> None:
        node = len(self.tree) // 2 + leaf
        while node > 1:
            node //= 2
            self.tree[node] = self._winner(self.tree[2 * node], self.tree[2 * node + 1])

    def _second(self, leaf: int) -> tuple | None:
        """The best key of those that lost to the winner directly."""
        node, best = len(self.tree) // 2 + leaf, None
        while node > 1:
            k = self.key(self.tree[node ^ 1])
            if k is not None and (best is None or k < best):
                best = k
            node //= 2
        return best

    def below(self, bound: tuple | None) -> Iterator[tuple]:
        """Rows in the order of their keys as long as these are below ``bound``, or all. What a run has before the second best run is taken at once."""
        while (key := self.key(leaf := self.tree[1])) is not None and (bound is None or key < bound):
            keys, rows = self.blocks[leaf][0]
            limit = min((x for x in (bound, self._second(leaf)) if x is not None), default=None)
            end = len(keys) if limit is None else max(bisect_left(keys, limit, self.at[leaf]), self.at[leaf] + 1)
            yield from rows[self.at[leaf] : end]
            self.at[leaf] = end
            if end == len(keys):
                self.blocks[leaf].popleft()
                self.at[leaf] = 0
            self._replay(leaf)


def intervals(counts: dict[int, int], draw: int, length: int) -> tuple[int | None, list[tuple[int, int]]]:
    """The lowest score of which rows are drawn, and (lowest score, rows before it) of each interval, from the best on."""
    out, total, start = [], 0, 0
    for score in sorted(counts, reverse=True):
        if total >= draw:
            break
        if not out or total - start >= length:
            out.append((score, start := total))
        out[-1] = (score, start)
        total += counts[score]
    return (out[-1][0] if out else None), out


def _runs(rows: DataFrame, cut: list[tuple[int, int]], block: int) -> DataFrame:
    """Sorted runs as blocks (interval, head_score, head_id, run, rows) of a table (id, n_features, weight, score); a block is of one interval."""
    kind = rows.schema["id"].dataType.simpleString()
    lows = [-s for s, _ in cut]  # ascending

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, wait, inside, id_kind = TaskContext.get().partitionId(), [], 0, None
        for b in batches:
            id_kind = b.column(0).type
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = bisect_left(lows, -row[3])
                if wait and (at != inside or len(wait) >= block):
                    yield _block(wait, inside, number, id_kind)
                    wait = []
                inside = at
                wait.append(row)
        if wait:
            yield _block(wait, inside, number, id_kind)

    ordered = rows.sortWithinPartitions(F.desc("score"), F.asc_nulls_first("id"))
    return ordered.mapInArrow(run, f"interval int, head_score long, head_id {kind}, run int, rows array<struct<id:{kind},n_features:bigint,weight:bigint,score:bigint>>")


def _block(rows: list[tuple], interval: int, run: int, kind: pa.DataType) -> pa.RecordBatch:
    names = ("id", "n_features", "weight", "score")
    fields = pa.list_(pa.struct([("id", kind), *[(c, pa.int64()) for c in names[1:]]]))
    columns = [pa.array([interval], pa.int32()), pa.array([rows[0][3]], pa.int64()), pa.array([rows[0][0]], kind), pa.array([run], pa.int32()), pa.array([[dict(zip(names, r, strict=True)) for r in rows]], fields)]
    return pa.RecordBatch.from_arrays(columns, ["interval", "head_score", "head_id", "run", "rows"])


def _key(score: int, id_: object, run: int) -> tuple:
    return -score, id_ is not None, id_ if id_ is not None else 0, run


def _merged(blocks: DataFrame, cut: list[tuple[int, int]], draw: int) -> DataFrame:
    """(id, n_features, weight, score, rank) of all rows in ``blocks``; the rank is null once the draw is complete."""
    first = [before for _, before in cut]
    kind = blocks.schema["head_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_features", "weight", "score", "rank"]
        inside, rank, tree, out, id_kind = None, 0, Tournament(), [], None

        def take(rows: Iterator[tuple]) -> None:
            nonlocal rank
            for r in rows:
                rank += 1
                out.append((*r, rank if rank <= draw else None))

        def batch() -> pa.RecordBatch:
            ids, *longs = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, id_kind), *[pa.array(c, pa.int64()) for c in longs]], names)

        for b in batches:
            id_kind = b.column("head_id").type
            for interval, score, id_, number, rows in zip(*(b.column(c).to_pylist() for c in ("interval", "head_score", "head_id", "run", "rows")), strict=True):
                if interval != inside:
                    take(tree.below(None))
                    inside, rank, tree = interval, first[interval], Tournament()
                take(tree.below(_key(score, id_, number)))
                rows = [(r["id"], r["n_features"], r["weight"], r["score"]) for r in rows]
                tree.add(number, [_key(r[3], r[0], number) for r in rows], rows)
                if len(out) >= 10_000:
                    yield batch()
        take(tree.below(None))
        if out:
            yield batch()

    ordered = blocks.repartition("interval").sortWithinPartitions("interval", F.desc("head_score"), F.asc_nulls_first("head_id"), "run")
    return ordered.mapInArrow(run, f"id {kind}, n_features long, weight long, score long, rank long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id_col, n_features, weight, score, rank): every document, with its rank in the draw, null for those that aren't drawn.

    Of the documents with at least ``least_words`` words ``percent`` in a hundred are drawn, rounded down: those with the best scores,
    ties to the smaller id (null first, rows of one id in any order). Null texts are empty; an empty table gives an empty one, an
    empty target weighs by rarity alone; other columns are not read. The texts are read twice, for the corpus's counts and for
    weights, and never moved. What comes to the driver is one row for each bucket and each score, of which there are some
    60,000 at most whatever the number of documents: weights lie between the logarithms of the extreme shares, noise between -3.2 and 22.9.
    Documents of one score are merged by one task, as they come.
    """
    if not 0 <= percent <= 100 or buckets < 1:
        raise ValueError("percent must be from 0 to 100, and buckets positive")
    ws = Workspace(docs.sparkSession, "resample")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    gain = gains(feature_counts(rows.select("text"), buckets), feature_counts(target.select(target_col), buckets))
    scored = weights(rows, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = ws.stage(scored.select("id", "n_features", "weight", "score", (F.col("n_words") >= least_words).alias("may")), "scored")
    counts = dict(scored.where("may").groupBy("score").count().collect())
    draw = percent * sum(counts.values()) // 100
    low, cut = intervals(counts, draw, INTERVAL)
    drawn = F.col("may") & (F.col("score") >= low) if low is not None else F.lit(False)
    rest = scored.where(~drawn).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    best = _merged(_runs(scored.where(drawn).select("id", "n_features", "weight", "score"), cut, BLOCK), cut, draw)
    return best.unionByName(rest).withColumnRenamed("id", id_col)
