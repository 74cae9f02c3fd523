"""Quality rules: an isolation forest over the statistics that rules look at, its threshold calibrated from labelled rows.

Every document gets the same statistics from its whole text. Trees split them at random, more often those that tell labelled
rows apart; a document that
random splits set apart after few steps is unlike most of the labelled ones the trees were grown from. The score
at which documents are rejected comes from the scores of all labelled rows that no tree was grown from.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bounded_sample, pieces, texts
from .words import word_parts

SEPARATORS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: Bytes of a long text that are looked at together.
PART = 1 << 20
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits"]
#: Bins of the score, which lies between 0 and 1, for the calibration's histogram.
BINS = 2000


def statistics(text: str) -> tuple[int, ...]:
    """The counts named in ``COUNTS``, of a whole text. Words of a long text are numbers while they are counted, so that it takes little beside the text."""
    raw = text.encode("utf-8", "surrogatepass")
    word_chars = len(text) - sum(map(text.count, SEPARATORS))
    seen: set[str] = set()
    dup = lines = 0
    for line in _lines(text):
        if line.strip(SEPARATORS):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    del seen
    if len(raw) <= PART:
        words = raw.split()
        n, repeated = len(words), 0
        if n > 3:
            grams = list(zip(words, words[1:], words[2:], strict=False))
            if len(set(grams)) < len(grams):
                often = {g for g, n_ in Counter(grams).items() if n_ > 1}
                hit = [g in often for g in grams]
                repeated = sum(map(any, zip([*hit, 0, 0], [0, *hit, 0], [0, 0, *hit], strict=True)))
    else:
        n, repeated = _repeated(raw)
    upper = digits = 0
    for i in range(0, len(raw), PART):
        code = np.frombuffer(raw[i : i + PART], np.uint8)
        upper += int(((code >= 65) & (code <= 90)).sum())
        digits += int(((code >= 48) & (code <= 57)).sum())
    return n, word_chars, sum(map(text.count, SYMBOLS)), dup, repeated, lines, upper, digits


def _lines(text: str) -> Iterator[str]:
    if len(text) <= PART:
        yield from text.split("\n")
        return
    start = 0
    while (end := text.find("\n", start)) >= 0:
        yield text[start:end]
        start = end + 1
    yield text[start:]


def _repeated(raw: bytes) -> tuple[int, int]:
    """Words, and those in three-word windows found twice or more, of a long text; each different word is a number, and so is each pair of them."""
    known: dict[bytes, int] = {}
    parts = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) for words in word_parts(raw, PART)]
    ids = np.concatenate([np.zeros(0, np.int64), *parts])
    n, size = len(ids), len(known)
    del known, parts
    if n <= 3:
        return n, 0
    pair = ids[:-1] * size + ids[1:]
    pair = np.searchsorted(np.unique(pair), pair)  # under n, so that the next product is a whole number of 64 bits
    window = pair[:-1] * size + ids[2:]
    ordered = np.sort(window)
    often = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered, pair, ids
    hit = np.zeros(n, bool)
    if len(often):
        for i in range(0, len(window), PART):
            at = np.flatnonzero(often[np.minimum(np.searchsorted(often, window[i : i + PART]), len(often) - 1)] == window[i : i + PART]) + i
            hit[at] = hit[at + 1] = hit[at + 2] = True
    return n, int(hit.sum())


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the counts of every row; null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = [statistics(t) for t in texts(b, "text")]
            columns = np.array(found, np.int64).reshape(-1, len(COUNTS)).T
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns)], ["id", *COUNTS])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


RATIOS = ["symbols a word", "characters a word", "repeated lines", "repeated words", "words a line", "upper case", "digits"]


def features(counts: np.ndarray) -> np.ndarray:
    """The rule statistics in ``RATIOS``, as they are, from rows of ``COUNTS``; ratios don't follow a text's length."""
    words, chars, symbols, dup, repeated, lines, upper, digits = counts.astype(float).T
    w, c, n = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    return np.stack([symbols / w, chars / w, dup / n, repeated / w, words / n, upper / c, digits / c], axis=1)


def telling(rows: np.ndarray, quality: np.ndarray) -> np.ndarray:
    """How often a feature is to be split on, by how well it tells labelled bad rows from good ones (by its value or its distance
    from the good ones' median). The best one comes first; a further one counts for the bad rows that those before leave among
    the good ones, so that features that only follow another don't dilute it. Every feature is split on now and then."""
    good, bad = rows[quality == 1], rows[quality != 1]
    weights = np.full(rows.shape[1], 0.005)
    if not len(good) or not len(bad):
        return weights / weights.sum()
    middle = np.median(good, axis=0)
    usual = np.quantile(abs(good - middle), 0.999, axis=0)

    def apart(a: np.ndarray, b: np.ndarray) -> float:
        order = np.sort(a)
        below = (np.searchsorted(order, b, side="left") + np.searchsorted(order, b, side="right")) / 2
        return abs(2 * below.mean() / len(a) - 1)

    left, unused = bad, list(range(rows.shape[1]))
    while len(left) and unused:
        found = [max(apart(good[:, k], left[:, k]), apart(abs(good[:, k] - middle[k]), abs(left[:, k] - middle[k]))) for k in unused]
        k = unused.pop(int(np.argmax(found)))
        weights[k] += max(found) ** 2 * len(left) / len(bad)
        left = left[abs(left[:, k] - middle[k]) <= usual[k]]
    return weights / weights.sum()


class IsolationForest:
    """Trees of random splits; ``score`` is 2 ** -(mean path length / expected), near 1 for the most isolated rows."""

    def __init__(self, trees: int = 100, sample: int = 256, seed: int = 0, weights: np.ndarray | None = None) -> None:
        self.trees, self.sample, self.seed, self.weights = trees, sample, seed, weights
        self.nodes: list[tuple[np.ndarray, ...]] = []

    @staticmethod
    def expected(n: np.ndarray | float) -> np.ndarray:
        """Mean path length of an unsuccessful search among n rows."""
        n = np.asarray(n, float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def fit(self, rows: np.ndarray, odd: np.ndarray | None = None) -> IsolationForest:
        """Grows the trees. Rows known to be ``odd`` are at most one in 64 of a tree's, so that they don't hide one another."""
        rng = np.random.default_rng(self.seed)
        height = int(np.ceil(np.log2(max(2, min(self.sample, len(rows))))))
        self.base = max(1.0, float(self.expected(min(self.sample, len(rows)))))
        for _ in range(self.trees):
            part = rng.permutation(len(rows))[: self.sample]
            if odd is not None and odd.any() and not odd.all():
                few = max(1, self.sample // 64)
                part = np.concatenate([rng.permutation(np.flatnonzero(~odd))[: self.sample - few], rng.permutation(np.flatnonzero(odd))[:few]])
            part = rows[part]
            tree: list[list[float]] = []  # feature (-1: leaf), split, left, right, path length at a leaf
            todo = [(part, 0, -1, 0)]
            while todo:
                x, depth, parent, side = todo.pop()
                at = len(tree)
                if parent >= 0:
                    tree[parent][2 + side] = at
                spread = x.max(axis=0) > x.min(axis=0) if len(x) > 1 else np.zeros(rows.shape[1], bool)
                f = int(rng.choice(np.flatnonzero(spread)) if self.weights is None and spread.any() else rng.choice(len(spread), p=self.weights))
                # Where rows don't differ in what is asked of them, they are alike.
                if depth >= height or not spread[f]:
                    tree.append([-1, 0, at, at, depth + float(self.expected(len(x)))])
                    continue
                cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
                tree.append([f, cut, -1, -1, 0])
                todo += [(x[x[:, f] < cut], depth + 1, at, 0), (x[x[:, f] >= cut], depth + 1, at, 1)]
            a = np.array(tree)
            self.nodes.append((a[:, 0].astype(int), a[:, 1], a[:, 2:4].astype(int), a[:, 4]))
        self.height = height
        return self

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, cut, child, path in self.nodes:
            at = np.zeros(len(rows), int)
            for _ in range(self.height):
                f = feature[at]
                at = child[at, (rows[every, np.maximum(f, 0)] >= cut[at]).astype(int)]
            total += path[at]
        return 2.0 ** (-total / len(self.nodes) / self.base) if self.nodes else np.zeros(len(rows))


def threshold(histogram: list[tuple[int, int, int]], keep_good: float, spare: float = 0.01) -> int:
    """The bin from which documents are rejected: of those that keep at least ``keep_good`` of the good rows, the one that
    rejects most of the bad ones, and of equals the middle (the highest if none rejects any). A few good rows that share a score would push it above every bad
    row below them, so a lower bin is taken if its errors, good rows rejected and bad rows kept, are fewer, and it still keeps
    all but ``spare`` of the good rows. ``histogram``: (bin, quality, rows)."""
    good, bad = np.zeros(BINS + 1, int), np.zeros(BINS + 1, int)
    for b, quality, n in histogram:
        (good if quality else bad)[b] += n
    if not good.sum():
        return BINS + 1
    lost = good.sum() - np.concatenate([[0], np.cumsum(good)])  # by cutting in front of each bin
    left = np.concatenate([[0], np.cumsum(bad)])
    kept = 1 - lost / good.sum()
    allowed = np.flatnonzero(kept >= keep_good)
    central = lambda bins: bins.max() if left[bins.max()] == bad.sum() else (bins.min() + bins.max()) // 2
    best = central(allowed[left[allowed] == left[allowed].min()])
    looser = np.flatnonzero(kept >= min(keep_good, 1 - spare))
    least = central(looser[(lost + left)[looser] == (lost + left)[looser].min()])
    return int(least if (lost + left)[least] < (lost + left)[best] else best)


class Judge:
    """A grown forest and the bin of the score from which it rejects."""

    def __init__(self, forest: IsolationForest, cut: int, min_words: int) -> None:
        self.forest, self.cut, self.min_words = forest, cut, min_words

    def failed(self, counts: np.ndarray) -> np.ndarray:
        words, repeated = counts[:, COUNTS.index("n_words")], counts[:, COUNTS.index("n_repeat_words")]
        return (words < self.min_words) | (100 * repeated > 50 * words)

    def verdict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """base_failed, score and kept of rows of ``COUNTS``."""
        failed, score = self.failed(counts), self.forest.score(features(counts))
        return failed, score, ~failed & (np.floor(score * BINS) < self.cut)


def _scored(rows: DataFrame, judge: Judge) -> DataFrame:
    """``rows``, which have the counts, with base_failed, score and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in COUNTS], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, judge.verdict(counts))], [*b.schema.names, "base_failed", "score", "kept"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", base_failed boolean, score double, kept boolean")


def calibrate(rows: DataFrame, labels: DataFrame, ws: Workspace, id_col: str = "doc_id", trees: int = 200, sample: int = 256, fit_rows: int = 10000, keep_good: float = 0.999, seed: int = 0, min_words: int = 50) -> Judge:
    """The judge of documents whose counts are in ``rows`` (see ``judge``)."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    known = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max("quality").alias("quality"))
    grows = F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(2)) == 0
    labelled = ws.stage(rows.where(~failed).join(known, "id").select("id", "quality", *COUNTS, grows.alias("grows")), "labelled")
    halves = labelled.select("grows", F.col("quality").cast("int")).distinct().count() == 4  # else too few labels to divide: all serve for both
    grown, others = (labelled.where("grows"), labelled.where("not grows")) if halves else (labelled, labelled)
    chosen = bounded_sample(grown, fit_rows, F.col("id"), seed=seed).select("quality", *COUNTS).collect()
    judge = Judge(IsolationForest(trees, sample, seed), BINS + 1, min_words)
    if chosen:
        quality, counts = np.split(np.array([tuple(r) for r in chosen], np.int64), [1], axis=1)
        judge.forest.weights = telling(features(counts), quality[:, 0])
        judge.forest.fit(features(counts), quality[:, 0] == 0)
        histogram = _scored(others.select("quality", *COUNTS), judge).groupBy(F.floor(F.col("score") * BINS).cast("int").alias("bin"), F.col("quality").cast("int").alias("quality")).count()
        judge.cut = threshold([tuple(r) for r in histogram.collect()], keep_good)
    return judge


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: float) -> DataFrame:
    """(id_col, the counts, base_failed, score, kept) of every row of ``docs``.

    base_failed: fewer than ``min_words`` words, or more than half of the words repeated. kept: not base_failed and not
    rejected by the forest. ``labels`` has id_col and quality (1 good, 0 bad; others are left out). By a hash of the id one half of
    the labelled rows that pass the base rules is for the trees, grown from at most ``fit_rows`` of them, which also say
    how telling each statistic is; the threshold counts all of the other half (where a half lacks good or bad rows, both steps take all), and keeps at least ``keep_good`` of its good rows,
    or all but one in a hundred where that makes fewer errors in all (see ``threshold``). Without such rows the forest rejects nothing. Null ids
    have no label; an id that is labelled twice counts with its best label. Rows with the same id are judged each; null text has
    no words and fails; an empty table gives an empty one, other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "quality")
    rows = ws.stage(rule_statistics(docs, id_col, text_col), "statistics")
    return _scored(rows, calibrate(rows, labels, ws, id_col, **settings)).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: float) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all their columns, without moving a text between tasks: once the judge is
    calibrated, each text's counts are taken again where it is read."""
    ws = Workspace(docs.sparkSession, "quality")
    rows = ws.stage(rule_statistics(docs, id_col, text_col), "statistics")
    found = calibrate(rows, labels, ws, id_col, **settings)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            counts = np.array([statistics(t or "") for t in b.column(at).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield b.filter(pa.array(found.verdict(counts)[2]))

    return docs.mapInArrow(run, docs.schema)
