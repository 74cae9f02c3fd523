"""The k sentences of most token overlap for each query, by a prefix-filtered set-similarity join.

A query's tokens are put in order, the rarest among the sentences first. A set with a Jaccard overlap of t or more shares one of the first
n - ceil(t * n) + 1 of them, so the most frequent tokens of a query are not looked up at all, and only in sets whose size allows that overlap. How
high t is for a query is told by a first, cheap round over its rarest tokens: the k-th best overlap found there. The number of
prefix tokens that a pair shares bounds what it can share in all; what is left is counted exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import token_set
from ..sources.staging import staged, unstage
from .search import top_k

#: Rarest tokens of a query that the first round takes, and sentences that it counts exactly, times k.
SEEDS, TRIED = 6, 8
_SLACK = 1e-9


@dataclass
class Overlap:
    """``rows`` as of ``overlap_top_k``; ``candidates`` the pairs (qid, sid) that were counted exactly, ``scored`` those with their overlap."""

    rows: DataFrame
    candidates: DataFrame
    scored: DataFrame


def overlaps(queries: DataFrame, sentences: DataFrame, k: int, qid: str, q_text: str, sid: str, s_text: str, stopwords: list[str] | None = None) -> Overlap:
    """(qid, sid, score, rank) of the k sentences of highest Jaccard overlap that share a token with the query; ties go to the smaller sid.

    A query that shares its rarest tokens with fewer than k sentences is paired on all its tokens. Sets without a token, of null texts too,
    have no rows. Of the sentences only tokens that some query has are kept, with the size of their set; what is staged has a size that Spark
    knows, so it broadcasts the small side. Ids are unique on each side.
    """
    side = lambda t, i, x, name, n: t.select(F.col(i).alias(name), token_set(F.col(x), stopwords).alias("s")).select(name, F.size("s").alias(n), F.explode("s").alias("t"))
    asked = staged(side(queries, qid, q_text, "qid", "nq"), "overlap-asked")
    s = staged(side(sentences, sid, s_text, "sid", "ns").join(asked.select("t").distinct(), "t", "left_semi"), "overlap-s")
    order = s.groupBy("t").agg(F.count("*").alias("df"))
    place = Window.partitionBy("qid").orderBy(F.coalesce("df", F.lit(0)), "t")
    q = staged(asked.join(order, "t", "left").select("qid", "nq", "t", (F.row_number().over(place) - 1).alias("i")), "overlap-q")

    def exact(pairs: DataFrame) -> DataFrame:
        shared = pairs.select("qid", "sid").join(q, "qid").join(s, ["sid", "t"]).groupBy("qid", "sid").agg(F.count("*").alias("c"), F.first("nq").alias("nq"), F.first("ns").alias("ns"))
        return shared.select("qid", "sid", (F.col("c") / (F.col("nq") + F.col("ns") - F.col("c"))).alias("score"))

    # The first round: small sets that share the most of a query's rarest tokens.
    seeds = q.where(F.col("i") < SEEDS).join(s, "t").groupBy("qid", "sid").agg((F.count("*") / F.first("ns")).alias("score"))
    tried = staged(top_k(seeds, TRIED * k, "qid", "sid"), "overlap-tried")
    best = top_k(exact(tried), k, "qid", "sid").groupBy("qid").agg(F.when(F.count("*") == k, F.min("score")).alias("theta"))
    known = staged(asked.select("qid", "nq").distinct().join(best, "qid", "left").select("qid", F.coalesce("theta", F.lit(0.0)).alias("theta")), "overlap-theta")
    unstage(tried, asked)

    theta, nq, ns = F.col("theta"), F.col("nq"), F.col("ns")
    rest = F.greatest(F.ceil(theta * nq - _SLACK) - 1, F.lit(0))
    near = q.join(known, "qid").withColumn("rest", rest).where(F.col("i") < nq - F.col("rest"))
    met = near.join(s, "t").where((ns >= theta * nq - _SLACK) & (ns * theta <= nq + _SLACK))
    pairs = met.groupBy("qid", "sid").agg(F.count("*").alias("c"), *[F.first(c).alias(c) for c in ("nq", "ns", "theta", "rest")])
    pairs = staged(pairs.where(F.col("c") + F.col("rest") >= theta / (1 + theta) * (nq + ns) - _SLACK).select("qid", "sid"), "overlap-pairs")
    unstage(known)
    scored = exact(pairs)
    return Overlap(top_k(scored, k, "qid", "sid"), pairs, scored)


def scored_pairs(queries: DataFrame, sentences: DataFrame, k: int, qid: str, q_text: str, sid: str, s_text: str, stopwords: list[str] | None = None) -> DataFrame:
    """(qid, sid, score) of the pairs among which the k best of each query are, scores to nine digits."""
    found = overlaps(queries, sentences, k, qid, q_text, sid, s_text, stopwords)
    return found.scored.select("qid", "sid", F.round("score", 9).alias("score"))


def overlap_top_k(queries: DataFrame, sentences: DataFrame, k: int, qid: str, q_text: str, sid: str, s_text: str, stopwords: list[str] | None = None) -> DataFrame:
    return overlaps(queries, sentences, k, qid, q_text, sid, s_text, stopwords).rows
