"""The best k documents by BM25 without scoring every posting: block maxima and a threshold.

A term's postings are stored by level of impact, each level with its highest impact. A document that none of the opened levels
has can score no more than the tops of those still closed, and one that some have no more than its part so far and those
of its other terms. Levels are opened in the order of what they take from that bound for each posting read, until the bound falls under
a share of a threshold, the k-th best of some exact scores; then only documents that have been seen can be among the best, and of these only
those whose own bound reaches the threshold are scored in full. Postings are in buckets by document, so sums are made and judged where they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import staged, unstage
from .index import Index, term_levels
from .search import SLACK, kth_best, query_terms, top_k

#: The share of the threshold that the bound of closed levels is brought under.
SHARE = 0.5
#: Postings of a query that give the first threshold, at least so many and for each document so many, and documents that are scored for it, times k.
FIRST, FIRST_SHARE, TRIED = 3000, 0.3, 16


@dataclass
class Pruned:
    """``rows`` are those of ``top_k``; ``read`` says for each step how many postings met a query, ``all_postings`` how many all terms have."""

    rows: DataFrame
    read: list[int]
    all_postings: int


def plan(index: Index, queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(qid, term, bit, w, level, n, gain, rest, bound, seen): the levels of a query's terms in the order they are opened.

    ``bound`` is that of a document in none of the levels before, ``rest`` what the term can still count once this level is open, ``seen`` the
    postings up to here. The first 63 terms by weight have a bit of their own, the others none: their rest is never taken off a bound.
    """
    asked = query_terms(queries, id_col, text_col, index.stopwords, index.stem)
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    levels = term_levels(index.levels.join(asked.select("term").distinct(), "term", "left_semi"))
    asked = asked.join(levels, "term").crossJoin(F.broadcast(index.corpus)).select("qid", "term", (F.col("qtf") * idf).alias("w"), "levels")
    number = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("w"), "term")) - 1
    rows = asked.withColumn("no", number).select("qid", "term", "no", "w", F.inline("levels"))
    rows = rows.withColumn("bit", F.when(F.col("no") < 63, F.expr("shiftleft(1L, no)")).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumns({"gain": F.col("w") * (F.col("top") - F.col("next")), "rest": F.col("w") * F.col("next"), "worth": F.col("w") * F.col("worth"), "first": F.col("w") * F.col("top")})
    order = Window.partitionBy("qid").orderBy(F.desc("worth"), "term", "level")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.sum("gain").over(Window.partitionBy("qid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumns({"bound": whole - F.sum("gain").over(upto) + F.col("gain"), "seen": F.sum("n").over(upto)})
    return rows.select("qid", "term", "no", "bit", "w", "level", "n", "gain", "rest", "first", "bound", "seen")


def pruned_top_k(index: Index, queries: DataFrame, k: int, id_col: str = "item_id", text_col: str = "text") -> Pruned:
    """(qid, doc_id, score, rank) of the k best documents of each query, the same rows as ``top_k(bm25_scores(...), k)``.

    k1 and b are those the index was built with. Levels and candidates are staged, so Spark knows their sizes and broadcasts only small ones.
    Queries that fewer than k documents share a term with read all their postings. A null text has no rows.
    """
    stage = lambda df, name: staged(df, f"pruned-{name}")
    levels = stage(plan(index, queries, id_col, text_col), "levels")
    entries = index.postings.select("term", "level", "doc_id", "impact")
    hits = lambda opened: entries.join(opened, ["term", "level"])
    summed = lambda rows: rows.groupBy("qid", "doc_id").agg(F.sum(F.col("w") * F.col("impact")).alias("score"), F.bit_or("bit").alias("mask"), F.count("*").alias("hits"))

    # The first threshold: exact scores of the best of a few postings.
    enough = max(FIRST, FIRST_SHARE * index.corpus.first()["n"])
    first = stage(levels.where(F.col("seen") - F.col("n") < enough), "first")
    tried = top_k(summed(hits(first)), TRIED * k)
    tried = stage(tried.select("qid", "doc_id", "hits"), "tried")
    terms = stage(levels.select("qid", "term", "w", "bit").distinct(), "terms")
    of = lambda pairs: entries.join(pairs.select("qid", "doc_id"), "doc_id").join(terms, ["qid", "term"])
    exact = stage(summed(of(tried)), "exact")
    theta = stage(kth_best(exact, k), "theta")
    total = lambda t: t.agg(F.sum("hits")).first()[0] or 0
    read = [total(tried), total(exact)]
    unstage(first, tried, exact)

    # Levels are opened until a document in none of them can't reach a share of the threshold.
    known = levels.select("qid").distinct().join(theta, "qid", "left").select("qid", F.coalesce("theta", F.lit(0.0)).alias("theta"))
    near = stage(levels.join(known, "qid").withColumn("open", F.col("bound") >= F.col("theta") * SHARE - SLACK), "near")
    opened = stage(near.where("open").select("qid", "term", "level", "w", "bit"), "opened")
    read.append(near.where("open").agg(F.sum("n")).first()[0] or 0)
    # What each term can still count: that of the last of its levels that is open, or of its first if none is.
    rests = near.groupBy("qid", "theta", "no").agg(F.coalesce(F.min(F.when(F.col("open"), F.col("rest"))), F.max("first")).alias("rest"))
    rests = rests.groupBy("qid", "theta").agg(F.sum("rest").alias("all"), F.transform(F.array_sort(F.collect_list(F.struct("no", "rest"))), lambda x: x["rest"]).alias("rest"))
    taken = F.aggregate(F.sequence(F.lit(0), F.least(F.size("rest"), F.lit(63)) - 1), F.lit(0.0), lambda s, i: s + F.when(F.call_function("getbit", F.col("mask"), i) == 1, F.get("rest", i)).otherwise(0.0))
    # Judged where it was added up: what can't reach the threshold is never written.
    judged = summed(hits(opened)).join(stage(rests, "rests"), "qid").where(F.col("score") + F.col("all") - taken >= F.col("theta") - SLACK)
    found = stage(judged.select("qid", "doc_id"), "found")
    whole = stage(summed(of(found)), "whole")
    read.append(total(whole))
    all_postings = levels.agg(F.sum("n")).first()[0] or 0
    unstage(levels, terms, theta, near, opened, found)
    return Pruned(top_k(whole.select("qid", "doc_id", "score"), k), read, all_postings)
