"""Evidence contexts: sentences of retrieved pages, numbered, with coverage flags; oracle and ablated variants; prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import covers, smallest
from ..functions.text import seeded

MAX_SENTENCES = 20


def with_sentences(ranked: DataFrame, pages: DataFrame, per_page: int = MAX_SENTENCES, key: str = "doc_id") -> DataFrame:
    """(qid, rank, key, line, text, pos) of the first ``per_page`` stored sentences of each retrieved page.

    ``pages`` has (key, sentences: array of (line, text)); a page it doesn't hold gives no rows. The cut is by stored order.
    From an explode that drops empty arrays Spark makes a filter on them, which would decode every page before the join; the outer one has none.
    """
    cut = pages.select(key, F.slice("sentences", 1, per_page).alias("sentences"))
    each = ranked.join(cut, key).select("qid", "rank", key, F.posexplode_outer("sentences").alias("pos", "s")).where("pos is not null")
    return each.select("qid", "rank", key, "s.line", "s.text", "pos")


def contexts(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(qid, shown): per query the array of (eid, page, line, text), numbered E1, E2, ... over pages in rank order and sentences in page order."""
    items = F.array_sort(F.collect_list(F.struct("rank", "pos", F.col(key).cast("string").alias("page"), "line", "text")))
    number = lambda s, i: F.struct(F.concat(F.lit("E"), (i + 1).cast("string")).alias("eid"), s["page"].alias("page"), s["line"].alias("line"), s["text"].alias("text"))
    return rows.groupBy("qid").agg(items.alias("items")).select("qid", F.transform("items", number).alias("shown"))


def coverage(context: DataFrame, gold: DataFrame, pages: DataFrame) -> DataFrame:
    """``gold`` (qid, sets of (page, line)) with shown, gold_page_retrieved and gold_in_context; both are null without a set.

    ``pages`` has (qid, pages): the ids that were retrieved.
    """
    rows = gold.join(context, "qid", "left").join(pages, "qid", "left")
    keys = F.transform("shown", lambda s: F.struct(s["page"].alias("page"), s["line"].alias("line")))
    keys = F.coalesce(keys, F.expr("cast(array() as array<struct<page:string,line:int>>)"))
    retrieved = F.coalesce(F.col("pages"), F.array().cast("array<string>"))
    needed = F.transform("sets", lambda s: F.transform(s, lambda e: e["page"]))
    return rows.withColumn("gold_page_retrieved", covers(needed, retrieved)).withColumn("gold_in_context", covers(F.col("sets"), keys)).drop("pages")


def oracle_pages(sets: Column, retrieved: Column, claim_id: Column, seed: int | str, k: int = 5) -> Column:
    """The pages of the smallest gold set, by name, then retrieved ones, k in all, in an order seeded by the claim."""
    gold = F.when(F.size(sets) > 0, F.array_sort(F.array_distinct(F.transform(smallest(sets), lambda e: e["page"])))).otherwise(F.array().cast("array<string>"))
    chosen = F.slice(F.array_distinct(F.concat(gold, retrieved)), 1, k)
    return F.transform(F.array_sort(F.transform(chosen, lambda p: F.struct(seeded(seed, claim_id, p).alias("o"), p.alias("p")))), lambda s: s["p"])


def without_pages(retrieved: Column, gold_pages: Column, k: int = 5) -> Column:
    """Retrieved pages that aren't gold, refilled to k from those beyond."""
    return F.slice(F.filter(F.array_distinct(retrieved), lambda p: ~F.array_contains(gold_pages, p)), 1, k)


def without_sentences(rows: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sentence rows without gold ones; ``gold`` has (qid, key, line)."""
    return rows.join(gold, ["qid", key, "line"], "left_anti")


def render(claim: Column, shown: Column) -> Column:
    """The prompt: the claim, a blank line, a heading, and a line for each sentence."""
    lines = F.transform(shown, lambda s: F.concat(s["eid"], F.lit(" ["), F.replace(s["page"], F.lit("_"), F.lit(" ")), F.lit("] "), s["text"]))
    return F.concat(F.lit("Claim: "), claim, F.lit("\n\nEvidence:\n"), F.array_join(lines, "\n"))


def claim_of(prompt: Column) -> Column:
    return F.trim(F.replace(F.split(prompt, "\n")[0], F.lit("Claim: "), F.lit("")))
