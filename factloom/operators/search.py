"""Retrieval: BM25 top-k, title spans in claims, the merge of both, token overlap, and page recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import TOY_STOPWORDS, base_title, jaccard, normal_title, span_forms, starts_like_a_name, terms, token_set
from ..sources.staging import staged
from .index import Index, Stemmer, with_stems

MAX_TITLE_WORDS = 8
#: Bitmaps of 4 KB that a filter of titles has at most.
FILTER_BUCKETS = 4096
#: One of so many documents is scored first, for a bound under which no score is among the best.
SHARE = 32
#: Scores count to nine digits, so a bound may fall short by less.
SLACK = 1e-6


def query_terms(queries: DataFrame, id_col: str, text_col: str, stopwords: list[str] | None = None, stem: Stemmer | None = None) -> DataFrame:
    """(qid, term, qtf): repeats of a term in a query count."""
    found = queries.select(F.col(id_col).alias("qid"), F.explode(terms(F.col(text_col), stopwords)).alias("term"))
    return with_stems(found, stem).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(index: Index, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75, pairs: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, score) of documents that share a term with the query. Documents that share none have no row.

    idf = ln(1 + (n - df + 0.5) / (df + 0.5)); a term counts tf / (tf + k1 * (1 - b + b * dl / avgdl)). Queries pass through the
    analyzer that the index was built with. How many documents a term has is read from the index; the corpus statistics are one row.

    Postings are in buckets by document, so no score moves: the queries' weights are staged, and Spark, knowing their size, broadcasts few and
    merges many. With ``pairs`` (qid, doc_id), without repeats, only these are scored, and only they move.
    """
    weighted = _weights(index, queries, id_col, text_col)
    return _summed(index.postings if pairs is None else index.postings.join(pairs.select("qid", "doc_id"), "doc_id"), weighted, ["term"] if pairs is None else ["qid", "term"], k1, b)


def _weights(index: Index, queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(qid, term, w, avgdl), staged: what each term of a query weighs."""
    asked = query_terms(queries, id_col, text_col, index.stopwords, index.stem)
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = asked.join(index.terms.select("term", "df"), "term").crossJoin(F.broadcast(index.corpus))
    return staged(known.withColumn("w", F.col("qtf") * idf).select("qid", "term", "w", "avgdl"), "weights")


def _summed(postings: DataFrame, weighted: DataFrame, keys: list[str], k1: float, b: float) -> DataFrame:
    tf = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return postings.join(weighted, keys).groupBy("qid", "doc_id").agg(F.sum(F.col("w") * tf).alias("score"))


def best_k(index: Index, queries: DataFrame, k: int, id_col: str = "item_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The rows of ``top_k(bm25_scores(...), k)``, of which few are sorted.

    Sorting every score costs more than adding them up. The k-th best score among every ``SHARE``-th document is no higher than that among all, so
    what is below it is dropped where it was added up; a query for which that part has fewer than k documents keeps all.
    """
    weighted = _weights(index, queries, id_col, text_col)
    part = index.postings.where(F.pmod(F.xxhash64("doc_id"), F.lit(SHARE)) == 0)
    least = staged(kth_best(_summed(part, weighted, ["term"], k1, b), k), "least")
    near = _summed(index.postings, weighted, ["term"], k1, b).join(least, "qid", "left")
    return top_k(near.where(F.col("theta").isNull() | (F.col("score") >= F.col("theta") - SLACK)).select("qid", "doc_id", "score"), k)


def kth_best(scored: DataFrame, k: int) -> DataFrame:
    """(qid, theta): the k-th best of ``score``; queries with fewer rows have none."""
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))).where(F.col("r") <= k)
    return best.groupBy("qid").agg(F.min("score").alias("theta"), F.count("*").alias("m")).where(F.col("m") == k).select("qid", "theta")


def top_k(scored: DataFrame, k: int, group: str = "qid", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each group with their ``rank``; scores count to nine digits, ties go to the smaller id."""
    order = Window.partitionBy(group).orderBy(F.round("score", 9).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def titles(pages: DataFrame, id_col: str, title_col: str) -> DataFrame:
    """(doc_id, norm, base, disambig): normal forms of titles; base is without a disambiguator, null if there is none."""
    title = normal_title(F.col(title_col))
    return pages.select(F.col(id_col).alias("doc_id"), title.alias("norm"), base_title(title).alias("base"), F.endswith(title, F.lit("(disambiguation)")).alias("disambig"))


def spans(claims: DataFrame, id_col: str = "item_id", text_col: str = "text", any_case: bool = False, max_words: int = MAX_TITLE_WORDS) -> DataFrame:
    """(qid, i, j, form): word spans [i, j) that start like a name, in each form they are looked up in.

    ``any_case`` lets every word start a span.
    """
    words = F.filter(F.split(F.col(text_col), r"\s+"), lambda w: w != "")
    rows = claims.select(F.col(id_col).alias("qid"), words.alias("words")).where(F.size("words") > 0).select("qid", "words", F.posexplode("words").alias("i", "w"))
    if not any_case:
        rows = rows.where(starts_like_a_name(F.col("w")))
    rows = rows.select("qid", "i", "words", F.explode(F.sequence(F.col("i") + 1, F.least(F.col("i") + max_words, F.size("words")))).alias("j"))
    text = F.array_join(F.slice("words", F.col("i") + 1, F.col("j") - F.col("i")), " ")
    return rows.select("qid", "i", "j", F.posexplode(span_forms(text)).alias("form_no", "form"))


def known_forms(titles_: DataFrame, form: str = "form") -> DataFrame:
    """(bucket, bits): a Bloom filter of the forms as at most ``FILTER_BUCKETS`` bitmaps of 32,768 bits, however many forms there are."""
    hashed = titles_.where(F.col(form).isNotNull()).select(F.explode(F.array(*_places(F.col(form)))).alias("h"))
    return hashed.groupBy(F.call_function("bitmap_bucket_number", F.col("h")).alias("bucket")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("h"))).alias("bits"))


def _places(form: Column) -> list[Column]:
    """Two places of a form in the filter, counted from one."""
    size = FILTER_BUCKETS * 32768
    return [F.pmod(F.xxhash64(F.lit(seed), form), F.lit(size)) + 1 for seed in (1, 2)]


def maybe_known(found: DataFrame, filter_: DataFrame, form: str = "form") -> DataFrame:
    """The rows whose form may be in the filter; all that are in it, and few others. The filter is broadcast, 16 MB at most, and no row is shuffled."""
    columns = found.columns
    for n, place in enumerate(_places(F.col(form))):
        bits = F.broadcast(filter_.select(F.col("bucket").alias(f"__bucket{n}"), F.col("bits").alias(f"__bits{n}")))
        position = F.call_function("bitmap_bit_position", place)
        byte = F.conv(F.hex(F.substring(F.col(f"__bits{n}"), F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = found.withColumn(f"__place{n}", F.call_function("bitmap_bucket_number", place)).join(bits, F.col(f"__place{n}") == F.col(f"__bucket{n}"))
        found = found.where(F.call_function("getbit", byte, F.pmod(position, F.lit(8)).cast("int")) == 1).select(*columns)
    return found


def title_matches(found: DataFrame, table: DataFrame, longest_only: bool = True) -> DataFrame:
    """(qid, i, j, doc_id, grp, match_pos): titles that spans match; grp 0 is the title itself, 1 a title that has a disambiguator more.

    A filter of all titles drops nearly all spans where they are read; only what may match is shuffled.

    A title of several documents matches as the one with the smallest id. Disambiguation pages make a span count as matched
    but aren't returned. With ``longest_only`` only the longest span of each start stands, and a span inside another is dropped.
    """
    exact = table.groupBy(F.col("norm").alias("form")).agg(F.min(F.struct("doc_id", "disambig")).alias("d")).select("form", "d.doc_id", "d.disambig")
    variant = table.where("base is not null and not disambig").select(F.col("base").alias("form"), "doc_id", F.lit(False).alias("disambig"))
    both = exact.withColumn("grp", F.lit(0)).unionByName(variant.withColumn("grp", F.lit(1)))
    hits = maybe_known(found, known_forms(both)).join(both, "form")
    if longest_only:
        best = hits.groupBy("qid", "i").agg(F.max("j").alias("j"))
        o = best.select(F.col("qid").alias("oq"), F.col("i").alias("oi"), F.col("j").alias("oj"))
        inside = (F.col("oq") == F.col("qid")) & (F.col("oi") <= F.col("i")) & (F.col("j") <= F.col("oj")) & ((F.col("oi") != F.col("i")) | (F.col("oj") != F.col("j")))
        hits = hits.join(best.join(o, inside, "left_anti"), ["qid", "i", "j"])
    place = Window.partitionBy("qid", "grp").orderBy("i", F.col("j").desc(), "form_no", "doc_id")
    return hits.withColumn("match_pos", F.row_number().over(place)).where("not disambig").select("qid", "i", "j", "doc_id", "grp", "match_pos")


def matched_pages(matches: DataFrame) -> DataFrame:
    """(qid, doc_id, grp, match_pos): each matched page once, as its best match."""
    return matches.groupBy("qid", "doc_id").agg(F.min(F.struct("grp", "match_pos")).alias("m")).select("qid", "doc_id", "m.grp", "m.match_pos")


def search_with_titles(once: DataFrame, scores: DataFrame, best: DataFrame, k: int = 5, max_title: int = 3) -> DataFrame:
    """(qid, rank, doc_id): up to ``max_title`` matched titles, exact ones first, each group by score, then the best by BM25, each document once.

    ``once`` has the matched pages, ``scores`` the scores of these, ``best`` the ``top_k`` of all documents."""
    ranked = once.join(scores, ["qid", "doc_id"], "left").withColumn("t", F.row_number().over(Window.partitionBy("qid").orderBy("grp", F.round(F.coalesce("score", F.lit(0.0)), 9).desc(), "match_pos", "doc_id")))
    first = ranked.where(F.col("t") <= max_title).select("qid", "doc_id", F.col("t").alias("prio"))
    rest = best.where(F.col("rank") <= k).select("qid", "doc_id", (F.col("rank") + max_title).alias("prio"))
    merged = first.unionByName(rest).groupBy("qid", "doc_id").agg(F.min("prio").alias("prio"))
    merged = merged.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("prio")))
    return merged.where(F.col("rank") <= k).select("qid", "rank", "doc_id")


def recall_at_k(ranked: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """(k, recall, n): share of queries with a gold set whose pages are all among the first k.

    ``ranked`` has (qid, rank, doc_id); ``gold`` has (qid, sets), sets an array of arrays of ids. Queries without sets are left out.
    """
    lists = ranked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("pages"))
    rows = gold.where(F.size("sets") > 0).join(lists, "qid", "left").select("sets", F.transform("pages", lambda p: p["doc_id"]).alias("pages"), F.explode(F.array(*map(F.lit, ks))).alias("k"))
    top = F.slice(F.coalesce("pages", F.array().cast(rows.schema["pages"].dataType)), 1, F.col("k"))
    hit = F.exists("sets", lambda s: F.size(F.array_except(s, top)) == 0)
    return rows.groupBy("k").agg(F.avg(hit.cast("double")).alias("recall"), F.count("*").alias("n"))


def mean_overlap(sets: Column) -> Column:
    """Mean Jaccard overlap over unordered pairs of an array of token sets; 0 with fewer than two."""
    pairs = F.flatten(F.transform(sets, lambda a, i: F.transform(F.slice(sets, i + 2, F.greatest(F.size(sets) - i - 1, F.lit(0))), lambda b: jaccard(a, b))))
    return F.when(F.size(pairs) > 0, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(pairs)).otherwise(F.lit(0.0))


def agreement(evidence: Column, stopwords: list[str] | None = None) -> Column:
    """The mean overlap of an array of texts."""
    return mean_overlap(F.transform(evidence, lambda e: token_set(e, stopwords)))


def not_shown(results: DataFrame, shown: DataFrame, *keys: str) -> DataFrame:
    """Results of a further search without what the same query was shown before."""
    return results.join(shown.select(*keys).distinct(), list(keys), "left_anti")


def register_search(spark: SparkSession, name: str, sentences: DataFrame, k: int = 5) -> None:
    """A SQL table function ``name(query) -> (sid, text, score)`` over a table (sid, text): the k best by token overlap, of equal scores the smaller sid.

    Its body is SQL over a temporary view, so it plans like any query. Names are plain identifiers.
    """
    if not name.isidentifier():
        raise ValueError("a plain identifier is needed")
    sentences.select("sid", "text", token_set(F.col("text")).alias("tokens")).createOrReplaceTempView(f"{name}_sentences")
    stop = ", ".join("'" + w.replace("'", "\\'") + "'" for w in TOY_STOPWORDS)
    asked = rf"""array_except(array_distinct(transform(filter(split({name}.query, '\\s+'), w -> w <> ''), w -> lower(regexp_replace(w, '^[.,]+|[.,]+$', '')))), array({stop}))"""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(query STRING) RETURNS TABLE (sid STRING, text STRING, score DOUBLE) RETURN
        SELECT sid, text, score FROM (SELECT sid, text, size(array_intersect(tokens, q)) / greatest(size(array_union(tokens, q)), 1) AS score
          FROM (SELECT sid, text, tokens, {asked} AS q FROM {name}_sentences)) WHERE score > 0 ORDER BY score DESC, sid LIMIT {k}""")
