"""Every query of the engine over the driver's tables, and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence, labels, parsing, reward, text
from ..functions.stemming import english_stem
from ..operators import context, datasets, episodes, inference, metrics, overlap, pruned, search, tablefunctions, traces
from ..operators import index as ix
from ..sources import io
from ..sources.staging import shared_folder, ship, staged
from ..streaming import events as streams
from ..streaming import resume
from . import views
from .stemming_sql import stems_sql
from .views import table

QUERIES = {}
ORACLE_SQL = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- index and retrieval ---------------------------------------------------------------------------------------------
_TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
_BM25 = rf"""tok AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, len({_TERMS}) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sc AS (SELECT qid, doc_id, sum(qtf * ln(1.0::double + (n - df + 0.5::double) / (df + 0.5::double)) * (tf / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl)))) AS score
  FROM qt JOIN post USING (term) JOIN dfs USING (term) JOIN dl USING (doc_id), st GROUP BY qid, doc_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)"""


def _top(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return search.best_k(views.index(spark, sf_dir), table(spark, sf_dir, "benchmark"), k)


def _best(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k best documents of each claim as a table, for queries that need them more than once or to pick documents by."""
    return staged(_top(spark, sf_dir, k), "best")


@_query(f"WITH {_BM25} SELECT qid AS item_id, rank::int AS rank, doc_id, round(score, 6) AS score FROM rk WHERE rank <= 5")
def bm25_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 5).select(F.col("qid").alias("item_id"), "rank", "doc_id", F.round("score", 6).alias("score"))


_STOPS = ", ".join(f"'{w}'" for w in text.ENGLISH_STOPWORDS)
_KEPT = f"list_filter({_TERMS}, lambda t: t NOT IN ({_STOPS}))"
_STEMS = f"""kt AS (SELECT doc_id, unnest({_KEPT}) AS t FROM documents), kq AS (SELECT item_id AS qid, unnest({_KEPT}) AS t FROM benchmark),
ky AS (SELECT DISTINCT t FROM kt UNION SELECT DISTINCT t FROM kq), {stems_sql("ky")}"""
_STEMMED = f"{_STEMS}, " + _BM25.replace(f"SELECT doc_id, unnest({_TERMS}) AS term FROM documents", "SELECT doc_id, stem AS term FROM kt JOIN stems USING (t)").replace(f"SELECT item_id AS qid, unnest({_TERMS}) AS term FROM benchmark", "SELECT qid, stem AS term FROM kq JOIN stems USING (t)").replace(f"len({_TERMS})", f"len({_KEPT})")


@_query(f"WITH {_STEMMED} SELECT qid AS item_id, rank::int AS rank, doc_id, round(score, 6) AS score FROM rk WHERE rank <= 5")
def bm25_stemmed_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = search.best_k(views.index(spark, sf_dir, english=True), table(spark, sf_dir, "benchmark"), 5)
    return best.select(F.col("qid").alias("item_id"), "rank", "doc_id", F.round("score", 6).alias("score"))


@_query(f"WITH {_BM25} SELECT qid AS item_id, rank::int AS rank, doc_id, round(score, 6) AS score FROM rk WHERE rank <= 5")
def bm25_pruned_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``bm25_top5``, by a part of the postings."""
    best = pruned.pruned_top_k(views.index(spark, sf_dir), table(spark, sf_dir, "benchmark"), 5).rows
    return best.select(F.col("qid").alias("item_id"), "rank", "doc_id", F.round("score", 6).alias("score"))


@_query(f"WITH {_STEMS} SELECT t AS term, stem FROM stems WHERE t IN (SELECT t FROM kt)")
def english_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each term of the documents that is no stopword, with its stem."""
    ship(spark)
    found = table(spark, sf_dir, "documents").select(F.explode(text.terms(F.col("text"), text.ENGLISH_STOPWORDS)).alias("term")).distinct()
    return found.select("term", text.stemmed(F.col("term"), english_stem).alias("stem"))


@_query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY term")
def corpus_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.term_stats(ix.postings(table(spark, sf_dir, "documents")))


@_query(f"SELECT doc_id, len({_TERMS})::int AS dl FROM documents")
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.doc_stats(table(spark, sf_dir, "documents"))


_SENTENCES = r"""sn AS (SELECT doc_id, i::int AS line, split_part(parts[i + 1], chr(9), 1) AS text FROM
 (SELECT doc_id, parts, unnest(range(0, len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
 WHERE trim(regexp_replace(split_part(parts[i + 1], chr(9), 1), '\s+', ' ', 'g')) <> ''),
so AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS pos FROM sn)"""


@_query(f"WITH {_SENTENCES} SELECT doc_id, line, text FROM sn")
def sentence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sentences(table(spark, sf_dir, "documents")).select("doc_id", F.explode("sentences").alias("s")).select("doc_id", "s.line", "s.text")


@_query(f"WITH {_SENTENCES} SELECT doc_id, count(*) AS n, max(line) AS last_line, string_agg(text, '|' ORDER BY line) AS shown FROM so WHERE pos < 20 GROUP BY doc_id")
def first_20_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = views.sentences(table(spark, sf_dir, "documents")).select("doc_id", F.slice("sentences", 1, 20).alias("s")).where(F.size("s") > 0)
    return cut.select("doc_id", F.size("s").cast("long").alias("n"), F.array_max(F.transform("s", lambda x: x["line"])).alias("last_line"), F.array_join(F.transform("s", lambda x: x["text"]), "|").alias("shown"))


def _shown(spark: SparkSession, sf_dir: str, best: DataFrame | None = None) -> DataFrame:
    """The sentences of each claim's five best documents. Only these documents are decoded, and none moves."""
    best = _best(spark, sf_dir, 5) if best is None else best
    docs = table(spark, sf_dir, "documents").join(best.select("doc_id").distinct(), "doc_id", "left_semi")
    return staged(context.with_sentences(best, views.sentences(docs)), "shown")


_SHOWN = f"""{_BM25}, {_SENTENCES},
sh AS (SELECT qid, rank, doc_id, line, text, row_number() OVER (PARTITION BY qid ORDER BY rank, pos) AS n FROM rk JOIN so USING (doc_id) WHERE rank <= 5 AND pos < 20)"""


@_query(f"WITH {_SHOWN} SELECT qid AS item_id, 'E' || n AS eid, doc_id::varchar AS page, line, text FROM sh")
def evidence_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context.contexts(_shown(spark, sf_dir))
    return rows.select(F.col("qid").alias("item_id"), F.explode("shown").alias("s")).select("item_id", "s.*")


@_query(f"""WITH {_SHOWN} SELECT item_id, sha256('Claim: ' || any_value(b.text) || chr(10) || chr(10) || 'Evidence:' || chr(10) || string_agg('E' || n || ' [' || doc_id || '] ' || sh.text, chr(10) ORDER BY n)) AS prompt_sha256, count(*)::int AS n_shown
FROM benchmark b JOIN sh ON sh.qid = b.item_id GROUP BY item_id""")
def render_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context.contexts(_shown(spark, sf_dir)).join(table(spark, sf_dir, "benchmark"), F.col("qid") == F.col("item_id"))
    return rows.select("item_id", F.sha2(context.render(F.col("text"), F.col("shown")), 256).alias("prompt_sha256"), F.size("shown").alias("n_shown"))


_TITLES = r"""tt AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN w || ' (' || lang || ')' ELSE w END AS title FROM
  (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')[1] AS w FROM documents)
 UNION ALL SELECT 1000000000 + item_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')[1:2], ' ') FROM benchmark),
tn AS (SELECT doc_id, lower(replace(title, '_', ' ')) AS norm FROM tt WHERE title <> ''),
tb AS (SELECT doc_id, norm, CASE WHEN regexp_matches(norm, '(?s)^(.*) \([^()]*\)$') THEN regexp_extract(norm, '(?s)^(.*) \([^()]*\)$', 1) END AS base FROM tn),
wd AS (SELECT item_id AS qid, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM benchmark),
s1 AS (SELECT qid, ws, unnest(range(0, len(ws))) AS i FROM wd),
s2 AS (SELECT qid, ws, i, unnest(range(i + 1, least(i + 8, len(ws)) + 1)) AS j FROM s1),
s3 AS (SELECT qid, i, j, array_to_string(ws[i + 1:j], ' ') AS s FROM s2),
s4 AS (SELECT qid, i, j, unnest([{'k': 0, 'f': s}, {'k': 1, 'f': rtrim(s, ',.;:!?"')}, {'k': 2, 'f': regexp_replace(rtrim(s, ',.;:!?"'), '''s$', '')}]) AS x FROM s3),
fm AS (SELECT qid, i, j, lower(replace(x.f, '_', ' ')) AS form, min(x.k) AS k FROM s4 GROUP BY ALL),
ex AS (SELECT norm AS form, min(doc_id) AS doc_id, 0 AS grp FROM tb GROUP BY norm UNION ALL SELECT base, doc_id, 1 FROM tb WHERE base IS NOT NULL),
ht AS (SELECT fm.*, ex.doc_id, ex.grp FROM fm JOIN ex USING (form)),
b1 AS (SELECT qid, i, max(j) AS j FROM ht GROUP BY ALL),
b2 AS (SELECT * FROM b1 s WHERE NOT EXISTS (SELECT 1 FROM b1 o WHERE o.qid = s.qid AND o.i <= s.i AND s.j <= o.j AND (o.i <> s.i OR o.j <> s.j))),
mt AS (SELECT ht.*, row_number() OVER (PARTITION BY qid, grp ORDER BY i, j DESC, k, doc_id) AS pos FROM ht JOIN b2 USING (qid, i, j))"""


def _matches(spark: SparkSession, sf_dir: str, longest_only: bool = True, any_case: bool = True) -> DataFrame:
    docs, claims = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return search.title_matches(search.spans(claims, any_case=any_case), search.titles(views.title_table(docs, claims), "doc_id", "title"), longest_only)


@_query(f"WITH {_TITLES} SELECT DISTINCT qid AS item_id, i::int AS i, j::int AS j, doc_id, grp FROM mt")
def title_spans_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select(F.col("qid").alias("item_id"), "i", "j", "doc_id", "grp").distinct()


_CAPITAL = _TITLES.replace("least(i + 8, len(ws)) + 1)) AS j FROM s1)", r"least(i + 8, len(ws)) + 1)) AS j FROM s1 WHERE regexp_matches(ws[i + 1], '^[\p{Lu}\p{Nd}]'))")


@_query(f"WITH {_CAPITAL} SELECT DISTINCT qid AS item_id, i::int AS i, j::int AS j, doc_id, grp FROM mt")
def title_spans_capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, any_case=False).select(F.col("qid").alias("item_id"), "i", "j", "doc_id", "grp").distinct()


@_query(f"WITH {_TITLES} SELECT DISTINCT qid AS item_id, i::int AS i, j::int AS j, doc_id, grp FROM ht")
def title_spans_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, False).select(F.col("qid").alias("item_id"), "i", "j", "doc_id", "grp").distinct()


@_query(f"""WITH {_BM25}, {_TITLES},
m1 AS (SELECT qid, doc_id, min({{'grp': grp, 'pos': pos}}) AS m FROM mt GROUP BY ALL),
m2 AS (SELECT m1.*, row_number() OVER (PARTITION BY qid ORDER BY m.grp, round(coalesce(score, 0), 9) DESC, m.pos, doc_id) AS t FROM m1 LEFT JOIN sc USING (qid, doc_id)),
un AS (SELECT qid, doc_id, min(p) AS p FROM (SELECT qid, doc_id, t AS p FROM m2 WHERE t <= 3 UNION ALL SELECT qid, doc_id, rank + 3 FROM rk WHERE rank <= 5) GROUP BY ALL),
fin AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY p) AS rank FROM un)
SELECT qid AS item_id, rank::int AS rank, doc_id FROM fin WHERE rank <= 5""")
def search_with_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = staged(search.matched_pages(_matches(spark, sf_dir)), "matched")
    of_matched = search.bm25_scores(views.index(spark, sf_dir), table(spark, sf_dir, "benchmark"), pairs=once)
    return search.search_with_titles(once, of_matched, _top(spark, sf_dir, 5)).withColumnRenamed("qid", "item_id")


@_query(f"""WITH {_BM25}, gp AS (SELECT b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
q AS (SELECT DISTINCT qid FROM gp), ks AS (SELECT unnest([1, 3, 5, 10]) AS k)
SELECT k, avg((EXISTS (SELECT 1 FROM gp JOIN rk USING (qid, doc_id) WHERE gp.qid = q.qid AND rk.rank <= ks.k))::int) AS recall, count(*) AS n FROM q, ks GROUP BY k""")
def page_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = views.gold_pages(views.index(spark, sf_dir), table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).groupBy("qid").agg(F.collect_list(F.array("doc_id")).alias("sets"))
    return search.recall_at_k(_top(spark, sf_dir, 10), gold, [1, 3, 5, 10])


_TOKENS = "list_filter(list_distinct(list_transform(list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> ''), lambda x: lower(regexp_replace(x, '^[.,]+|[.,]+$', '', 'g')))), lambda x: NOT list_contains([" + ", ".join(f"'{w}'" for w in text.TOY_STOPWORDS) + "], x))"


@_query(f"""WITH q AS (SELECT item_id, {_TOKENS.format("text")} AS s FROM benchmark), d AS (SELECT doc_id, {_TOKENS.format("text")} AS s FROM documents),
c AS (SELECT item_id, doc_id, len(list_intersect(q.s, d.s)) AS c, len(q.s) AS a, len(d.s) AS b FROM q, d),
r AS (SELECT item_id, doc_id, c / (a + b - c)::double AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(c / (a + b - c)::double, 9) DESC, doc_id) AS rank FROM c WHERE c > 0)
SELECT item_id, doc_id, round(score, 9) AS score, rank::int AS rank FROM r WHERE rank <= 3""")
def jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlap.overlap_top_k(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 3, "item_id", "text", "doc_id", "text")
    return found.select(F.col("qid").alias("item_id"), F.col("sid").alias("doc_id"), F.round("score", 9).alias("score"), "rank")


@_query(ORACLE_SQL["jaccard_topk"])
def sql_jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``jaccard_topk`` by a table function in SQL over the pairs that the prefix filter leaves."""
    tablefunctions.register(spark)
    pairs = overlap.scored_pairs(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 3, "item_id", "text", "doc_id", "text")
    return spark.sql("SELECT qid AS item_id, sid AS doc_id, score, rank FROM best_rows(TABLE({pairs}), 3)", pairs=pairs)


@_query(f"WITH {_CAPITAL} SELECT DISTINCT qid AS item_id, i::int AS i, j::int AS j, form FROM fm")
def sql_claim_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tablefunctions.register(spark)
    return spark.sql("SELECT q.item_id, s.i, s.j, s.form FROM {claims} q, LATERAL claim_spans(q.text, false) s", claims=table(spark, sf_dir, "benchmark"))


@_query(f"""WITH t AS (SELECT item_id, item_id // 4 AS grp, {_TOKENS.format("text")} AS s FROM benchmark),
p AS (SELECT a.grp, len(list_intersect(a.s, b.s)) / greatest(len(list_distinct(list_concat(a.s, b.s))), 1)::double AS j FROM t a JOIN t b ON a.grp = b.grp AND a.item_id < b.item_id)
SELECT g.grp, round(coalesce(avg(j), 0), 9) AS agreement FROM (SELECT DISTINCT grp FROM t) g LEFT JOIN p USING (grp) GROUP BY g.grp""")
def pairwise_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "benchmark").groupBy(F.floor(F.col("item_id") / 4).alias("grp")).agg(F.array_sort(F.collect_list("text")).alias("texts"))
    return groups.select("grp", F.round(search.agreement(F.col("texts")), 9).alias("agreement"))


# --- evidence, parsing, rewards --------------------------------------------------------------------------------------
_P = f"p AS ({views.scored_sql()})"


@_query(f"""WITH {_P} SELECT id, CASE WHEN gold <> 'NOT_ENOUGH_INFO' THEN list_contains(cited, gold_id) END AS covered,
 CASE WHEN gold = 'NOT_ENOUGH_INFO' OR NOT list_contains(cited, gold_id) THEN NULL WHEN list_contains(cited, 'p9:9') THEN 2 ELSE 1 END::int AS first_size FROM p""")
def gold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.predictions(spark, sf_dir)
    first = evidence.first_covered(F.col("sets"), F.col("cited"))
    return p.select("id", evidence.covers(F.col("sets"), F.col("cited")).alias("covered"), F.when(first.isNotNull(), F.size(first)).alias("first_size"))


@_query("""WITH e AS (SELECT event_id AS id, [1 + event_id % 9, 1 + event_id % 4, 2 + event_id % 7, 3, 9, 1, 2 + event_id % 2] AS n FROM events)
SELECT id, list_filter(n, lambda x: x <= 5)[1:5]::varchar AS evaluated, list_filter(n[1:5], lambda x: x <= 5)::varchar AS rewarded FROM e""")
def citation_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.map_from_entries(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct(F.concat(F.lit("E"), i.cast("string")), i.cast("string"))))
    ids = F.expr("transform(array(1 + event_id % 9, 1 + event_id % 4, 2 + event_id % 7, 3L, 9L, 1L, 2 + event_id % 2), i -> concat('E', i))")
    as_text = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), ids.alias("cited"), shown.alias("shown"))
    return rows.select("id", as_text(evidence.resolve(F.col("cited"), F.col("shown"))).alias("evaluated"), as_text(evidence.resolve(F.col("cited"), F.col("shown"), slice_first=True)).alias("rewarded"))


@_query(f"WITH {_P} SELECT id, round(evidence_f1, 9) AS evidence_f1 FROM p")
def evidence_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.predictions(spark, sf_dir).select("id", F.round("evidence_f1", 9).alias("evidence_f1"))


@_query(f"WITH {_P} SELECT id, fever_score AS strict FROM p")
def strict_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.predictions(spark, sf_dir).select("id", F.col("fever_score").alias("strict"))


_HARM = "CASE WHEN gold = 'REFUTED' AND pred = 'SUPPORTED' THEN 1.5 WHEN gold = 'NOT_ENOUGH_INFO' AND pred = 'SUPPORTED' THEN 1.75 ELSE 1.0 END::double"
_PARTS = f"""r AS (SELECT *, CASE WHEN correct THEN 1.0 ELSE 1.0 - {_HARM} END::double AS correctness, CASE WHEN correct THEN 1.0 ELSE 0.0 END::double AS plain,
 CASE WHEN NOT correct THEN CASE WHEN gold = 'NOT_ENOUGH_INFO' THEN -0.5 ELSE 0.0 END WHEN gold = 'NOT_ENOUGH_INFO' THEN -0.5 ELSE evidence_f1 END::double AS evidence,
 -pow(token_conf - correct::int, 2) AS calibration FROM p)"""


def _rewards(spark: SparkSession, sf_dir: str, config: reward.Config) -> DataFrame:
    p = views.predictions(spark, sf_dir)
    args = [labels.short(F.col("gold")), labels.short(F.col("pred")), F.col("token_conf"), F.col("gold_ids"), F.col("cited"), F.col("id") % 4]
    return p.withColumn("r", reward.total(*args, config, F.col("pred").isNotNull()))


@_query(f"WITH {_P}, {_PARTS} SELECT id, round(correctness + 0.5 * evidence + 0.5 * calibration - 0.02 * (id % 4), 9) AS reward, round(correctness, 9) AS correctness, round(evidence, 9) AS evidence, round(calibration, 9) AS calibration FROM r")
def reward_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewards(spark, sf_dir, reward.ABLATIONS["full"]).select("id", *[F.round(f"r.{c}", 9).alias(c) for c in ("reward", "correctness", "evidence", "calibration")])


@_query(f"""WITH {_P}, {_PARTS}, a AS (SELECT 'full' AS ablation, correctness + 0.5 * evidence + 0.5 * calibration - 0.02 * (id % 4) AS x FROM r
 UNION ALL SELECT 'no_calibration', correctness + 0.5 * evidence - 0.02 * (id % 4) FROM r UNION ALL SELECT 'no_harm', plain + 0.5 * evidence + 0.5 * calibration - 0.02 * (id % 4) FROM r
 UNION ALL SELECT 'format_only', (pred IS NOT NULL)::int FROM r) SELECT ablation, count(*) AS n, round(avg(x), 6) AS mean_reward, round(min(x), 6) AS least, round(max(x), 6) AS most FROM a GROUP BY ablation""")
def reward_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["full", "no_calibration", "no_harm", "format_only"]
    rows = views.predictions(spark, sf_dir)
    args = [labels.short(F.col("gold")), labels.short(F.col("pred")), F.col("token_conf"), F.col("gold_ids"), F.col("cited"), F.col("id") % 4]
    each = F.array(*[F.struct(F.lit(n).alias("ablation"), reward.total(*args, reward.ABLATIONS[n], F.col("pred").isNotNull())["reward"].alias("x")) for n in names])
    return rows.select(F.explode(each).alias("a")).groupBy("a.ablation").agg(F.count("*").alias("n"), F.round(F.avg("a.x"), 6).alias("mean_reward"), F.round(F.min("a.x"), 6).alias("least"), F.round(F.max("a.x"), 6).alias("most"))


_OUT = f"o AS (SELECT *, {views.RAW_SQL} AS raw FROM p)"


@_query(f"""WITH {_P}, {_OUT}, c AS (SELECT *, id % 8 <> 0 AND id % 16 <> 2 AS j, id % 16 <> 10 AND id % 9 <> 0 AS c FROM o)
SELECT id, j AS json_ok, j AND pred IS NOT NULL AS verdict_ok, j AS evidence_ok, j AND c AS confidence_ok,
 j AND pred IS NOT NULL AND c AS format_ok, CASE WHEN j THEN pred END AS verdict, CASE WHEN j THEN 'E' || (id % 5 + 1) || ',E' || (id % 11 + 1) END AS cited,
 CASE WHEN NOT j OR NOT c THEN NULL WHEN id % 10 = 0 THEN 1.0 ELSE (id % 10) / 10.0 END::double AS confidence, len({views.ODD_SQL})::int AS n_chars FROM c""")
def parse_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.odd_outputs(views.outputs(views.predictions(spark, sf_dir))).select("id", "raw", parsing.parse(F.col("raw")).alias("a"))
    return rows.select("id", *[f"a.{c}" for c in ("json_ok", "verdict_ok", "evidence_ok", "confidence_ok", "verdict")], parsing.format_ok(F.col("a")).alias("format_ok"), F.when(F.col("a.evidence_ok"), F.array_join("a.evidence", ",")).alias("cited"), "a.confidence", F.length("raw").alias("n_chars"))


@_query(f"""WITH {_P}, t AS (SELECT id, CASE WHEN id % 8 = 0 THEN NULL WHEN id % 4 = 1 THEN 2 WHEN id % 6 = 0 THEN id % 13 + 1 END AS n FROM p)
SELECT id, CASE WHEN n IS NULL THEN '' ELSE 'E' || n END AS ids, n <= 5 AS valid FROM t""")
def reasoning_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.outputs(views.predictions(spark, sf_dir))
    thought = F.when(F.contains("raw", F.lit("</think>")), F.regexp_replace("raw", r"(?s)\{[^{}]*\}", ""))
    ids = parsing.mentioned(parsing.reasoning(F.coalesce(thought, F.col("raw")), parsing.parse(F.col("raw"))))
    return rows.select("id", F.array_join(ids, ",").alias("ids"), parsing.citations_valid(ids, F.array(*[F.lit(f"E{i}") for i in range(1, 6)])).alias("valid"))


@_query("""WITH t AS (SELECT event_id AS id, event_id % 5 AS k FROM events), m AS (SELECT id, k, CASE WHEN k = 4 THEN 0 ELSE exp(-0.1 * (k + 1)) END AS s, CASE WHEN k = 4 THEN 0 ELSE exp(-1.0) END AS r FROM t)
SELECT id, CASE WHEN s + r > 0 THEN round(s / (s + r), 9) END AS supported, CASE WHEN s + r > 0 THEN round(r / (s + r), 9) END AS refuted FROM m""")
def label_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    alt = lambda t, lp: F.struct(F.lit(t).alias("t"), lp.cast("double").alias("lp"))
    token = lambda tok, alts: F.struct(F.lit(tok).alias("tok"), alts.alias("alts"))
    start = F.when(k == 4, F.array(alt("xyz", F.lit(-0.5)))).otherwise(F.array(alt("SUPP", -0.1 * (k + 1)), alt("REF", F.lit(-1.0)), alt("?", F.lit(-2.0))))
    tokens = F.array(token('{"verdict', F.array(alt("a", F.lit(-1.0)))), token('": "', F.array(alt("a", F.lit(-1.0)))), token("SUPP", start), token("ORTED", start))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), parsing.label_probs(tokens).alias("p"))
    return rows.select("id", F.round(F.col("p")["SUPPORTED"], 9).alias("supported"), F.round(F.col("p")["REFUTED"], 9).alias("refuted"))


@_query(f"""WITH {_P}, {_OUT}, c AS (SELECT *, CASE WHEN id % 9 = 0 THEN NULL WHEN id % 10 = 0 THEN 1.0 ELSE (id % 10) / 10.0 END::double AS conf, 2.0::double / (1 + CASE WHEN id % 5 = id % 11 THEN 1 ELSE 2 END) AS f1 FROM o),
x AS (SELECT id, id % 8 <> 0 AND pred IS NOT NULL AND conf IS NOT NULL AS ok, CASE WHEN correct THEN 1.0 ELSE 1.0 - {_HARM} END AS a,
 CASE WHEN gold = 'NOT_ENOUGH_INFO' THEN -0.5 WHEN correct THEN f1 ELSE 0.0 END AS e, -pow(conf - correct::int, 2) AS k FROM c)
SELECT id, round(CASE WHEN ok THEN a + 0.5 * e + 0.5 * k ELSE -2.0 END::double, 9) AS reward FROM x""")
def reward_of_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.outputs(views.predictions(spark, sf_dir))
    gold_ids = F.array(F.concat(F.lit("E"), (F.col("id") % 5 + 1).cast("string")))
    rows = rows.select("id", "gold", gold_ids.alias("gold_ids"), parsing.parse(F.col("raw")).alias("a"))  # parsed once, not for every field that is asked for
    return rows.select("id", F.round(reward.of_output(F.col("a"), F.col("gold"), F.col("gold_ids")), 9).alias("reward"))


@_query("""SELECT event_type = 'click' AS first_shape, count(*) AS n, sum(event_id % 100)::bigint AS tokens_in, sum(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 7 END)::bigint AS tokens_out FROM events GROUP BY ALL""")
def usage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda m: (F.col("event_id") % m).cast("string")
    body = lambda outer, a, b: F.concat(F.lit(f'{{"{outer}": {{"{a}": '), number(100), F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(f', "{b}": '), number(7))), F.lit("}}"))
    click = F.col("event_type") == "click"
    used = F.when(click, parsing.usage(body("usage", "prompt_tokens", "completion_tokens"), "choices")).otherwise(parsing.usage(body("usageMetadata", "promptTokenCount", "candidatesTokenCount"), "candidates"))
    rows = table(spark, sf_dir, "events").select(click.alias("first_shape"), used.alias("u"))
    return rows.groupBy("first_shape").agg(F.count("*").alias("n"), F.sum("u.tokens_in").alias("tokens_in"), F.sum("u.tokens_out").alias("tokens_out"))


# --- metrics ---------------------------------------------------------------------------------------------------------
_RECALLS = ", ".join(f"round(avg(CASE WHEN gold = '{x}' THEN coalesce(pred = '{x}', false)::int END), 9) AS recall_{x.lower()}" for x in labels.LABELS)
_RATES = f"count(*) AS n, round(avg(correct::int), 9) AS accuracy, round(avg(fever_score::int), 9) AS fever_score, round(avg(evidence_f1), 9) AS evidence_f1, {_RECALLS}"
_STRATA = "s AS (SELECT p.*, unnest(list_filter(['all', CASE WHEN gold = 'NOT_ENOUGH_INFO' THEN 'gold_nei' WHEN gold_in_context THEN 'gold_in_context' ELSE 'gold_not_in_context' END], lambda x: x IS NOT NULL)) AS stratum FROM p)"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@_query(f"WITH {_P} SELECT {_RATES} FROM p")
def accuracy_recall_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.rates(views.predictions(spark, sf_dir)))


@_query(f"WITH {_P} SELECT provider, count(stated_conf) AS n, round(count(stated_conf) / count(*)::double, 9) AS coverage, round(avg(pow(stated_conf - correct::int, 2)), 9) AS brier FROM p GROUP BY provider")
def brier_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.brier(views.predictions(spark, sf_dir), "stated_conf", "provider"))


@_query(f"WITH {_P} SELECT least(floor(token_conf * 10)::int, 9) AS bin, count(*) AS n, round(avg(token_conf), 9) AS conf, round(avg(correct::int), 9) AS acc FROM p GROUP BY ALL")
def ece_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.reliability(views.predictions(spark, sf_dir), "token_conf"))


@_query(f"""WITH {_P}, b AS (SELECT list_sum([(stated_conf >= x / 10.0::double)::int FOR x IN range(1, 10)])::int AS bin, stated_conf, correct FROM p WHERE stated_conf IS NOT NULL),
g AS (SELECT bin, count(*) AS n, avg(stated_conf) AS c, avg(correct::int) AS a FROM b GROUP BY bin) SELECT round(sum(n * abs(c - a)) / sum(n), 9) AS ece FROM g""")
def ece_interval_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.ece(views.predictions(spark, sf_dir), "stated_conf", intervals=True))


@_query(f"""WITH {_P}, g AS (SELECT stated_conf AS threshold, count(*) AS n, sum(correct::int) AS r FROM p WHERE stated_conf IS NOT NULL GROUP BY ALL),
c AS (SELECT threshold, sum(n) OVER (ORDER BY threshold DESC) AS t, sum(r) OVER (ORDER BY threshold DESC) AS g, (SELECT count(*) FROM p) AS w, (SELECT count(stated_conf) FROM p) AS s FROM g)
SELECT target, max(threshold) AS threshold, round(max_by(t / w::double, threshold), 9) AS coverage, round(max_by(1 - g / t::double, threshold), 9) AS risk
FROM c, (SELECT unnest([0.5::double, 0.8::double, 1.0::double]) AS target) WHERE t / s::double >= target GROUP BY target""")
def risk_at_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.risk_at_coverage(views.predictions(spark, sf_dir), "stated_conf"))


@_query(f"""WITH {_P}, g AS (SELECT provider, token_conf AS threshold, count(*) AS n, sum(correct::int) AS r FROM p WHERE token_conf IS NOT NULL GROUP BY ALL),
a AS (SELECT provider, count(*) AS w, count(token_conf) AS s FROM p GROUP BY provider),
c AS (SELECT provider, threshold, sum(n) OVER o AS t, sum(r) OVER o AS g, w, s FROM g JOIN a USING (provider) WINDOW o AS (PARTITION BY provider ORDER BY threshold DESC))
SELECT provider, target, max(threshold) AS threshold, round(max_by(t / w::double, threshold), 9) AS coverage, round(max_by(1 - g / t::double, threshold), 9) AS risk
FROM c, (SELECT unnest([0.5::double, 0.8::double, 1.0::double]) AS target) WHERE t / s::double >= target GROUP BY provider, target""")
def risk_at_coverage_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over confidences that are nearly all different."""
    return metrics.risk_at_coverage(views.predictions(spark, sf_dir), "token_conf", "provider").withColumns({c: F.round(c, 9) for c in ("coverage", "risk")})


def _calibrated(c: str) -> str:
    return f"""{c}_b AS (SELECT stratum, least(floor({c} * 10.0::double)::int, 9) AS bin, count(*) AS n, avg({c}) AS x, avg(correct::int) AS a FROM s WHERE {c} IS NOT NULL GROUP BY ALL),
{c}_e AS (SELECT stratum, round(sum(n * abs(x - a)) / sum(n), 9) AS {c}_ece FROM {c}_b GROUP BY stratum)"""


@_query(f"""WITH {_P}, {_STRATA}, {_calibrated("stated_conf")}, {_calibrated("token_conf")},
m AS (SELECT stratum, {_RATES}, {", ".join(f"count({c}) AS {c}_n, round(count({c}) / count(*)::double, 9) AS {c}_coverage, round(avg(pow({c} - correct::int, 2)), 9) AS {c}_brier" for c in ("stated_conf", "token_conf"))} FROM s GROUP BY stratum)
SELECT * FROM m LEFT JOIN stated_conf_e USING (stratum) LEFT JOIN token_conf_e USING (stratum)""")
def stratified_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.summarize(views.predictions(spark, sf_dir)))


@_query(f"WITH {_P} SELECT gold, pred, gold_in_context, count(*) AS n FROM p GROUP BY ALL")
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(views.predictions(spark, sf_dir), "gold_in_context")


@_query(f"WITH {_P} SELECT provider, count(*) AS n, round(avg(in_tokens), 9) AS mean_in, round(avg(out_tokens), 9) AS mean_out, round((sum(in_tokens) * 0.4::double + sum(out_tokens) * 1.6::double) / 1000000, 9) AS dollars FROM p GROUP BY provider")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.costs(views.predictions(spark, sf_dir), 0.4, 1.6, "provider"))


_SPREAD = f"""{_P}, {_PARTS}, w AS (SELECT user_id, count(*) AS n, stddev_pop(round(correctness, 6)) AS reward_std, count(DISTINCT pred) + max((pred IS NULL)::int) AS n_distinct_verdicts, avg(correct::int) AS acc FROM r GROUP BY user_id)"""


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rewards(spark, sf_dir, reward.ABLATIONS["full"]).select("user_id", F.round("r.correctness", 6).alias("reward"), F.col("pred").alias("verdict"), "correct")
    return metrics.spread(rows, "user_id")


@_query(f"WITH {_SPREAD} SELECT user_id, n, round(reward_std, 9) AS reward_std, n_distinct_verdicts, round(acc, 9) AS acc FROM w")
def reward_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_spread(spark, sf_dir))


@_query(f"WITH {_SPREAD} SELECT count(*) AS n, round(avg((reward_std > 1e-9)::int), 9) AS with_spread, round(avg((n_distinct_verdicts > 1)::int), 9) AS disagreeing, count(*) FILTER (acc = 1) AS all_right, count(*) FILTER (acc = 0) AS all_wrong FROM w")
def spread_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.spread_summary(_spread(spark, sf_dir)))


@_query(f"WITH {_SPREAD} SELECT id, user_id FROM p WHERE user_id IN (SELECT user_id FROM w WHERE reward_std > 1e-9)")
def spread_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_spread(views.predictions(spark, sf_dir).select("id", "user_id"), _spread(spark, sf_dir), "user_id")


@_query(f"WITH {_P}, q AS ({views.scored_sql(3)}) SELECT count(*) AS n, round(avg((p.pred IS NOT DISTINCT FROM q.pred)::int), 9) AS same_verdict, round(avg(p.correct::int), 9) AS accuracy_a, round(avg(q.correct::int), 9) AS accuracy_b FROM p JOIN q USING (id)")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.compare_runs(views.predictions(spark, sf_dir), views.predictions(spark, sf_dir, 3)))


@_query(f"WITH {_P}, t AS (SELECT unnest(list_filter(['bad_pred', CASE WHEN id % 50 = 0 THEN 'bad_token_conf' END], lambda x: x IS NOT NULL AND (x <> 'bad_pred' OR id % 40 = 0))) AS problem FROM p) SELECT problem, count(*) AS n FROM t GROUP BY problem UNION ALL SELECT 'correct_disagrees', count(*) FROM p WHERE id % 40 = 0 AND correct HAVING count(*) > 0")
def prediction_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.predictions(spark, sf_dir)
    p = p.withColumn("pred", F.when(F.col("id") % 40 == 0, "MAYBE").otherwise(F.col("pred"))).withColumn("token_conf", F.when(F.col("id") % 50 == 0, F.lit(1.5)).otherwise(F.col("token_conf")))
    return metrics.problems(p)


@_query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.running_best(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("event_id", "best")


# --- training sets ---------------------------------------------------------------------------------------------------
@_query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7-' || doc_id), doc_id) AS k FROM documents WHERE lang IN ('en', 'fr', 'de'))
SELECT doc_id, lang FROM r WHERE k <= 33 + (lang = 'en')::int""")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.balanced(table(spark, sf_dir, "documents").select("doc_id", "lang"), 100, "lang", "doc_id", 7, ["en", "fr", "de"])


@_query("SELECT doc_id FROM documents ORDER BY md5('0-' || doc_id), doc_id LIMIT 50")
def seeded_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.seeded_prefix(table(spark, sf_dir, "documents").select("doc_id"), 50, "doc_id")


@_query("SELECT md5('0-' || l.doc_id) AS pos, l.doc_id, d.lang FROM labels l JOIN documents d USING (doc_id)")
def ordered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "labels").select(text.seeded(0, F.col("doc_id")).alias("pos"), "doc_id")
    return datasets.ordered_lookup(ids, table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


@_query(f"WITH {_BM25} SELECT qid AS item_id, doc_id, rank::int AS rank FROM rk WHERE rank BETWEEN 3 AND 5")
def search_without_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _best(spark, sf_dir, 5)
    return search.not_shown(best, best.where("rank <= 2"), "qid", "doc_id").select(F.col("qid").alias("item_id"), "doc_id", "rank")


@_query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def disjoint_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    second = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return datasets.disjoint_split(docs, second, spark.createDataFrame([(-1,)], "id long"), "doc_id")


@_query("SELECT count(*) AS overlap FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def leakage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id"), "doc_id").agg(F.count("*").alias("overlap"))


@_query("SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.duplicated(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest")), "digest")


@_query("SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS extra, (SELECT count(*) - count(DISTINCT doc_id) FROM labels) AS repeated")
def frozen_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.set_difference(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), "doc_id")


@_query("SELECT count(*) AS n_rows, sum(('0x' || substr(sha256(doc_id || '|' || text || '|' || lang), 1, 12))::bigint)::varchar AS digest FROM documents")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.row_digest(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").withColumn("digest", F.col("digest").cast("string"))


_REASONS = "CASE event_id % 10 WHEN 1 THEN 'citation_mismatch' WHEN 2 THEN 'gold_not_justified_by_context' WHEN 3 THEN 'gold_evidence_not_explained' WHEN 5 THEN 'citation_mismatch' WHEN 7 THEN 'gold_not_justified_by_context' WHEN 8 THEN 'invalid_json' WHEN 9 THEN 'reasoning_length' END"


@_query(f"SELECT {_REASONS} AS reason, CASE WHEN event_id % 10 IN (6, 7, 9) THEN 'NOT_ENOUGH_INFO' ELSE 'SUPPORTED' END AS gold, count(*) AS n FROM events GROUP BY ALL")
def teacher_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.histogram(datasets.validated(views.teacher_rows(table(spark, sf_dir, "events"))), "reason", "gold")


_REPAIRS = "CASE WHEN event_id % 10 IN (0, 4, 6) THEN 'none' WHEN event_id % 10 = 5 THEN 'citation_append' WHEN event_id % 10 = 7 THEN 'nei_gold_justified_true' END"


@_query(f"""WITH t AS (SELECT event_id, {_REPAIRS} AS repair, {_REASONS} AS reason FROM events), n AS (SELECT 9 * (SELECT count(*) FROM events) // 20 AS n),
k AS (SELECT *, row_number() OVER (PARTITION BY repair ORDER BY md5('0-' || event_id), event_id) AS k FROM t),
s AS (SELECT *, repair IN ('none', 'citation_append') OR (repair = 'nei_gold_justified_true' AND k <= (SELECT n FROM n) - (SELECT count(*) FROM t WHERE repair IN ('none', 'citation_append'))) AS sel FROM k)
SELECT event_id AS id, reason, repair, coalesce(sel, false) AS selected, CASE WHEN repair = 'citation_append' THEN 'The sentence says what the claim says (E1).' END AS appended FROM s""")
def teacher_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = datasets.filled(datasets.repaired(datasets.validated(views.teacher_rows(events))), 9 * events.count() // 20)
    return rows.select("id", "reason", "repair", "selected", F.when(F.col("repair") == "citation_append", F.col("final_reasoning")).alias("appended"))


@_query(f"""WITH {_SHOWN}, g AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'REFUTED' ELSE 'NOT_ENOUGH_INFO' END AS gold FROM benchmark),
e AS (SELECT qid, coalesce(max(CASE WHEN rank = 1 THEN 'E' || n END), max('E' || n)) AS eid FROM sh WHERE rank = 1 AND line = qid % 30 OR rank = 2 AND line = 0 GROUP BY qid)
SELECT item_id AS id, gold, '{{"verdict":"' || gold || '","evidence":[' || CASE WHEN item_id % 3 = 2 THEN '' ELSE '"' || eid || '"' END || '],"confidence":1.0}}' AS completion, n_shown
FROM g LEFT JOIN (SELECT qid, count(*)::int AS n_shown FROM sh GROUP BY qid) s ON s.qid = item_id LEFT JOIN e ON e.qid = item_id WHERE item_id % 3 = 2 OR eid IS NOT NULL""")
def sft_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training examples of claims whose gold evidence, a sentence of the first page or else the second one's first, is shown."""
    ranked = _best(spark, sf_dir, 5)
    found = context.contexts(_shown(spark, sf_dir, ranked))
    pages = ranked.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("p")))), lambda x: x["p"]).alias("pages"))
    item = F.col("item_id")
    gold = F.when(item % 3 == 0, labels.SUPPORTED).when(item % 3 == 1, labels.REFUTED).otherwise(labels.NOT_ENOUGH_INFO)
    one = lambda page, line: F.array(F.struct(page.alias("page"), line.cast("int").alias("line")))
    claims = table(spark, sf_dir, "benchmark").join(pages, item == F.col("qid"))
    sets = F.array(one(F.get("pages", F.lit(0)), item % 30), one(F.get("pages", F.lit(1)), F.lit(0)))
    claims = claims.select("qid", item.alias("id"), F.col("text").alias("claim"), gold.alias("gold"), F.when(item % 3 == 2, F.slice(sets, 1, 0)).otherwise(sets).alias("sets"))
    return datasets.examples(context.coverage(found, claims, pages)).select("id", "gold", "completion", "n_shown")


@_query("""SELECT id, '[{"role":"system","content":"Judge."},{"role":"user","content":"claim of a ' || event_type || '"}]' AS prompt, CASE id % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'REFUTED' ELSE 'NEI' END AS gold, 'E1,E' || (id % 7 + 2) AS gold_eids
FROM (SELECT event_id AS id, event_type FROM events ORDER BY md5('3-' || event_id), event_id LIMIT 1000)""")
def grpo_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat prompts of the first thousand rows in a seeded order, with the reward's label and the target's ids."""
    event = F.col("event_id")
    gold = F.when(event % 3 == 0, labels.SUPPORTED).when(event % 3 == 1, labels.REFUTED).otherwise(labels.NOT_ENOUGH_INFO)
    completion = datasets.target(gold, F.array(F.lit("E1"), F.concat(F.lit("E"), (event % 7 + 2).cast("string"))))
    rows = table(spark, sf_dir, "events").select(event.alias("id"), F.concat(F.lit("claim of a "), "event_type").alias("prompt"), gold.alias("gold"), completion.alias("completion"))
    return datasets.prompts(rows, 1000, "Judge.", 3).select("id", F.to_json("prompt").alias("prompt"), "gold", F.array_join("gold_eids", ",").alias("gold_eids"))


@_query("""WITH c AS (SELECT event_id % 6 AS k FROM events), p AS (SELECT unnest(CASE k WHEN 1 THEN ['no_reasoning'] WHEN 2 THEN ['other_verdict'] WHEN 3 THEN ['no_evidence_list'] WHEN 4 THEN ['confidence_key']
 WHEN 5 THEN ['no_reasoning', 'other_verdict', 'no_evidence_list'] ELSE [] END) AS problem FROM c)
SELECT problem, count(*) AS n FROM p GROUP BY problem UNION ALL SELECT 'frozen_id', count(*) FROM events WHERE event_id IN (SELECT item_id FROM benchmark) HAVING count(*) > 0 UNION ALL SELECT 'wrong_count', count(*) FROM events HAVING count(*) <> 7""")
def cot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a reasoning training set whose completions have one of five faults, or none."""
    case = F.col("event_id") % 6
    body = lambda reasoning, verdict, evidence, more="": F.lit(f'{{"reasoning":"{reasoning}","verdict":"{verdict}","evidence":{evidence}{more}}}')
    good = body("why", "SUPPORTED", '["E1"]')
    text_ = F.when(case == 1, body(" ", "SUPPORTED", "[]")).when(case == 2, body("why", "REFUTED", "[]")).when(case == 3, body("why", "SUPPORTED", '"E1"')).when(case == 4, body("why", "SUPPORTED", "[]", ',"confidence":1.0')).when(case == 5, F.lit("{")).otherwise(good)
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("SUPPORTED").alias("gold"), text_.alias("completion"))
    return datasets.cot_problems(rows, table(spark, sf_dir, "benchmark").select("item_id"), 7)


@_query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('5-' || doc_id), doc_id) AS k FROM documents WHERE lang IN ('en', 'fr', 'de')) SELECT doc_id, lang FROM r WHERE k <= 20""")
def per_class_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.per_class(table(spark, sf_dir, "documents").select("doc_id", "lang"), 20, "lang", "doc_id", 5, ["en", "fr", "de"])


@_query(f"""WITH {_BM25}, m AS (SELECT qid, max(rank) AS m FROM rk WHERE rank <= 8 GROUP BY qid)
SELECT qid AS item_id, string_agg(doc_id::varchar, ',' ORDER BY md5('11-' || qid || '-' || doc_id), doc_id::varchar) AS pages FROM rk JOIN m USING (qid) WHERE rank <= 4 OR rank = m AND m = 8 OR rank = 5 AND m < 8 GROUP BY qid""")
def oracle_page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold page, here the eighth retrieved, and the first retrieved ones, five in all, in an order seeded by the claim."""
    best = _top(spark, sf_dir, 8).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("p")))), lambda x: x["p"]).alias("pages"))
    gold = F.array(F.array(F.struct(F.get("pages", F.lit(7)).alias("page"), F.lit(0).alias("line"))))
    sets = F.when(F.size("pages") == 8, gold).otherwise(F.slice(gold, 1, 0))
    return best.select(F.col("qid").alias("item_id"), F.array_join(context.oracle_pages(sets, F.slice("pages", 1, 5), F.col("qid"), 11), ",").alias("pages"))


_GOLD = "gp AS (SELECT b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@_query(f"""WITH {_BM25}, {_GOLD}, k AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r FROM rk WHERE rank <= 8 AND (qid, doc_id) NOT IN (SELECT (qid, doc_id) FROM gp))
SELECT qid AS item_id, string_agg(doc_id::varchar, ',' ORDER BY r) AS pages FROM k WHERE r <= 5 GROUP BY qid""")
def nei_ablation_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = views.gold_pages(views.index(spark, sf_dir), table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).groupBy("qid").agg(F.collect_list(F.col("doc_id").cast("string")).alias("gold"))
    lists = _top(spark, sf_dir, 8).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("p")))).alias("x")).join(gold, "qid", "left")
    kept = context.without_pages(F.transform("x", lambda s: s["p"]), F.coalesce("gold", F.array().cast("array<string>")))
    return lists.select(F.col("qid").alias("item_id"), F.array_join(kept, ",").alias("pages")).where("pages <> ''")


@_query(f"""WITH {_SHOWN}, {_GOLD}, x AS (SELECT sh.qid, line < 2 AND (sh.qid, sh.doc_id) IN (SELECT (qid, doc_id) FROM gp) AS gone FROM sh)
SELECT qid AS item_id, count(*) FILTER (NOT gone) AS n_shown, count(*) FILTER (gone) AS n_removed FROM x GROUP BY qid HAVING count(*) FILTER (NOT gone) > 0""")
def nei_ablation_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = _shown(spark, sf_dir)
    gold = views.gold_pages(views.index(spark, sf_dir), table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("line", F.explode(F.array(F.lit(0), F.lit(1))))
    left = context.without_sentences(shown, gold).groupBy("qid").agg(F.count("*").alias("n_shown"))
    whole = shown.groupBy("qid").agg(F.count("*").alias("n"))
    return left.join(whole, "qid").select(F.col("qid").alias("item_id"), "n_shown", (F.col("n") - F.col("n_shown")).alias("n_removed"))


@_query("SELECT doc_id, sha256(text) AS text_sha256 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents from a store of all; only the parts that hold one are read."""
    path = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    io.write_pages(table(spark, sf_dir, "documents").select("doc_id", "text"), path, key="doc_id")
    keys = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    return io.lookup(spark.read.parquet(path), keys, "doc_id").select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.undone(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


@_query("SELECT conv_id, count(*)::int AS n_turns, string_agg(role, '>' ORDER BY turn, role) AS roles, count(*) FILTER (role = 'user')::int AS n_user, count(*) FILTER (role = 'assistant')::int AS n_assistant FROM conversations GROUP BY conv_id")
def trace_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.conversation_steps(table(spark, sf_dir, "conversations"))


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _rewards(spark, sf_dir, reward.ABLATIONS["full"]).withColumn("reward", F.col("r.reward")).withColumn("claim", F.concat(F.lit("claim "), F.col("id").cast("string")))
    rows = p.withColumn("pages", F.array(F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")))).withColumn("confidence", F.col("token_conf"))
    return traces.traces(rows, "run1").join(p.select("id", "sets"), "id")


@_query(f"WITH {_P} SELECT count(*) AS n, round(avg(correct::int), 9) AS accuracy, round(avg(fever_score::int), 9) AS strict, round(avg((pred IS NOT NULL)::int), 9) AS valid, {_RECALLS}, 1.0::double AS mean_ops, 0.0::double AS mean_seconds FROM p")
def trace_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(traces.report(_traces(spark, sf_dir)))


@_query(f"""WITH {_P}, {_PARTS}, s AS (SELECT *, unnest([0, 1, 2]) AS t, CASE WHEN pred = 'NOT_ENOUGH_INFO' THEN 'abstain' ELSE 'commit' END AS act FROM r)
SELECT id, 'run1' AS run, 1 AS version, 'claim ' || id AS claim, gold, t, CASE t WHEN 0 THEN 'search' WHEN 1 THEN 'verify' ELSE act END AS action,
 CASE t WHEN 0 THEN '{{"query":"claim ' || id || '"}}' WHEN 1 THEN '{{"claim":"claim ' || id || '"}}' ELSE CASE WHEN pred IS NULL THEN '{{}}' ELSE '{{"verdict":"' || pred || '"}}' END END AS args,
 CASE t WHEN 0 THEN 'p' || (user_id % 5) END AS page, CASE t WHEN 1 THEN pred END AS pred, CASE t WHEN 1 THEN cited[1] END AS cited, 0.0::double AS seconds,
 pred AS final_verdict, token_conf AS confidence, array_to_string(cited, ',') AS evidence, act AS final_action, 1 AS n_search, 0 AS n_decompose, 1 AS n_verify, 1 AS n_ops, 0.0::double AS all_seconds,
 round(correctness + 0.5 * evidence + 0.5 * calibration - 0.02 * (id % 4), 9) AS reward FROM s""".replace("array_to_string(cited, ',') AS evidence", "array_to_string(cited, ',') AS cited_ids"))
def trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of every trace, with what the trace came to."""
    rows = _traces(spark, sf_dir).withColumn("s", F.explode("steps"))
    part = lambda path: F.get_json_object("s.result", path)
    return rows.select(
        "id", F.col("run.name").alias("run"), "run.version", "claim", "gold", "s.t", "s.action", "s.args", part("$.pages[0]").alias("page"), part("$.pred").alias("pred"), part("$.cited[0]").alias("cited"), "s.seconds",
        F.col("final.verdict").alias("final_verdict"), "final.confidence", F.array_join("final.evidence", ",").alias("cited_ids"), F.col("final.action").alias("final_action"),
        "cost.n_search", "cost.n_decompose", "cost.n_verify", "cost.n_ops", F.col("cost.seconds").alias("all_seconds"), F.round("reward", 9).alias("reward"),
    )


@_query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@_query("SELECT event_id, (props->>'$.k')::bigint AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# --- rows as files, and small functions over whole tables ------------------------------------------------------------------
@_query("""SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'REFUTED' ELSE 'NOT_ENOUGH_INFO' END AS gold, CASE WHEN event_id % 3 = 2 THEN 0 ELSE 2 END::int AS n_sets,
CASE WHEN event_id % 3 <> 2 THEN 'p' || (user_id % 5) || ':' || (event_id % 4) || ',q:1' END AS ids FROM events""")
def claims_as_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims written as JSON lines and read again, with canonical labels and the evidence sets without repeats."""
    item = lambda page, line: F.array(F.lit("1"), F.lit("2"), page, line.cast("string"))
    page = F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string"))
    first = item(page, F.col("event_id") % 4)
    raw = F.when(F.col("event_id") % 3 == 0, "SUPPORTS").when(F.col("event_id") % 3 == 1, "REFUTES").otherwise("NOT ENOUGH INFO")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit(None).cast("string").alias("claim"), raw.alias("label"), F.array(F.array(first, first), F.array(item(F.lit("q"), F.lit(1)))).alias("evidence"))
    path = f"{shared_folder(spark)}/claims-{uuid.uuid4().hex}"
    io.write_jsonl(rows, path, "errorifexists")
    found = io.read_claims(spark, path).withColumn("sets", evidence.gold_sets(F.col("label"), F.col("evidence")))
    ids = F.array_join(F.transform(F.flatten("sets"), lambda e: evidence.global_id(e["page"], e["line"])), ",")
    return found.select("id", labels.canonical(F.col("label")).alias("gold"), F.size("sets").alias("n_sets"), F.when(F.size("sets") > 0, ids).alias("ids"))


@_query("SELECT 'Doc_-LRB-' || lang || '-RRB-_' || doc_id AS id, sha256('Doc (' || lang || ') ' || doc_id || ' . ' || text) AS text_sha256 FROM documents WHERE text <> ''")
def page_index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as JSON lines and read again, with what is indexed of each."""
    page = F.concat(F.lit("Doc_-LRB-"), "lang", F.lit("-RRB-_"), F.col("doc_id").cast("string"))
    path = f"{shared_folder(spark)}/wiki-{uuid.uuid4().hex}"
    io.write_jsonl(table(spark, sf_dir, "documents").select(page.alias("id"), "text", F.lit("").alias("lines")), path, "errorifexists")
    return io.read_pages(spark, path).select("id", F.sha2(text.index_text(F.col("id"), F.col("text")), 256).alias("text_sha256"))


@_query("""SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'say ' || event_type || CASE WHEN event_type = 'click' THEN '' ELSE '!' END END AS said FROM events""")
def provider_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of finished answers in two providers' responses."""
    done = lambda yes: F.when(F.col("event_id") % 4 == 0, "length").otherwise(yes)
    said = F.concat(F.lit("say "), "event_type")
    one = F.to_json(F.struct(F.array(F.struct(done("stop").alias("finish_reason"), F.struct(said.alias("content")).alias("message"))).alias("choices")))
    parts = F.array(F.struct(said.alias("text")), F.struct(F.lit("!").alias("text")))
    two = F.to_json(F.struct(F.array(F.struct(done("STOP").alias("finishReason"), F.struct(parts.alias("parts")).alias("content"))).alias("candidates")))
    found = F.when(F.col("event_type") == "click", parsing.provider_text(one, "choices")).otherwise(parsing.provider_text(two, "candidates"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), found.alias("said"))


@_query(r"""WITH c AS (SELECT item_id, text, list_filter(list_transform(string_split(text, ' and '), lambda p: trim(p)), lambda p: p <> '') AS p FROM benchmark)
SELECT item_id, contains(text, ' and ') AS compound, CASE WHEN len(p) > 1 THEN array_to_string(p, '|') ELSE text END AS parts, trim(replace(string_split('Claim: ' || text, chr(10))[1], 'Claim: ', '')) AS claim FROM c""")
def claim_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims as the parts that ``and`` joins, and as they are read back from a prompt."""
    prompt = F.concat(F.lit("Claim: "), "text", F.lit("\n\nEvidence:\nE1 [A] b"))
    return table(spark, sf_dir, "benchmark").select("item_id", text.is_compound(F.col("text")).alias("compound"), F.array_join(text.decompose(F.col("text")), "|").alias("parts"), context.claim_of(prompt).alias("claim"))


@_query(f"""WITH {_P}, {_OUT} SELECT id, CASE WHEN gold <> 'NOT_ENOUGH_INFO' THEN gold_id END AS least_set, CASE WHEN id % 2 = 0 THEN 'E2,E9,E10' ELSE 'E1,E3,E12' END AS by_number,
CASE WHEN pred = 'NOT_ENOUGH_INFO' THEN 'abstain' ELSE 'commit' END AS action, id % 4 = 1 AS thought,
'E1=a' || (id % 3) || ',E2=b' || (id % 2) || ',E3=a' || ((id + 1) % 3) AS rollout FROM o""")
def small_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest gold set, ids in numeric order, an agent's last action, whether it thought, and its numbered results over two searches."""
    rows = views.outputs(views.predictions(spark, sf_dir))
    ids = F.when(F.col("id") % 2 == 0, F.array(*map(F.lit, ["E10", "E9", "E2"]))).otherwise(F.array(*map(F.lit, ["E3", "E12", "E1"])))
    named = lambda x, n: F.concat(F.lit(x), n.cast("string"))
    results = F.array(F.array(named("a", F.col("id") % 3), named("b", F.col("id") % 2)), F.array(named("a", (F.col("id") + 1) % 3), named("a", F.col("id") % 3)))
    entries = F.array_sort(F.map_entries(traces.numbered_rollout(results)))
    return rows.select(
        "id", F.when(F.size("sets") > 0, F.array_join(evidence.smallest(F.col("sets")), ",")).alias("least_set"), F.array_join(evidence.by_number(ids), ",").alias("by_number"),
        traces.final_action(F.col("pred")).alias("action"), parsing.thought(F.col("raw")).alias("thought"), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("rollout"),
    )


# --- models, episodes, streams: rows are checked by tests ------------------------------------------------------------
@_query()
def verify_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context.contexts(_shown(spark, sf_dir)).join(table(spark, sf_dir, "benchmark"), F.col("qid") == F.col("item_id"))
    out = inference.generate(rows.select(F.col("item_id").alias("id"), context.render(F.col("text"), F.col("shown")).alias("prompt")), inference.Stub)
    return out.select("id", "in_tokens", "out_tokens", parsing.parse(F.col("text"))["verdict"].alias("verdict"))


@_query()
def probe_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context.contexts(_shown(spark, sf_dir)).join(table(spark, sf_dir, "benchmark"), F.col("qid") == F.col("item_id"))
    rows = rows.select(F.col("item_id").alias("id"), context.render(F.col("text"), F.col("shown")).alias("prompt"), F.when(F.col("item_id") % 2 == 0, labels.SUPPORTED).otherwise(labels.REFUTED).alias("orig_label"))
    return inference.probe(rows, inference.Stub)


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in text.TOY_STOPWORDS)
_SET = lambda x: f"list_filter(list_distinct(list_transform(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''), lambda w: lower(regexp_replace(w, '^[.,]+|[.,]+$', '', 'g')))), lambda w: w NOT IN ({_STOP}))"
_HITS = "CASE WHEN n.dec THEN coalesce(h[((n.ops + 1) % (len(h) - 1)) + 2], []) ELSE coalesce(h[1], []) END"


@_query(f"""WITH RECURSIVE c AS (SELECT item_id AS id, text AS claim, list_filter(list_transform(string_split(text, ' and '), lambda p: trim(p)), lambda p: p <> '') AS p FROM benchmark),
q AS (SELECT id, claim, unnest(list_concat([claim], CASE WHEN len(p) > 1 THEN p ELSE [claim] END)) AS query, unnest(range(0, 1 + CASE WHEN len(p) > 1 THEN len(p) ELSE 1 END)) AS no FROM c),
t AS (SELECT DISTINCT query, {_SET("query")} AS qt FROM q), s AS (SELECT 's' || item_id AS sid, item_id AS place, {_SET("text")} AS st FROM benchmark),
j AS (SELECT query, sid, st, place, len(list_intersect(qt, st))::double / len(list_distinct(list_concat(qt, st))) AS score FROM t JOIN s ON list_has_any(qt, st)),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, place) AS rank FROM j),
b AS (SELECT query, list({{'sid': sid, 'score': score, 'st': st}} ORDER BY rank) AS hits FROM r WHERE rank <= 8 GROUP BY query),
h AS (SELECT id, any_value(claim) AS claim, list(hits ORDER BY no) AS h FROM q LEFT JOIN b USING (query) GROUP BY id),
f AS (SELECT id, claim, h, [] ::STRUCT(sid VARCHAR, score DOUBLE, st VARCHAR[])[] AS cited, 0.0::double AS top, 0.0::double AS best, 0.0::double AS agree, 0 AS ops, false AS dec, NULL::int AS fin FROM h
 UNION ALL SELECT id, claim, h, CASE WHEN a = 0 THEN list_concat(cited, new)[1:6] ELSE cited END, CASE WHEN a = 0 THEN coalesce(new[1].score, 0) ELSE top END,
   greatest(best, CASE WHEN a = 0 THEN coalesce(new[1].score, 0) ELSE top END),
   CASE WHEN a = 2 THEN coalesce(list_avg(flatten(list_transform(range(1, len(cited) + 1), lambda x: list_transform(range(x + 1, len(cited) + 1), lambda y: len(list_intersect(cited[x].st, cited[y].st))::double / greatest(len(list_distinct(list_concat(cited[x].st, cited[y].st))), 1))))), 0) ELSE agree END,
   ops + 1, dec OR a = 1, CASE WHEN a >= 3 THEN a END
  FROM (SELECT n.*, list_filter({_HITS}, lambda x: NOT list_contains(list_transform(n.cited, lambda z: z.sid), x.sid))[1:2] AS new,
    CASE WHEN contains(claim, ' and ') AND NOT dec THEN 1 WHEN len(cited) < 3 AND top > 0 THEN 0 WHEN len(cited) = 0 THEN 0 WHEN agree = 0 THEN 2 WHEN best < 0.25 THEN 3 WHEN best > 0.4 THEN 4 ELSE 5 END AS a FROM f n WHERE n.fin IS NULL AND n.ops < 8)),
e AS (SELECT *, coalesce(fin >= 4, false) AS yes FROM f WHERE fin IS NOT NULL OR ops = 8),
g AS (SELECT id, CASE WHEN yes THEN 'SUPPORTED' ELSE 'NEI' END AS pred, CASE WHEN fin = 4 THEN 0.9 WHEN fin = 5 THEN 0.4 ELSE 0.5 END::double AS confidence, CASE WHEN yes THEN list_transform(cited, lambda x: x.sid) ELSE [] END AS cited, ops FROM e)
SELECT id, pred, confidence, array_to_string(cited, ',') AS cited, ops AS n_ops FROM g""")
def episode_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    sentences = benchmark.select(F.concat(F.lit("s"), F.col("item_id").cast("string")).alias("sid"), "text", F.col("item_id").alias("place"))
    claims = benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("claim"), F.lit(labels.SUPPORTED).alias("gold"), F.array(F.concat(F.lit("s"), F.col("item_id").cast("string"))).alias("gold_ids"))
    return episodes.episodes(claims, sentences).select("id", "pred", "confidence", F.array_join("cited", ",").alias("cited"), "n_ops")


_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@_query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of many micro-batches whose done keys are state, ended and run again, which adds nothing."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").repartitionByRange(12, "event_id").write.parquet(f"{base}/in")
    for _ in range(2):
        rows = streams.read(spark, f"{base}/in", _EVENTS, max_files=2)
        resume.resumed(rows, f"{base}/out", f"{base}/state", "event_id", strict=False).awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"), F.round(F.sum("value"), 4).alias("total"))


@_query("SELECT time_bucket(INTERVAL 1 DAY, ts)::varchar AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.tumbling(rows, "1 day", "event_type").select(F.col("window_start").cast("string").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@_query("""WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events), g AS (SELECT user_id, ts, sum((b IS NULL OR ts - b >= INTERVAL 6 HOUR)::int) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l)
SELECT user_id, count(*) AS n, min(ts)::timestamp AS session_start FROM g GROUP BY user_id, s""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.sessions(rows, "6 hours", "user_id").select("user_id", "n", F.col("session_start").cast("timestamp_ntz").alias("session_start"))


@_query("SELECT source, lang, count(*) AS n, sum(n_chars)::bigint AS chars FROM documents GROUP BY GROUPING SETS ((), (source), (source, lang))")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT source, lang, count(*) AS n, sum(n_chars) AS chars FROM {d} GROUP BY GROUPING SETS ((), (source), (source, lang))", d=table(spark, sf_dir, "documents"))


@_query("""SELECT n_name, count(*) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
