"""Derived views over the driver's tables, the same in Spark SQL and in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.evidence import evidence_f1, strict
from ..functions.labels import NOT_ENOUGH_INFO
from ..functions.stemming import english_stem
from ..functions.text import ENGLISH_STOPWORDS
from ..operators import index as ix
from ..sources.staging import shared_folder, ship, staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _label(x: str) -> str:
    return f"CASE {x} WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'REFUTED' WHEN 2 THEN 'NOT_ENOUGH_INFO' END"


def predictions_sql(duck: bool, run: int = 4) -> str:
    """SELECT of the predictions that stand behind the evaluation queries; ``run`` 4 is the first run, 3 the second."""
    d = (lambda x: f"{x}::double") if duck else (lambda x: f"{x}D")
    arr = (lambda *x: "[" + ", ".join(x) + "]") if duck else (lambda *x: "array(" + ", ".join(x) + ")")
    none = "[]::varchar[][]" if duck else "cast(array() as array<array<string>>)"
    pred = f"CASE WHEN event_type = 'error' AND user_id % 5 = 0 THEN NULL ELSE (event_id + CASE WHEN user_id % {run} = 0 THEN 1 WHEN user_id % 7 = 0 THEN 2 ELSE 0 END) % 3 END"
    return f"""SELECT event_id AS id, user_id, event_type AS provider, {_label("event_id % 3")} AS gold, {_label(f"({pred})")} AS pred,
 CASE WHEN user_id % 10 = 9 THEN NULL ELSE round(least(value / {d("200.0")}, {d("1.0")}), 1) END AS stated_conf, least(value / {d("500.0")}, {d("1.0")}) AS token_conf,
 CASE WHEN event_id % 3 = 2 THEN NULL ELSE user_id % 6 <> 0 END AS gold_in_context,
 'p' || (user_id % 5) || ':' || (event_id % 4) AS gold_id,
 CASE WHEN event_id % 3 = 2 THEN {none} ELSE {arr(arr("'p' || (user_id % 5) || ':' || (event_id % 4)", "'p9:9'"), arr("'p' || (user_id % 5) || ':' || (event_id % 4)"))} END AS sets,
 CASE WHEN event_id % 7 = 0 THEN {arr("'p' || (user_id % 5) || ':' || (event_id % 3)", "'p9:9'")} ELSE {arr("'p' || (user_id % 5) || ':' || (event_id % 3)")} END AS cited,
 100 + event_id % 50 AS in_tokens, event_id % 30 AS out_tokens FROM events"""


def predictions(spark: SparkSession, sf_dir: str, run: int = 4) -> DataFrame:
    rows = spark.sql(predictions_sql(False, run).replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    rows = rows.withColumn("correct", F.coalesce(F.col("gold") == F.col("pred"), F.lit(False)))
    rows = rows.withColumn("gold_ids", F.array_sort(F.array_distinct(F.flatten("sets"))))
    rows = rows.withColumn("fever_score", strict(F.col("gold"), F.col("pred"), F.col("sets"), F.col("cited")))
    return rows.withColumn("evidence_f1", F.when(F.col("gold") != NOT_ENOUGH_INFO, evidence_f1(F.col("gold_ids"), F.col("cited"))))


def scored_sql(run: int = 4) -> str:
    """The predictions in DuckDB with correct, fever_score and evidence_f1 (two gold ids; one or two citations)."""
    return f"""SELECT *, coalesce(gold = pred, false) AS correct,
 coalesce(gold = pred, false) AND (gold = 'NOT_ENOUGH_INFO' OR list_contains(cited, gold_id)) AS fever_score,
 CASE WHEN gold <> 'NOT_ENOUGH_INFO' THEN 2.0::double * (list_contains(cited, gold_id)::int + list_contains(cited, 'p9:9')::int) / (2 + len(cited)) END AS evidence_f1
 FROM ({predictions_sql(True, run)})"""


_BUILT: dict[tuple[str, str, bool], str] = {}


def index(spark: SparkSession, sf_dir: str, english: bool = False) -> ix.Index:
    """The index of ``documents``, built once for all queries of an application; ``english`` leaves stopwords out and stems terms."""
    key = (spark.sparkContext.applicationId, sf_dir, english)
    settings = {"stopwords": ENGLISH_STOPWORDS, "stem": english_stem} if english else {}
    if english:
        ship(spark)
    if key not in _BUILT:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        ix.build(table(spark, sf_dir, "documents"), path, **settings)
        _BUILT[key] = path
    return ix.load(spark, _BUILT[key], settings.get("stem"))


def sentences(docs: DataFrame) -> DataFrame:
    """Documents as packed pages (``number<tab>sentence`` rows) and decoded again: (doc_id, sentences)."""
    from ..functions.text import sentences as decode

    packed = F.array_join(F.transform(F.split("text", "\n"), lambda s, i: F.concat(i.cast("string"), F.lit("\t"), s)), "\n")
    return docs.select("doc_id", decode(packed).alias("sentences"))


def title_table(docs: DataFrame, claims: DataFrame) -> DataFrame:
    """(doc_id, title): every document's first word, with its language in brackets for every tenth, and every claim's first two words as pages of their own."""
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    one = docs.select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.concat(F.get(words(F.col("text")), F.lit(0)), F.lit(" ("), F.col("lang"), F.lit(")"))).otherwise(F.get(words(F.col("text")), F.lit(0))).alias("title"))
    two = claims.select((F.lit(1_000_000_000) + F.col("item_id")).alias("doc_id"), F.array_join(F.slice(words(F.col("text")), 1, 2), " ").alias("title"))
    return one.unionByName(two).where("title is not null and title <> ''")


def gold_pages(index_: ix.Index, docs: DataFrame, claims: DataFrame) -> DataFrame:
    """(qid, doc_id): documents that hold a claim word for word. Candidates are those with the claim's rarest term of those that don't reach its ends, where it may be
    a part of a document's term; claims without such a term meet every text. Candidates are staged and few, so they go to where the texts are read."""
    from ..functions.text import terms
    from ..operators.search import query_terms

    inner = claims.withColumn("inner", F.regexp_replace("text", r"^[\p{L}\p{N}_]+|[\p{L}\p{N}_]+\z", ""))
    asked, texts = query_terms(inner, "item_id", "inner"), docs.select("doc_id", "text")
    rarest = asked.join(index_.terms.select("term", "df"), "term").groupBy("qid").agg(F.min(F.struct("df", "term")).alias("r")).select("qid", "r.term")
    near = staged(index_.postings.select("term", "doc_id").join(staged(rarest, "rarest"), "term").select("qid", "doc_id"), "near")
    said = inner.select(F.col("item_id").alias("qid"), F.col("text").alias("claim"), "inner")
    both = texts.join(near, "doc_id").join(said.drop("inner"), "qid").where(F.contains("text", F.col("claim")))
    bare = said.where((F.size(terms(F.col("inner"))) == 0) & F.col("claim").isNotNull())
    return both.select("qid", "doc_id").unionByName(texts.join(bare, F.contains("text", F.col("claim"))).select("qid", "doc_id"))


#: Outputs of a model made from the predictions: JSON after thinking, every eighth cut off, some with reasoning or a bad field.
def outputs(rows: DataFrame) -> DataFrame:
    body = F.expr("""concat('{"verdict": "', coalesce(pred, 'UNSURE'), '", "evidence": ["E', id % 5 + 1, '", "E', id % 11 + 1, '"], "confidence": ', CASE WHEN id % 9 = 0 THEN '1.5' WHEN id % 10 = 0 THEN 'true' ELSE concat('0.', id % 10) END, CASE WHEN id % 6 = 0 THEN concat(', "reasoning": "see E', id % 13 + 1, '"') ELSE '' END, '}')""")
    raw = F.when(F.col("id") % 8 == 0, F.expr("concat('{\"verdict\": \"', gold)")).when(F.col("id") % 4 == 1, F.concat(F.lit('<think>a draft {"verdict": 1} with E2</think>'), body)).otherwise(body)
    return rows.withColumn("raw", raw)


def odd_outputs(rows: DataFrame) -> DataFrame:
    """The outputs, some with a remark in braces after the answer, a verdict that a second one replaces, or a confidence that is no number."""
    odd, raw = F.col("id") % 16, F.col("raw")
    return rows.withColumn("raw", F.when(odd == 2, F.concat(raw, F.lit(" and {x}"))).when(odd == 6, F.concat(F.lit('{"verdict": "UNSURE", '), F.expr("substring(raw, 2)"))).when(odd == 10, F.regexp_replace(raw, r'"confidence": [^,}]*', '"confidence": NaN')).otherwise(raw))


RAW_SQL = """CASE WHEN id % 8 = 0 THEN '{"verdict": "' || gold ELSE CASE WHEN id % 4 = 1 THEN '<think>a draft {"verdict": 1} with E2</think>' ELSE '' END
 || '{"verdict": "' || coalesce(pred, 'UNSURE') || '", "evidence": ["E' || (id % 5 + 1) || '", "E' || (id % 11 + 1) || '"], "confidence": ' || CASE WHEN id % 9 = 0 THEN '1.5' WHEN id % 10 = 0 THEN 'true' ELSE '0.' || (id % 10) END
 || CASE WHEN id % 6 = 0 THEN ', "reasoning": "see E' || (id % 13 + 1) || '"' ELSE '' END || '}' END"""


def teacher_rows(events: DataFrame) -> DataFrame:
    """Teacher answers made from events, one of ten cases each, with the row they answer: (id, gold, prompt, completion, content)."""
    case = F.col("event_id") % 10
    gold = F.when(case.isin(6, 7, 9), NOT_ENOUGH_INFO).otherwise(F.lit("SUPPORTED"))
    answer = lambda text, relation, cited, justified: F.lit(f'{{"reasoning": "{text}", "relation": "{relation}", "cited_evidence": {cited}, "gold_justified": {justified}}}')
    said = "The sentence E1 says what the claim says."
    content = (
        F.when(case == 0, answer(said, "supports", '["E1"]', "true")).when(case == 1, answer(said, "supports", '["E9"]', "true")).when(case == 2, answer(said, "supports", '["E1"]', "false"))
        .when(case == 3, answer("Only the sentence E2 is to the point.", "supports", '["E2"]', "true")).when(case == 4, F.concat(F.lit("```json\n"), answer("Both E1 and the sentence E2 say so.", "supports", '["E1"]', "true"), F.lit("\n```")))
        .when(case == 5, answer("The sentence says what the claim says.", "supports", '["E1"]', "true")).when(case == 6, answer("The sentence E2 doesn't settle it.", "insufficient", "[]", "true"))
        .when(case == 7, answer("The sentence E2 doesn't settle it.", "insufficient", "[]", "false")).when(case == 8, F.lit("{not json")).otherwise(answer("Too short", "insufficient", "[]", "true"))
    )
    completion = F.when(gold == NOT_ENOUGH_INFO, F.lit('{"verdict":"NOT_ENOUGH_INFO","evidence":[]}')).otherwise(F.lit('{"verdict":"SUPPORTED","evidence":["E1"]}'))
    return events.select(F.col("event_id").alias("id"), gold.alias("gold"), F.lit("Claim: c\n\nEvidence:\nE1 [A] one\nE2 [B] two").alias("prompt"), completion.alias("completion"), content.alias("content"))

ODD_SQL = r"""CASE id % 16 WHEN 2 THEN raw || ' and {x}' WHEN 6 THEN '{"verdict": "UNSURE", ' || substr(raw, 2) WHEN 10 THEN regexp_replace(raw, '"confidence": [^,}]*', '"confidence": NaN') ELSE raw END"""
