"""The engine's own operators: invariants restated, hand-made cases, and the queries against DuckDB."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.functions import evidence, labels, parsing, reward, text
from factloom.operators import context, datasets, episodes, inference, metrics, search, traces
from factloom.operators import index as ix
from factloom.plans import catalogue
from factloom.sources import io
from factloom.streaming import events as streams
from factloom.streaming import resume

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def array(*x):
    return F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")


# --- queries against DuckDB ------------------------------------------------------------------------------------------
def plain(rows):
    def value(v):
        if isinstance(v, float):
            return round(v, 6) + 0.0
        if isinstance(v, list | tuple):
            return [value(x) for x in v]
        return v

    return sorted((tuple(map(str, map(value, r))) for r in rows))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    assert plain(df.select(*columns).collect()) == plain(found.select(*columns).fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_plans_have_no_cross_product_or_python(spark):
    for name in ("bm25_top5", "search_with_titles", "title_spans_longest", "jaccard_topk", "parse_output", "stratified_metrics", "page_recall_at_k"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan, name


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50


# --- text ------------------------------------------------------------------------------------------------------------
def test_titles_and_sentences(spark):
    r = one(
        spark, title=text.page_title(F.lit("A_-LRB-b-RRB-")), base=text.base_title(F.lit("quarry (radio play)")), none=text.base_title(F.lit("quarry")),
        s=text.sentences(F.lit("0\tFirst -LRB-x-RRB-\tlink\nx\tno number\n1\t  \n2\n7\tlast")), parts=text.decompose(F.lit("a and  and b")), whole=text.decompose(F.lit("a and ")),
        forms=text.span_forms(F.lit('Ann\'s".')), tokens=text.token_set(F.lit("The cat, the Dog. of")),
    )
    assert (r.title, r.base, r.none) == ("A (b)", "quarry", None)
    assert [tuple(x) for x in r.s] == [(0, "First (x)"), (7, "last")]
    assert r.parts == ["a", "b"] and r.whole == ["a and "] and r.forms == ['ann\'s".', "ann's", "ann"] and sorted(r.tokens) == ["cat", "dog"]


def test_stemmer_sees_distinct_terms(spark):
    t = spark.createDataFrame([("runs",), ("run",), (None,)], "t string")
    assert [r[0] for r in t.select(text.stemmed(F.col("t"), lambda x: x.rstrip("s"))).collect()] == ["run", "run", None]


# --- title matching: five rules ------------------------------------------------------------------------------------------
def match(spark, claim, titles, **kw):
    pages = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    claims = spark.createDataFrame([(1, claim)], "item_id long, text string")
    found = search.title_matches(search.spans(claims), search.titles(pages, "id", "title"), **kw)
    return [(r.grp, titles[r.doc_id]) for r in found.orderBy("grp", "match_pos").collect()]


def test_title_matching(spark):
    titles = ["Silver_Lark", "Silver_Lark_over_the_Moor", "Quarry_-LRB-radio_play-RRB-", "Quarry_-LRB-disambiguation-RRB-", "Odd", "Silver_Lark"]
    assert match(spark, "Silver Lark over the Moor won", titles) == [(0, "Silver_Lark_over_the_Moor")]
    assert set(match(spark, "Silver Lark over the Moor won", titles, longest_only=False)) == {(0, "Silver_Lark_over_the_Moor"), (0, "Silver_Lark")}
    assert match(spark, "They heard Quarry, twice", titles) == [(1, "Quarry_-LRB-radio_play-RRB-")]
    assert match(spark, "Odd's barn", titles) == [(0, "Odd")] and match(spark, "odd sheds", titles) == []
    assert match(spark, "Quarry (disambiguation) is", titles) == []  # it matches and hides the shorter span, and isn't returned


def test_bm25_by_hand(spark, tmp_path):
    import math

    docs = spark.createDataFrame([(1, "apple apple pear"), (2, "pear plum"), (3, None)], "doc_id long, text string")
    built = ix.build(docs, str(tmp_path / "i"), stopwords=["zzz"])
    got = search.bm25_scores(built, spark.createDataFrame([(9, "Apple pear zzz")], "item_id long, text string")).collect()
    avg = 5 / 3
    w = lambda df, tf, dl: math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert {r.doc_id: round(r.score, 9) for r in got} == {1: round(w(1, 2, 3) + w(2, 1, 3), 9), 2: round(w(2, 1, 2), 9)}


# --- evidence, contexts ------------------------------------------------------------------------------------------------
def test_sets(spark):
    sets = F.array(array("a", "b"), array("c"))
    r = one(
        spark, yes=evidence.covers(sets, array("c", "x")), no=evidence.covers(sets, array("a")), none=evidence.covers(F.slice(sets, 1, 0), array("a")), trivial=evidence.covers(F.array(array()), array()),
        first=evidence.first_covered(sets, array("c", "a", "b")), small=evidence.smallest(sets), ids=evidence.by_number(array("E10", "E9", "E1")), f1=evidence.evidence_f1(array("a", "b"), array("a", "a")), zero=evidence.evidence_f1(array(), array("a")),
        part=evidence.split_id(F.lit("a:b:3")),
    )
    assert (r.yes, r.no, r.none, r.trivial) == (True, False, None, True) and r.first == ["a", "b"] and r.small == ["c"] and r.ids == ["E1", "E9", "E10"]
    assert abs(r.f1 - 2 / 3) < 1e-12 and r.zero == 0 and tuple(r.part) == ("a:b", 3)


def test_contexts(spark):
    pages = spark.createDataFrame([("A_b", [(0, "x"), (3, "y")]), ("C", [(i, f"s{i}") for i in range(30)])], "doc_id string, sentences array<struct<line:int,text:string>>")
    ranked = spark.createDataFrame([(1, 1, "C"), (1, 2, "A_b"), (1, 3, "missing")], "qid long, rank int, doc_id string")
    shown = context.contexts(context.with_sentences(ranked, pages))
    r = shown.select("shown", context.render(F.lit("c"), F.col("shown")).alias("p")).first()
    assert len(r.shown) == 22 and tuple(r.shown[20]) == ("E21", "A_b", 0, "x") and r.p.startswith("Claim: c\n\nEvidence:\nE1 [C] s0\n") and r.p.endswith("E22 [A b] y")
    gold = spark.createDataFrame([(1, [[("A_b", 3)]]), (2, [])], "qid long, sets array<array<struct<page:string,line:int>>>")
    got = context.coverage(shown, gold, spark.createDataFrame([(1, ["C", "A_b"])], "qid long, pages array<string>")).orderBy("qid").collect()
    assert [(x.gold_page_retrieved, x.gold_in_context) for x in got] == [(True, True), (None, None)]
    o = one(spark, p=context.oracle_pages(F.array(F.array(F.struct(F.lit("G").alias("page"), F.lit(1).alias("line")))), array("A", "G", "B"), F.lit(5), 0, 2), q=context.without_pages(array("A", "G", "B", "A"), array("G"), 2))
    assert sorted(o.p) == ["A", "G"] and o.q == ["A", "B"]


# --- parsing -----------------------------------------------------------------------------------------------------------
OUTPUTS = [
    ('{"verdict": "SUPPORTED", "evidence": ["E1"], "confidence": 1}', (True, True, True, True)),
    ('<think>{"verdict": 1}</think> so {"verdict": "REFUTED", "evidence": [], "confidence": true} done', (True, True, True, True)),
    ('{"verdict": "SUPPORTED", "evidence": ["E1", 3], "confidence": 2}', (True, True, False, False)),
    ('{"verdict": "MAYBE", "evidence": [null], "confidence": "1"}', (True, False, False, False)),
    ('{"verdict": "SUPPORTED", "evidence": ["E1\\n"]}', (True, True, False, False)),
    ("[1]", (False, False, False, False)),
    ('{"verdict": ', (False, False, False, False)),
    ('{"verdict": "REFUTED", "evidence": [], "confidence": 0.5} and {x}', (False, False, False, False)),
    ('{"verdict": "REFUTED"}, {"verdict": "REFUTED"}', (False, False, False, False)),
    ('{"verdict": "MAYBE", "verdict": "REFUTED", "evidence": ["x"], "evidence": ["E2"], "confidence": 0.1}', (True, True, True, True)),
    ('{"verdict": "REFUTED", "evidence": ["E2"], "confidence": NaN}', (True, True, True, False)),
    ('{"verdict": "REFUTED", "evidence": ["E2", 3], "confidence": 1e-1}', (True, True, False, True)),
    ("{'verdict': 'REFUTED'}", (False, False, False, False)),
    ('{"verdict": "REFUTED", "evidence": ["E2"], "confidence": 0.5,}', (False, False, False, False)),
    ('{"verdict": {"a": 1}, "evidence": null, "confidence": "0.5", "other": [1, {"b": 2}]}', (True, False, False, False)),
    ("{}", (True, False, False, False)),
    (None, (False, False, False, False)),
]


def test_parse(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(OUTPUTS)], "i int, raw string").select("i", parsing.parse(F.col("raw")).alias("a")).orderBy("i").collect()
    assert [(r.a.json_ok, r.a.verdict_ok, r.a.evidence_ok, r.a.confidence_ok) for r in rows] == [w for _, w in OUTPUTS]
    assert rows[1].a.confidence == 1.0 and rows[0].a.evidence == ["E1"]


def test_reasoning(spark):
    raw = F.lit('<think>E1 and E9</think>{"verdict":"SUPPORTED"}')
    ids = parsing.mentioned(parsing.reasoning(raw, parsing.parse(raw)))
    r = one(spark, ids=ids, ok=parsing.citations_valid(ids, array("E1")), none=parsing.citations_valid(array(), array("E1")), t=parsing.thought(raw), f=parsing.thought(F.lit("<think>\n</think>{}")))
    assert r.ids == ["E1", "E9"] and r.ok is False and r.none is None and r.t and not r.f


CASES = [  # answer fields, gold, reason, repair
    ("The sentence E1 says so, it does.", "supports", ["E1"], True, "SUPPORTED", None, "none"),
    ("The sentence E1 says so, it does.", "supports", ["E9"], True, "SUPPORTED", "citation_mismatch", None),
    ("The sentence E1 says so, it does.", "supports", ["E1"], False, "SUPPORTED", "gold_not_justified_by_context", None),
    ("Only E2 is explained in this text.", "supports", ["E2"], True, "SUPPORTED", "gold_evidence_not_explained", None),
    ("E1 says it and E2 is shown as well.", "supports", ["E1"], True, "SUPPORTED", None, "none"),
    ("The prose doesn't name a sentence.", "supports", ["E1"], True, "SUPPORTED", "citation_mismatch", "citation_append"),
    ("E2 is about something else, really.", "insufficient", [], True, "NOT_ENOUGH_INFO", None, "none"),
    ("E9 is about something else, really.", "insufficient", [], True, "NOT_ENOUGH_INFO", "citation_mismatch", None),
    ("E2 is about something else, really.", "supports", [], True, "SUPPORTED", "citation_mismatch", None),
    ("E2 is about something else, really.", "insufficient", [], False, "NOT_ENOUGH_INFO", "gold_not_justified_by_context", "nei_gold_justified_true"),
    ("The sentence E1 says so, it does.", "refutes", ["E1"], True, "SUPPORTED", "wrong_relation", None),
    ("The sentence E1 says so, it does.", "supports", ["E1", "E1"], True, "SUPPORTED", "duplicate_or_too_many_citations", None),
    ("The sentence E1 says so, it does.", "supports", ["E1", 2], True, "SUPPORTED", "invalid_citation_list", None),
    ("short", "supports", ["E1"], True, "SUPPORTED", "reasoning_length", None),
]


def test_teacher_rules_and_repairs(spark):
    rows = []
    for i, (said, relation, cited, justified, gold, _, _) in enumerate(CASES):
        content = json.dumps({"reasoning": said, "relation": relation, "cited_evidence": cited, "gold_justified": justified})
        target = json.dumps({"verdict": gold, "evidence": ["E1"] if gold == "SUPPORTED" else []})
        rows.append((i, gold, "Claim: c\n\nEvidence:\nE1 [A] one\nE2 [B] two", target, f"```json\n{content}\n```" if i % 2 else content))
    rows.append((99, "SUPPORTED", "Claim: c", "{}", "```json\n{}\n``` and more"))
    table = spark.createDataFrame(rows, "id long, gold string, prompt string, completion string, content string")
    got = {r.id: r for r in datasets.repaired(datasets.validated(table)).collect()}
    assert [(got[i].reason, got[i].repair) for i in range(len(CASES))] == [c[5:] for c in CASES]
    assert got[5].final_reasoning == "The prose doesn't name a sentence (E1)." and got[99].reason == "invalid_json"
    chosen = datasets.filled(datasets.repaired(datasets.validated(table)), 4).where("selected").count()
    assert chosen == 4 and datasets.filled(datasets.repaired(datasets.validated(table)), 9).where("selected").count() == 5


def test_provider_shapes(spark):
    done = F.lit('{"choices":[{"finish_reason":"stop","message":{"content":"hi"}}]}')
    cut = F.lit('{"choices":[{"finish_reason":"length","message":{"content":"hi"}}]}')
    parts = F.lit('{"candidates":[{"finishReason":"STOP","content":{"parts":[{"text":"a"},{"text":"b"}]}}]}')
    r = one(spark, a=parsing.provider_text(done, "choices"), b=parsing.provider_text(cut, "choices"), c=parsing.provider_text(parts, "candidates"))
    assert tuple(r) == ("hi", "", "ab")


# --- rewards -----------------------------------------------------------------------------------------------------------
def total(spark, gold, pred, confidence=0.5, gold_ids=(), cited=(), n_ops=0, name="full", ok=True):
    r = reward.total(F.lit(gold), F.lit(pred), F.lit(confidence), array(*gold_ids), array(*cited), F.lit(n_ops), reward.ABLATIONS[name], F.lit(ok))
    return one(spark, r=r).r["reward"]


def test_brier_is_proper(spark):
    grid = spark.range(101).select((F.col("id") / 100).alias("c"))
    for p in (0.0, 0.25, 0.5, 0.8, 1.0):
        expected = p * reward.calibration(F.lit("SUPPORTED"), F.lit("SUPPORTED"), F.col("c")) + (1 - p) * reward.calibration(F.lit("SUPPORTED"), F.lit("REFUTED"), F.col("c"))
        assert grid.orderBy(expected.desc()).first().c == p


def test_reward_rules(spark):
    assert total(spark, "REFUTED", "SUPPORTED", 0.0) == -0.5 and total(spark, "SUPPORTED", "REFUTED", 0.0) == 0.0 and total(spark, "NEI", "SUPPORTED", 0.0) == -0.75
    assert total(spark, "NEI", "NEI", 1.0) == 1.5 and total(spark, "NEI", "NEI", 1.0, cited=["a"]) == 0.75 and total(spark, "NEI", "SUPPORTED", 0.0, cited=["a"]) == -1.0
    assert total(spark, "SUPPORTED", "SUPPORTED", 1.0, ["a"], ["a"], 3) == pytest.approx(1.44) and total(spark, "SUPPORTED", "REFUTED", 0.0, ["a"], ["a"]) == 0.0
    assert total(spark, "REFUTED", "SUPPORTED", 1.0, name="no_harm") == -0.5 and total(spark, "REFUTED", "REFUTED", 0.0, ["a"], ["a"], name="no_calibration") == 1.5
    assert total(spark, "NEI", "REFUTED", name="format_only") == 1.0 and total(spark, "NEI", "REFUTED", name="format_only", ok=False) == 0.0
    with pytest.raises(ValueError):
        total(spark, "NEI", "NEI", name="random")
    with pytest.raises(ValueError):
        reward.total(*[F.lit(1)] * 6, reward.Config(mode="other"))


def test_reward_of_outputs(spark):
    good = '{"verdict": "NOT_ENOUGH_INFO", "evidence": [], "confidence": 1.0}'
    of = lambda raw, **kw: one(spark, r=reward.of_output(parsing.parse(F.lit(raw)), F.lit(labels.NOT_ENOUGH_INFO), array(), **kw)).r
    assert of(good) == 1.5 and of(good, label_mapping=False) == 1.0 and of("no json") == -2.0 and of("no json", config=reward.ABLATIONS["format_only"]) == 0.0
    assert of('{"verdict": "NOT_ENOUGH_INFO", "evidence": []}', require_confidence=False) == 1.5 and of('<think>open {"verdict": "NOT_ENOUGH_INFO"') == -2.0
    assert of(good, tool_call=F.lit(True)) == -2.0 and of(good, n_ops=F.lit(2)) == pytest.approx(1.46)


def test_label_probs_without_verdict(spark):
    tokens = F.from_json(F.lit('[{"tok":"x","alts":[{"t":"x","lp":-1}]}]'), "array<struct<tok:string,alts:array<struct<t:string,lp:double>>>>")
    assert one(spark, p=parsing.label_probs(tokens)).p is None and one(spark, p=parsing.label_probs(F.slice(tokens, 1, 0))).p is None


# --- metrics -----------------------------------------------------------------------------------------------------------
PREDICTION = "id long, gold string, pred string, correct boolean, fever_score boolean, evidence_f1 double, stated_conf double, token_conf double, gold_in_context boolean"


def predictions(spark, rows):
    return spark.createDataFrame([(i, g, p, g == p, g == p, None, c, c, x) for i, (g, p, c, x) in enumerate(rows)], PREDICTION)


def test_calibration_by_hand(spark):
    rows = predictions(spark, [("SUPPORTED", "SUPPORTED", 1.0, True), ("SUPPORTED", "REFUTED", 1.0, True), ("REFUTED", "REFUTED", 0.5, False), ("NOT_ENOUGH_INFO", None, None, None), ("REFUTED", "SUPPORTED", 0.5, None)])
    assert metrics.brier(rows, "stated_conf").first().brier == 0.375 and metrics.ece(rows, "stated_conf", bins=2).first().ece == 0.25
    risk = {r.target: (r.threshold, r.coverage, r.risk) for r in metrics.risk_at_coverage(rows, "stated_conf").collect()}
    assert risk == {0.5: (1.0, 0.4, 0.5), 0.8: (0.5, 0.8, 0.5), 1.0: (0.5, 0.8, 0.5)}
    table = {r.stratum: r for r in metrics.summarize(rows).collect()}
    assert {k: v.n for k, v in table.items()} == {"all": 5, "gold_in_context": 2, "gold_not_in_context": 1, "gold_nei": 1}
    assert table["gold_nei"].stated_conf_coverage == 0 and table["gold_nei"].stated_conf_ece is None and table["all"].recall_refuted == 0.5


def test_bins_next_to_an_edge(spark):
    rows = predictions(spark, [("SUPPORTED", "SUPPORTED", 0.8999999999999999, True), ("SUPPORTED", "SUPPORTED", 1.0, True)])
    assert sorted(r.bin for r in metrics.reliability(rows, "stated_conf").collect()) == [9]
    assert sorted(r.bin for r in metrics.reliability(rows, "stated_conf", intervals=True).collect()) == [8, 9]


def test_integrity(spark):
    rows = predictions(spark, [("SUPPORTED", "SUPPORTED", 0.5, True)])
    assert metrics.checked(rows).count() == 1
    with pytest.raises(ValueError, match="duplicate_id: 1"):
        metrics.checked(rows.union(rows))
    with pytest.raises(ValueError, match="no_rows"):
        metrics.checked(rows.limit(0))


# --- training sets, sources ------------------------------------------------------------------------------------------------
def test_sampling(spark):
    rows = spark.range(300).select("id", F.element_at(F.array(*map(F.lit, labels.LABELS)), (F.col("id") % 3 + 1).cast("int")).alias("gold"))
    a = datasets.balanced(rows, 100).collect()
    assert sorted(r.id for r in a) == sorted(r.id for r in datasets.balanced(rows.repartition(7), 100).collect())
    assert datasets.per_class(rows, 0).count() == 300 and datasets.per_class(rows, 5).count() == 15
    with pytest.raises(ValueError):
        datasets.per_class(rows, 101)


def test_disjoint_split_gates(spark):
    source = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, x string")
    frozen = spark.createDataFrame([("9",)], "id string")
    assert sorted(r.id for r in datasets.disjoint_split(source, source.where("id = 2"), frozen).collect()) == [1, 3]
    for second, held in ((source.where("id = 2").withColumn("x", F.lit("z")), frozen), (source.limit(0), spark.createDataFrame([("3",)], "id string"))):
        with pytest.raises(ValueError):
            datasets.disjoint_split(source, second, held)
    assert tuple(datasets.set_difference(spark.createDataFrame([(1,), (1,), (4,)], "id long"), source, "id").first()) == (2, 1, 1)


def test_cot_gate(spark):
    rows = spark.createDataFrame([(1, "SUPPORTED", '{"reasoning":"r","verdict":"SUPPORTED","evidence":["E1"]}'), (2, "REFUTED", '{"reasoning":" ","verdict":"SUPPORTED","evidence":1,"confidence":1}')], "id long, gold string, completion string")
    found = {r.problem: r.n for r in datasets.cot_problems(rows, spark.createDataFrame([(2,)], "id long"), 3).collect()}
    assert found == {"no_reasoning": 1, "other_verdict": 1, "no_evidence_list": 1, "confidence_key": 1, "frozen_id": 1, "wrong_count": 2}
    assert datasets.cot_problems(rows.where("id = 1")).count() == 0


def test_examples(spark):
    item = "array<struct<eid:string,page:string,line:int,text:string>>"
    rows = spark.createDataFrame([(1, "c", "SUPPORTED", [[("A", 1)]], [("E1", "A", 0, "x"), ("E2", "A", 1, "y")], True), (2, "c", "REFUTED", [[("B", 1)]], [], False), (3, "c", "NOT_ENOUGH_INFO", [], [("E1", "A", 0, "x")], None)], f"id long, claim string, gold string, sets array<array<struct<page:string,line:int>>>, shown {item}, gold_in_context boolean")
    got = {r.id: json.loads(r.completion) for r in datasets.examples(rows).collect()}
    assert got == {1: {"verdict": "SUPPORTED", "evidence": ["E2"], "confidence": 1.0}, 3: {"verdict": "NOT_ENOUGH_INFO", "evidence": [], "confidence": 1.0}}


def test_sources(spark, tmp_path):
    (tmp_path / "wiki-1.jsonl").write_text('{"id":"A","text":"t","lines":"0\\tx"}\n\n{"id":"","text":"t"}\n{"id":"B","text":null}\n')
    assert [r.id for r in io.read_pages(spark, f"{tmp_path}/wiki-*.jsonl").collect()] == ["A"]
    (tmp_path / "claims.jsonl").write_text('{"id":7,"claim":"Ada wrote a book.","label":"SUPPORTS","evidence":[[[0,0,"Ada",0]]]}\n')
    c = io.read_claims(spark, f"{tmp_path}/claims.jsonl").select("id", evidence.gold_sets(F.col("label"), F.col("evidence")).alias("s")).first()
    assert c.id == 7 and [[tuple(e) for e in s] for s in c.s] == [[("Ada", 0)]]
    (tmp_path / "ids.json").write_text('{"seed": 0,\n "ids": [1, 2]}')
    assert io.read_id_list(spark, f"{tmp_path}/ids.json").count() == 2
    rows = spark.createDataFrame([(1, None), (2, "é")], "id long, x string")
    io.write_jsonl(rows, f"{tmp_path}/out")
    assert io.read_jsonl(spark, f"{tmp_path}/out", rows.schema).orderBy("id").collect() == rows.collect()
    for _ in range(2):
        io.append_new(rows, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2 and io.undone(rows, rows.where("id = 1")).first().id == 2
    io.write_document(rows.limit(1), f"{tmp_path}/m")
    with pytest.raises(Exception, match="exist"):
        io.write_document(rows.limit(1), f"{tmp_path}/m")
    assert io.file_digests(spark, f"{tmp_path}/ids.json").count() == 1 and io.row_digest(rows, "id", "x").first() == io.row_digest(rows.repartition(3), "id", "x").first()
    io.write_pages(spark.createDataFrame([("A", "0\tx")], "id string, lines string"), f"{tmp_path}/store", 4)
    assert io.lookup(spark.read.parquet(f"{tmp_path}/store"), spark.createDataFrame([("A",), ("Z",)], "id string"), "id").count() == 1


def test_streams(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,int(id)) AS ts, id % 3 AS user_id, 'a' AS event_type, 1.0D AS value, '{}' AS props FROM range(50)")
    rows.union(rows).write.parquet(f"{tmp_path}/in")
    schema = catalogue._EVENTS
    for _ in range(2):
        resume.resumed(streams.read(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/state", "event_id", strict=False).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 50
    q = streams.deduplicated(streams.read(spark, f"{tmp_path}/in", schema), "event_id").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 50


# --- models, episodes, traces ------------------------------------------------------------------------------------------
SENTENCES = [("s0", "Blue kilns stand beside the harbour, Ostrava."), ("s1", "Blue kilns cooled down before winter."), ("s2", "Ostrava has a harbour.")]
CLAIMS = "id long, claim string, gold string, gold_ids array<string>"


def sentence_rows(spark):
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(SENTENCES)], "sid string, text string, place int")


def played(spark, claim, policy):
    rows = spark.createDataFrame([(1, claim, "SUPPORTED", ["s0"])], CLAIMS)
    return episodes.episodes(rows, sentence_rows(spark), policy).first()


def test_episode_rules(spark):
    r = played(spark, "Blue kilns stand in Ostrava.", episodes.listed(1, 0, 2, 4))
    assert (r.pred, r.confidence, r.n_ops, r.actions, r.decomposed) == ("SUPPORTED", 0.9, 4, [1, 0, 2, 4], True) and r.cited == ["s0", "s1"]
    r = played(spark, "x", episodes.listed(*[0] * 20))
    assert (r.pred, r.confidence, r.n_ops, r.cited) == ("NEI", 0.5, 8, [])
    r = played(spark, "Ostrava shines and winter cooled", episodes.listed(1, 0, 7))
    assert (r.pred, r.confidence, r.cited) == ("REFUTED", 0.4, ["s2", "s0"])  # the second operation asks for the first part of two
    r = played(spark, "Blue kilns", episodes.listed(0, 0, 0, 5))
    assert r.cited == ["s0", "s1"] and r.n_ops == 4  # nothing is cited twice


def test_random_policy_and_called_policies(spark):
    rows = spark.createDataFrame([(i, t, "SUPPORTED", [s]) for i, (s, t) in enumerate(SENTENCES)] + [(9, None, "NEI", [])], CLAIMS)
    a, b = (episodes.episodes(rows, sentence_rows(spark), episodes.random_policy(seed)).orderBy("id").collect() for seed in (1, 1))
    assert a == b and all(0 <= x < 8 for r in a for x in r.actions) and all(len(r.actions) == r.n_ops <= 8 for r in a)

    def choose(obs, ops, key):
        return 0 if ops < 2 else 2 if obs[2] == 0 and ops < 3 else 3 if key == "2" else 4

    called = episodes.episodes(rows, sentence_rows(spark), episodes.Called(choose)).orderBy("id").collect()
    assert [r.actions for r in called] == [[0, 0, 2, 4], [0, 0, 2, 4], [0, 0, 2, 3], [0, 0, 2, 4]] and called[2].cited == []


def test_episodes_table(spark):
    claims = spark.createDataFrame([(1, "Blue kilns stand in Ostrava.", "SUPPORTED", ["s0"]), (2, "Nothing matches here", "NEI", [])], CLAIMS)
    rows = episodes.episodes(claims, sentence_rows(spark))
    got = {r.id: r for r in rows.collect()}
    assert got[1].pred == "SUPPORTED" and got[2].pred == "NEI" and got[2].cited == [] and got[2].reward["evidence"] == 1.0
    assert episodes.summary(rows).first().accuracy == 1.0 and episodes.reliability(rows).count() == 2
    obs = F.array(*[F.lit(x) for x in (0.5, 0.4, 0.3, 0.2, 0.0, 0.0, 0.5, 0.8)])
    assert one(spark, a=episodes.heuristic(obs)).a == 4
    assert episodes.episodes(claims.limit(0), sentence_rows(spark)).count() == 0 and episodes.episodes(claims, sentence_rows(spark).limit(0)).where("pred = 'NEI'").count() == 2


def test_traces(spark):
    r = one(spark, a=traces.final_action(F.lit("NOT_ENOUGH_INFO")), b=traces.final_action(F.lit(None).cast("string")), m=traces.numbered_rollout(F.array(array("p:1", "p:2"), array("p:2", "q:1"))))
    assert (r.a, r.b) == ("abstain", "commit") and r.m == {"E1": "p:1", "E2": "p:2", "E3": "q:1"}


def test_stub_model(spark):
    rows = spark.createDataFrame([(1, "Claim: The tower stands\n\nEvidence:\nE1 [T] The tower stands here"), (2, "Claim: x\n\nEvidence:\n")], "id long, prompt string")
    got = {r.id: r.text for r in inference.generate(rows, inference.Stub).collect()}
    assert "SUPPORTED" in got[1] and "NOT_ENOUGH_INFO" in got[2]


def test_search_function_in_sql(spark):
    search.register_search(spark, "toy_search", sentence_rows(spark), 2)
    assert [r.sid for r in spark.sql("SELECT * FROM toy_search('The harbour of Ostrava.')").collect()] == ["s2", "s0"]
    assert spark.sql("SELECT * FROM toy_search('nothing')").count() == 0


def test_ordered_lookup_raises(spark):
    ids = spark.createDataFrame([(0, 2), (1, 9)], "pos int, id long")
    rows = spark.createDataFrame([(2, "x")], "id long, v string")
    with pytest.raises(Exception, match="no row for id 9"):
        datasets.ordered_lookup(ids, rows).collect()
    assert datasets.ordered_lookup(ids.limit(1), rows).first().v == "x"


def test_prompts_and_labels(spark):
    rows = spark.createDataFrame([(1, "NOT_ENOUGH_INFO", "p", '{"verdict":"NOT_ENOUGH_INFO","evidence":["E2"]}')], "id long, gold string, prompt string, completion string")
    r = datasets.prompts(rows, 5, "sys").first()
    assert [tuple(m) for m in r.prompt] == [("system", "sys"), ("user", "p")] and (r.gold, r.gold_eids) == ("NEI", ["E2"])
    names = one(spark, a=parsing.run_label(F.lit("y,x/exp-1/runs/run2/artifacts/checkpoints/")), b=parsing.run_label(F.lit("some/adapter/")))
    assert tuple(names) == ("exp-1_run2", "adapter")
