"""Operators that read or move a part of their input: the same rows as plain versions, and what their plans leave out."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryException

from factloom.functions import stemming, text
from factloom.operators import context, datasets, metrics, overlap, pruned, search, tablefunctions
from factloom.operators import index as ix
from factloom.plans import catalogue, views
from factloom.plans.stemming_sql import stems_sql
from factloom.sources import io
from factloom.streaming import resume


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(rng, n, vocabulary):
    return " ".join(f"w{min(int(rng.expovariate(0.05)), vocabulary)}x" for _ in range(n))


# --- retrieval -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("k", "first", "tried"), [(5, 3000, 16), (3, 5, 1), (1, 1, 1)])
def test_pruned_equals_full(spark, tmp_path, k, first, tried, monkeypatch):
    monkeypatch.setattr(pruned, "FIRST", first)
    monkeypatch.setattr(pruned, "TRIED", tried)
    rng = random.Random(1)
    docs = [(i, words(rng, rng.randint(1, 60), 150)) for i in range(400)] + [(400 + i, "same words here") for i in range(8)] + [(500, None), (501, "")]
    asked = [(i, words(rng, rng.randint(1, 12), 150)) for i in range(15)] + [(20, "same here"), (21, None), (22, "nowhere"), (23, " ".join(f"w{i}x" for i in range(90)))]
    built = ix.build(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "i"), k1=1.2, b=0.6)
    queries = spark.createDataFrame(asked, "item_id long, text string")
    shown = lambda df: sorted((r.qid, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())
    found = pruned.pruned_top_k(built, queries, k)
    full = search.bm25_scores(built, queries, k1=1.2, b=0.6)
    assert shown(found.rows) == shown(search.top_k(full, k))
    assert found.all_postings == sum(r.df for r in search.query_terms(queries, "item_id", "text").join(built.terms, "term").collect())
    assert ix.load(spark, str(tmp_path / "i")).k1 == 1.2


def test_pruned_reads_few_postings(spark, tmp_path):
    """Texts that hold a query word for word among many that share its common words."""
    rng = random.Random(2)
    asked = [(i, words(rng, 30, 4000)) for i in range(5)]
    docs = [(i, words(rng, rng.randint(50, 200), 4000)) for i in range(1500)] + [(2000 + 10 * i + j, asked[i][1] + f" extra{j}") for i in range(5) for j in range(6)]
    built = ix.build(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "i"))
    found = pruned.pruned_top_k(built, spark.createDataFrame(asked, "item_id long, text string"), 5)
    assert {r.doc_id // 10 - 200 for r in found.rows.collect()} == set(range(5))
    assert sum(found.read) < 0.2 * found.all_postings


def test_scores_are_summed_and_compared_where_they_are_read(spark, tmp_path):
    """What moves is the best k of each part, not a score for each query and document; the same holds of an index that another session loads."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, words(rng, 20, 60)) for i in range(200)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, words(rng, 5, 60)) for i in range(4)], "item_id long, text string")
    ix.build(docs, str(tmp_path / "i"))
    spark.sql(f"DROP TABLE {ix._table(str(tmp_path / 'i'))}")
    index = ix.load(spark, str(tmp_path / "i"))
    best = search.top_k(search.bm25_scores(index, queries), 3)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Exchange hashpartitioning") == 1
    want = {(r.qid, r.doc_id): round(r.score, 9) for r in best.collect()}
    got = {(r.qid, r.doc_id): round(r.score, 9) for r in search.bm25_scores(index, queries, pairs=best.select("qid", "doc_id")).collect()}
    assert len(want) == 12 and got == want


def test_index_goes_through_texts_once(spark, tmp_path):
    """Documents count once for each row, those without a term too; levels of impact are made when they are read."""
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "bb"), (3, ""), (4, None), (4, None)], "doc_id long, text string")
    index = ix.build(docs, str(tmp_path / "i"))
    assert sorted(p.name for p in (tmp_path / "i").iterdir()) == ["analyzer", "corpus", "postings", "terms"]
    assert index.corpus.first()["n"] == 5 and index.corpus.first()["avgdl"] == 0.8
    assert {(r.doc_id, r.dl, r.term, r.tf) for r in index.postings.collect()} == {(1, 3, "aa", 2), (1, 3, "bb", 1), (2, 1, "bb", 1)}
    assert {(r.term, r.df, r.cf) for r in index.terms.collect()} == {("aa", 1, 2), ("bb", 2, 2)}
    assert index.levels.agg(F.sum("n")).first()[0] == 3
    nothing = ix.build(docs.where("doc_id > 9"), str(tmp_path / "none"))
    assert nothing.corpus.first()["n"] == 0 and search.best_k(nothing, docs.withColumnRenamed("doc_id", "item_id"), 3).count() == 0


@pytest.mark.parametrize(("share", "k"), [(1, 3), (4, 3), (32, 1), (1000, 5)])
def test_best_equals_top_of_all(spark, tmp_path, share, k, monkeypatch):
    """A bound from a part of the documents drops scores before they are sorted, none of the best."""
    monkeypatch.setattr(search, "SHARE", share)
    rng = random.Random(5)
    docs = [(i, words(rng, rng.randint(1, 30), 60)) for i in range(300)] + [(300 + i, "same words here") for i in range(40)] + [(500, None), (501, "")]
    asked = [(i, words(rng, rng.randint(1, 8), 60)) for i in range(8)] + [(20, "same here"), (21, None), (22, "nowhere")]
    index = ix.build(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "i"))
    queries = spark.createDataFrame(asked, "item_id long, text string")
    shown = lambda df: sorted((r.qid, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())
    best = search.best_k(index, queries, k)
    assert plan_of(best).count("Exchange hashpartitioning") == 1
    assert shown(best) == shown(search.top_k(search.bm25_scores(index, queries), k))


def test_gold_pages_hold_claims_word_for_word(spark, tmp_path):
    """A claim's ends may be parts of a text's words, and claims of one word or none have only ends."""
    docs = spark.createDataFrame([(1, "xalpha mid omegax"), (2, "alpha mid omega"), (3, "mid alpha"), (4, "omega"), (5, None)], "doc_id long, text string")
    claims = spark.createDataFrame([(1, "alpha mid omega"), (2, "pha"), (3, ""), (4, None), (5, "alpha gone omega")], "item_id long, text string")
    found = views.gold_pages(ix.build(docs, str(tmp_path / "i")), docs, claims)
    assert sorted((r.qid, r.doc_id) for r in found.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3), (3, 4)]


def test_only_shown_pages_are_decoded(spark, tmp_path):
    """No filter on decoded sentences goes below the join with the pages that are shown."""
    spark.createDataFrame([(i, f"one {i}\n\ntwo") for i in range(20)] + [(20, "")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    ranked = spark.createDataFrame([(1, 1, 3), (1, 2, 20)], "qid long, rank int, doc_id long")
    shown = context.with_sentences(ranked, views.sentences(spark.read.parquet(str(tmp_path / "d"))))
    assert sorted((r.doc_id, r.line, r.text, r.pos) for r in shown.collect()) == [(3, 0, "one 3", 0), (3, 2, "two", 1)]
    filters = [x for x in shown._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x]
    assert filters and not [x for x in filters if "split(" in x or "size(" in x]


def test_first_threshold_keeps_pace_with_copies(spark, tmp_path, monkeypatch):
    """As a table grows, so do the postings that give the first threshold; with a fixed number of them most documents would stay candidates."""
    monkeypatch.setattr(pruned, "FIRST", 20)
    rng = random.Random(6)
    texts = [words(rng, 40, 100) for _ in range(60)]
    index = ix.build(spark.createDataFrame([(1000 * c + i, t) for c in range(20) for i, t in enumerate(texts)], "doc_id long, text string"), str(tmp_path / "i"))
    queries = spark.createDataFrame([(i, words(rng, 10, 100)) for i in range(5)], "item_id long, text string")
    found = pruned.pruned_top_k(index, queries, 3)
    monkeypatch.setattr(pruned, "FIRST_SHARE", 0)
    fixed = pruned.pruned_top_k(index, queries, 3)
    assert found.rows.select("qid", "doc_id").exceptAll(fixed.rows.select("qid", "doc_id")).isEmpty()
    assert found.read[3] < fixed.read[3]


def test_outputs_are_parsed_once(spark, tmp_path):
    """An optimized plan that repeats the parser for every field grows many times over, and so does the time for a row."""
    rows = spark.range(8).selectExpr("id AS event_id", "id AS user_id", "'click' AS event_type", "1.0D AS value", "'{}' AS props")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    plan = catalogue.QUERIES["reward_of_outputs"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    projects = [x for x in plan.split("\n") if "Project" in x]
    assert [x for x in projects if " AS a#" in x] and "AS reward#" in projects[0] and "from_json" not in projects[0]


def test_stems_of_arrays(spark):
    rows = spark.createDataFrame([(1, ["runs", "run", "ss", "x"]), (2, []), (3, ["ss"])], "id long, t array<string>")
    got = {r[0]: r[1] for r in rows.select("id", text.stemmed_all(F.col("t"), lambda w: w.rstrip("s"))).collect()}
    assert got == {1: ["run", "run", "x"], 2: [], 3: []}


# A part of the vocabulary that the algorithm's authors published, word and stem.
STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist
consolation consol consolatory consolatori consolidate consolid consoling consol consolingly consol consonant conson consort consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci
conspirator conspir conspiring conspir constable constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knavish knavish kneaded knead kneading knead
knee knee kneel kneel kneeled kneel knees knee knell knell knelt knelt knives knive knitted knit knitting knit knocker knocker knocking knock knots knot""".split()


def test_stems():
    assert {w: stemming.english_stem(w) for w in STEMS[::2]} == dict(zip(STEMS[::2], STEMS[1::2], strict=True))
    more = {"skies": "sky", "dying": "die", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "hopped": "hop", "hoping": "hope", "generously": "generous", "communication": "communic", "by": "by", "say": "say", "happy": "happi", "proceed": "proceed", "innings": "inning", "été": "été", "a": "a", "yy": "yy"}
    assert {w: stemming.english_stem(w) for w in more} == more


def test_stems_equal_sql():
    """Two versions written apart agree on made-up words with the suffixes of every step."""
    rng = random.Random(3)
    ends = ["", "s", "es", "ies", "ied", "us", "ss", "sses", *stemming.VERBAL, *stemming.STEP_2, *stemming.STEP_3, *stemming.STEP_4, "e", "ll", "y", "ly", "d", "lation"]
    starts = ["", "gener", "commun", "arsen", "y", "be", "kl", "ta", "ou", "ey", "tray", "hop", "inn", "pp", "sky"]
    made = {rng.choice(starts) + "".join(rng.choice("aeiouybtlrsng") for _ in range(rng.randint(0, 5))) + rng.choice(ends) + rng.choice(ends) for _ in range(20000)}
    made |= {*stemming.SPECIAL, *stemming.KEPT_AFTER_PLURAL, *(w + "s" for w in stemming.KEPT_AFTER_PLURAL)}
    made.discard("")
    con = duckdb.connect()
    con.execute("CREATE TABLE w (t VARCHAR)")
    con.executemany("INSERT INTO w VALUES (?)", [(w,) for w in sorted(made)[:6000]])
    got = dict(con.sql(f"WITH {stems_sql('w')} SELECT t, stem FROM stems").fetchall())
    assert got == {w: stemming.english_stem(w) for w in sorted(made)[:6000]}


def test_overlap_equals_all_pairs(spark):
    rng = random.Random(4)
    held = [(i, words(rng, rng.randint(0, 40), 80)) for i in range(300)] + [(300, None), (301, ""), (302, "the of")]
    asked = [(i, words(rng, rng.randint(1, 15), 80)) for i in range(25)] + [(30, held[7][1]), (31, None), (32, "unheard"), (33, "The, w1x w1x.")]
    sets = lambda rows: {i: {w.strip(".,").lower() for w in (t or "").split()} - set(text.TOY_STOPWORDS) for i, t in rows}
    want = []
    for q, a in sets(asked).items():
        pairs = sorted((-round(len(a & b) / len(a | b), 9), s) for s, b in sets(held).items() if a & b)[:3]
        want += [(q, s, -j, n + 1) for n, (j, s) in enumerate(pairs)]
    q, s = spark.createDataFrame(asked, "q long, t string"), spark.createDataFrame(held, "s long, t string")
    found = overlap.overlaps(q, s, 3, "q", "t", "s", "t")
    assert sorted((r.qid, r.sid, round(r.score, 9), r["rank"]) for r in found.rows.collect()) == sorted(want)
    met = sum(bool(a & b) for a in sets(asked).values() for b in sets(held).values())
    assert found.candidates.count() < met


def test_table_functions(spark):
    tablefunctions.register(spark)
    pairs = spark.createDataFrame([(q, s, float(s % 4), "x") for q in range(3) for s in range(9)], "qid long, sid long, score double, more string")
    got = spark.sql("SELECT qid, sid, more, rank FROM best_rows(TABLE({p}), 3)", p=pairs).collect()
    assert sorted(map(tuple, got)) == sorted((q, s, "x", n + 1) for q in range(3) for n, s in enumerate((3, 7, 2)))
    for bad in ("best_rows(TABLE({p}), 0)", "best_rows(TABLE({p}), 'x')", "best_rows(1, 2)"):
        with pytest.raises(Exception, match="argument"):
            spark.sql(f"SELECT * FROM {bad}", **({"p": pairs} if "{p}" in bad else {})).collect()
    claims = spark.createDataFrame([(1, "The Silver_Lark's end, again."), (2, None), (3, "")], "id long, t string")
    got = {(r.id, r.i, r.j, r.form) for r in spark.sql("SELECT c.id, s.* FROM {c} c, LATERAL claim_spans(c.t, false) s", c=claims).collect()}
    want = {(r.qid, r.i, r.j, r.form) for r in search.spans(claims, "id", "t").collect()}
    assert got == want and (1, 1, 2, "silver lark") in got


def test_titles_are_filtered_before_they_move(spark):
    titles = spark.createDataFrame([(i, f"title {i}") for i in range(5000)] + [(9999, None)], "doc_id long, form string")
    spans = spark.createDataFrame([(q, f"title {i}") for q, i in enumerate(range(0, 5000, 50))] + [(q, f"other {q}") for q in range(100, 5000)], "qid long, form string")
    kept = search.maybe_known(spans, search.known_forms(titles))
    rows = {r.qid for r in kept.collect()}
    assert set(range(100)) <= rows and len(rows) < 110 and kept.columns == ["qid", "form"]
    after = plan_of(kept).split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in after and "SortMergeJoin" not in after


# --- sources ---------------------------------------------------------------------------------------------------------
def test_lookup_reads_only_the_parts_it_needs(spark, tmp_path):
    pages = spark.createDataFrame([(f"p{i}", f"text {i}") for i in range(500)] + [(None, "none")], "id string, lines string")
    io.write_pages(pages, f"{tmp_path}/store", 32)
    found = io.lookup(spark.read.parquet(f"{tmp_path}/store"), spark.createDataFrame([("p7",), ("p8",), ("zzz",)], "id string"))
    assert sorted(map(tuple, found.select("id", "lines").collect())) == [("p7", "text 7"), ("p8", "text 8")] and found.columns == ["id", "lines"]
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ IN|PartitionFilters: \[.*bucket#\d+ INSET", plan_of(found))
    read = {r[0] for r in found.select(F.input_file_name()).collect()}
    assert len(read) <= 2
    assert io.lookup(spark.read.parquet(f"{tmp_path}/store"), spark.createDataFrame([], "id string")).count() == 0


def _in_batches(spark, folder, ids, name):
    for n, part in enumerate(ids):
        spark.createDataFrame([(i, f"v{i}", None) for i in part], "id long, v string, n int").coalesce(1).write.parquet(f"{folder}/{name}{n}")


def _stream(spark, folder):
    return spark.readStream.schema("id long, v string, n int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_resume_reads_each_batch_once_and_stops_at_a_repeat(spark, tmp_path):
    source, target, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    _in_batches(spark, source, [range(0, 10), range(10, 20), range(20, 30)], "a")
    q = resume.resumed(_stream(spark, source), target, state, "id")
    q.awaitTermination()
    assert [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]] == [10, 10, 10]  # nothing of the target is read
    _in_batches(spark, source, [range(30, 35)], "b")
    q = resume.resumed(_stream(spark, source), target, state, "id")
    q.awaitTermination()
    assert [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]] == [5]
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(35))
    _in_batches(spark, source, [[7], [40]], "c")
    with pytest.raises(StreamingQueryException, match="repeated id: 7"):
        resume.resumed(_stream(spark, source), target, state, "id").awaitTermination()
    assert 40 not in {r.id for r in spark.read.parquet(target).collect()}  # stopped at the first failure


def test_resume_goes_on_after_a_failure(spark, tmp_path):
    source, target, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    _in_batches(spark, source, [[1, 2], [2, 3], [4]], "a")
    broken = lambda rows: rows.withColumn("v", F.when(F.col("id") == 3, F.raise_error(F.lit("no answer"))).otherwise(F.col("v")))
    with pytest.raises(StreamingQueryException, match="no answer"):
        resume.resumed(_stream(spark, source), target, state, "id", strict=False, work=broken).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2]
    resume.resumed(_stream(spark, source), target, state, "id", strict=False).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2, 3, 4]


# --- sets and sums ---------------------------------------------------------------------------------------------------
def test_differing_counts_repeats_and_moves_digests(spark):
    schema = "id long, text string, n double"
    source = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (2, "b", None), (3, None, 2.0), (None, "x", 0.0), (5, "ab", 1.0)], schema)
    subset = spark.createDataFrame([(1, "a", 1.0)] * 3 + [(2, "b", None), (3, "", 2.0), (None, "x", 0.0), (5, "ab", 2.0)], schema)
    want = sorted(map(str, subset.exceptAll(source).collect()))
    assert sorted(map(str, datasets.differing(subset, source).collect())) == want and len(want) == 3
    assert datasets.differing(source, source).isEmpty()


def test_risk_over_continuous_confidences(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice([None, rng.random(), rng.gauss(5, 100), 0.5]), rng.random() < 0.6) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, c double, correct boolean")
    want = set()
    for g in "ab":
        own = [r for r in rows if r[0] == g]
        said = sorted((r for r in own if r[1] is not None), key=lambda r: -r[1])
        for target in (0.5, 0.8, 1.0):
            t = next(c for c in sorted({r[1] for r in said}, reverse=True) if sum(r[1] >= c for r in said) / len(said) >= target)
            taken = [r for r in said if r[1] >= t]
            want.add((g, target, t, round(len(taken) / len(own), 9), round(1 - sum(r[2] for r in taken) / len(taken), 9)))
    found = metrics.risk_at_coverage(df, "c", "g", targets=(0.5, 0.8, 1.0))
    assert {(r.g, r.target, r.threshold, round(r.coverage, 9), round(r.risk, 9)) for r in found.collect()} == want
    for df in (found, metrics.risk_at_coverage(df, "c")):
        assert not re.search(r"windowspecdefinition\((?!g|__range)[^)]*threshold", plan_of(df))
