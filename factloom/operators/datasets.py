"""Training sets: balanced samples, disjoint splits, leakage gates, teacher validation and repair, evidence ablation, load gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import evidence, parsing
from ..functions.labels import LABELS, NOT_ENOUGH_INFO
from ..functions.text import seeded
from ..sources.staging import staged


def _ranked(rows: DataFrame, group: Column, seed: int | str, id_col: str) -> DataFrame:
    order = Window.partitionBy(group).orderBy(seeded(seed, F.col(id_col)), F.col(id_col))
    return rows.withColumn("__rank", F.row_number().over(order))


def balanced(rows: DataFrame, n: int, label: str = "gold", id_col: str = "id", seed: int | str = 0, classes: list[str] | None = None) -> DataFrame:
    """n rows, an equal part of each class and one more of the first classes for the remainder, chosen by a seeded order of ids."""
    classes = classes or LABELS
    quota = F.coalesce(*[F.when(F.col(label) == c, F.lit(n // len(classes) + (k < n % len(classes)))) for k, c in enumerate(classes)])
    # The literal bound lets Spark cut each class in every task before rows of a class meet in one.
    ranked = _ranked(rows.where(F.col(label).isin(classes)), F.col(label), seed, id_col).where(F.col("__rank") <= -(-n // len(classes)))
    return ranked.where(F.col("__rank") <= quota).drop("__rank")


def per_class(rows: DataFrame, n: int, label: str = "gold", id_col: str = "id", seed: int | str = 0, classes: list[str] | None = None) -> DataFrame:
    """n rows of each class, all of them if n is 0; too few of a class is an error."""
    classes = classes or LABELS
    if n == 0:
        return rows.where(F.col(label).isin(classes))
    have = {r[0]: r[1] for r in rows.where(F.col(label).isin(classes)).groupBy(label).count().collect()}
    if short := {c: have.get(c, 0) for c in classes if have.get(c, 0) < n}:
        raise ValueError(f"{n} rows of each class are asked for, there are {short}")
    return balanced(rows, n * len(classes), label, id_col, seed, classes)


def seeded_prefix(rows: DataFrame, n: int, id_col: str = "id", seed: int | str = 0) -> DataFrame:
    """The first n rows in a seeded order of ids."""
    return rows.orderBy(seeded(seed, F.col(id_col)), F.col(id_col)).limit(n)


def split(rows: DataFrame, second: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows that the second stage doesn't have."""
    return rows.join(second.select(id_col), id_col, "left_anti")


def leaked(rows: DataFrame, frozen: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id, as a string, is in the frozen set. It must be empty."""
    held = frozen.select(F.col(frozen.columns[0]).cast("string").alias("__held")).distinct()
    return rows.join(held, F.col(id_col).cast("string") == F.col("__held"), "left_semi")


def duplicated(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) that more than one row has."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def differing(subset: DataFrame, source: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of the subset that aren't in the source with equal values in every column, repeats counted.

    Both sides are compared by id and a digest of the row; no other column of a row moves unless the row differs.
    """
    key = lambda t: t.select(id_col, _row_digest(t, source.columns).alias("__digest"))
    sides = key(subset).withColumn("__n", F.lit(1)).unionByName(key(source).withColumn("__n", F.lit(-1)))
    surplus = sides.groupBy(id_col, "__digest").agg(F.sum("__n").alias("__surplus")).where("__surplus > 0")
    rows = subset.select(*source.columns, _row_digest(subset, source.columns).alias("__digest"))
    surplus = surplus.withColumnRenamed(id_col, "__id")
    rows = rows.join(surplus, rows[id_col].eqNullSafe(surplus["__id"]) & (rows["__digest"] == surplus["__digest"])).drop(surplus["__digest"])
    nth = F.row_number().over(Window.partitionBy(id_col, "__digest").orderBy(F.lit(0)))
    return rows.withColumn("__nth", nth).where("__nth <= __surplus").select(*source.columns)


def _row_digest(rows: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of a row's values with their lengths; null differs from every value."""
    text = lambda c: F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit(""))
    return F.unhex(F.sha2(F.concat(*[F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)) for c in columns]), 256))


def set_difference(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """(missing, extra, repeated): ids of the right that the left lacks, ids it has beyond, and its surplus repeats; all 0 if equal."""
    a, b = left.select(F.col(column).alias("id")), right.select(F.col(column).alias("id"))
    sides = a.groupBy("id").agg(F.count("*").alias("a")).join(b.distinct().withColumn("b", F.lit(1)), "id", "full")
    return sides.agg(F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("b").isNull()).alias("extra"), F.coalesce(F.sum(F.col("a") - 1), F.lit(0)).alias("repeated"))


def disjoint_split(source: DataFrame, second: DataFrame, frozen: DataFrame, id_col: str = "id") -> DataFrame:
    """The complement of ``second`` in ``source``, once ids are unique, second rows equal their sources and no frozen id is in either."""
    for what, bad in (("repeated ids", duplicated(source, id_col)), ("rows that differ from the source", differing(second, source, id_col)), ("frozen ids", leaked(source, frozen, id_col))):
        if not bad.isEmpty():
            raise ValueError(f"{what}: {bad.count()}")
    return split(source, second, id_col)


def target(verdict: Column, eids: Column, confidence: float | None = 1.0) -> Column:
    """A training target as a JSON string; without ``confidence`` the field is left out."""
    fields = [verdict.alias("verdict"), eids.alias("evidence")] + ([F.lit(confidence).alias("confidence")] if confidence is not None else [])
    return F.to_json(F.struct(*fields))


def examples(rows: DataFrame) -> DataFrame:
    """(id, gold, prompt, completion, gold_in_context, n_shown) from claims with contexts; claims whose gold evidence isn't shown drop out.

    ``rows`` has id, claim, gold, sets of (page, line), shown, gold_in_context. The target cites the first set that is shown, in numeric order.
    """
    from .context import render

    keys = F.transform("shown", lambda s: F.struct(s["page"].alias("page"), s["line"].alias("line")))
    chosen = evidence.first_covered(F.col("sets"), keys)
    named = F.filter("shown", lambda s: F.array_contains(chosen, F.struct(s["page"].alias("page"), s["line"].alias("line"))))
    eids = F.coalesce(evidence.by_number(F.transform(named, lambda s: s["eid"])), F.array().cast("array<string>"))
    kept = rows.where((F.col("gold") == NOT_ENOUGH_INFO) | F.col("gold_in_context"))
    return kept.select("id", "gold", render(F.col("claim"), F.col("shown")).alias("prompt"), target(F.col("gold"), eids).alias("completion"), "gold_in_context", F.size("shown").alias("n_shown"))


def shown_ids(prompt: Column) -> Column:
    """The evidence ids that a prompt's lines start with."""
    return F.array_distinct(F.regexp_extract_all(prompt, F.lit(r"(?m)^(E\d+)\b"), F.lit(1)))


def target_ids(completion: Column) -> Column:
    return F.from_json(F.get_json_object(completion, "$.evidence"), "array<string>")


def validated(rows: DataFrame) -> DataFrame:
    """``rows`` (id, gold, prompt, completion, content) plus the answer's fields and the reason of rejection, null if accepted."""
    rows = rows.withColumn("answer", parsing.teacher_fields(parsing.teacher_answer(F.col("content"))))
    return rows.withColumn("reason", parsing.teacher_reason(F.col("answer"), F.col("gold"), shown_ids(F.col("prompt")), target_ids(F.col("completion"))))


def repaired(rows: DataFrame) -> DataFrame:
    """``validated`` rows plus repair (``none``, ``citation_append``, ``nei_gold_justified_true``, or null if rejected) and the repaired reasoning.

    Missing citations are appended to the reasoning; an answer that lack of evidence is not justified by the context is taken as justified; either is
    validated again.
    """
    a = F.col("answer")
    appended = parsing.with_citations(a)
    names = ("is_object", "reasoning", "relation", "cited", "gold_justified")
    changed = lambda **new: parsing.let(a, lambda x: F.struct(*[new.get(k, x[k]).alias(k) for k in names]))
    cited, justified = changed(reasoning=appended), changed(gold_justified=F.lit(True))
    again = lambda answer: parsing.teacher_reason(answer, F.col("gold"), shown_ids(F.col("prompt")), target_ids(F.col("completion"))).isNull()
    repair = (
        F.when(F.col("reason").isNull(), "none")
        .when((F.col("reason") == "citation_mismatch") & again(cited), "citation_append")
        .when((F.col("reason") == "gold_not_justified_by_context") & (F.col("gold") == NOT_ENOUGH_INFO) & again(justified), "nei_gold_justified_true")
    )
    return rows.withColumn("repair", repair).withColumn("final_reasoning", F.when(F.col("repair") == "citation_append", appended).when(F.col("repair").isNotNull(), a["reasoning"]))


def first_of(rows: DataFrame, n: int, order: Column, *ties: str) -> DataFrame:
    """``rows`` plus selected: whether a row is among the first n by ``order``, an MD5 in hex.

    Counts by the hash's first digits say where the n-th lies, so that only the rows of that one of 4,096 parts are ranked.
    """
    part = F.substring(order, 1, 3)
    full, left = [], n
    for p, c in sorted(tuple(r) for r in rows.groupBy(part.alias("p")).count().collect()):
        full.append((p, min(left, c), c))
        left -= min(left, c)
    at = next((p for p, took, c in full if took < c), None)
    if at is None:
        return rows.withColumn("selected", F.lit(True))
    took = next(t for p, t, _ in full if p == at)
    some = rows.where(part == at).withColumn("selected", F.row_number().over(Window.partitionBy(part).orderBy(order, *ties)) <= took)
    return rows.where(part != at).withColumn("selected", part < at).unionByName(some)


def filled(rows: DataFrame, n: int, seed: int | str = 0, id_col: str = "id") -> DataFrame:
    """``repaired`` rows plus selected: all accepted and citation-repaired ones, and of the others as many, in a seeded order, as make n.

    The rows are written once, so that what comes before isn't computed for each use.
    """
    rows = staged(rows, "repaired")
    sure, late = F.col("repair").isin("none", "citation_append"), F.col("repair") == "nei_gold_justified_true"
    room = max(0, n - rows.where(sure).count())
    chosen = first_of(rows.where(late), room, seeded(seed, F.col(id_col)), id_col)
    return chosen.unionByName(rows.where(~F.coalesce(late, F.lit(False))).withColumn("selected", F.coalesce(sure, F.lit(False))))


def histogram(rows: DataFrame, *by: str) -> DataFrame:
    """Rows by the given columns; null is a group of its own."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def cot_problems(rows: DataFrame, frozen: DataFrame | None = None, expected: int | None = None) -> DataFrame:
    """(problem, n) of a reasoning training set: repeated or frozen ids, a wrong count, completions without reasoning, with another verdict, without an evidence list or with a confidence."""
    v = F.try_parse_json(F.col("completion"))
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    text = F.when(kind("reasoning") == "STRING", F.try_variant_get(v, "$.reasoning", "string"))
    found = F.array_compact(F.array(
        F.when(~F.coalesce(F.trim(text) != "", F.lit(False)), "no_reasoning"), F.when(~F.try_variant_get(v, "$.verdict", "string").eqNullSafe(F.col("gold")), "other_verdict"),
        F.when(~F.coalesce(F.startswith(kind("evidence"), F.lit("ARRAY")), F.lit(False)), "no_evidence_list"), F.when(kind("confidence").isNotNull(), "confidence_key"),
    ))
    out = rows.select(F.explode(found).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))
    out = out.unionByName(duplicated(rows, "id").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("repeated_id").alias("problem"), "n"))
    if frozen is not None:
        out = out.unionByName(leaked(rows, frozen).agg(F.count("*").alias("n")).where("n > 0").select(F.lit("frozen_id").alias("problem"), "n"))
    if expected is not None:
        out = out.unionByName(rows.agg(F.count("*").alias("n")).where(F.col("n") != expected).select(F.lit("wrong_count").alias("problem"), "n"))
    return out


def ordered_lookup(ids: DataFrame, rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows with their place in a list: ``ids`` has (pos, id_col), pos anything that sorts. An id that ``rows`` doesn't have is an error when the row is read."""
    found = ids.join(rows.withColumn("__there", F.lit(True)), id_col, "left")
    missing = F.raise_error(F.concat(F.lit("no row for id "), F.col(id_col).cast("string")))
    return found.withColumn("pos", F.when(F.col("__there"), F.col("pos")).otherwise(missing.cast(ids.schema["pos"].dataType))).drop("__there")


def prompts(rows: DataFrame, n: int, system: str, seed: int | str = 0) -> DataFrame:
    """(id, prompt, gold, gold_eids) of the first n rows in a seeded order: chat messages, the reward's label and the target's ids."""
    from ..functions.labels import short
    from ..sources.io import chat

    return seeded_prefix(rows, n, "id", seed).select("id", chat(system, F.col("prompt")).alias("prompt"), short(F.col("gold")).alias("gold"), target_ids(F.col("completion")).alias("gold_eids"))
