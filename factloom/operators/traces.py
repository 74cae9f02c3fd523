"""Traces of an agent's steps: nested rows, their costs, and reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import LABELS, NOT_ENOUGH_INFO

STEPS = "array<struct<t:int,action:string,args:string,result:string,seconds:double>>"


def final_action(verdict: Column) -> Column:
    """abstain if the verdict is that evidence is missing, else commit; an invalid verdict commits too."""
    return F.when(verdict.eqNullSafe(F.lit(NOT_ENOUGH_INFO)), "abstain").otherwise("commit")


def step_counts(steps: Column) -> Column:
    """n_search, n_decompose, n_verify, n_ops and seconds (three digits, half to even) of an array of steps."""
    n = lambda a: F.size(F.filter(steps, lambda s: s["action"] == a))
    ops = n("search") + n("decompose")
    return F.struct(n("search").alias("n_search"), n("decompose").alias("n_decompose"), n("verify").alias("n_verify"), ops.alias("n_ops"), F.bround(F.aggregate(steps, F.lit(0.0), lambda x, s: x + s["seconds"]), 3).alias("seconds"))


def traces(scored: DataFrame, run: str) -> DataFrame:
    """One nested row a claim: search, verify, then commit or abstain. ``scored`` has id, claim, gold, pages, pred, confidence, cited, reward."""
    step = lambda t, action, args, result: F.struct(F.lit(t).alias("t"), F.lit(action).alias("action") if isinstance(action, str) else action.alias("action"), args.alias("args"), result.alias("result"), F.lit(0.0).alias("seconds"))
    steps = F.array(
        step(0, "search", F.to_json(F.struct(F.col("claim").alias("query"))), F.to_json(F.struct("pages"))),
        step(1, "verify", F.to_json(F.struct(F.col("claim"))), F.to_json(F.struct("pred", "confidence", "cited"))),
        step(2, final_action(F.col("pred")), F.to_json(F.struct(F.col("pred").alias("verdict"))), F.lit(None).cast("string")),
    )
    final = F.struct(F.col("pred").alias("verdict"), "confidence", F.col("cited").alias("evidence"), final_action(F.col("pred")).alias("action"))
    return scored.select(F.struct(F.lit(run).alias("name"), F.lit(1).alias("version")).alias("run"), "id", "claim", "gold", steps.cast(STEPS).alias("steps"), final.alias("final"), step_counts(steps).alias("cost"), "reward")


def report(rows: DataFrame, sets: str = "sets") -> DataFrame:
    """Accuracy, strict score, rate of valid verdicts, recalls and mean cost over traces; ``sets``: arrays of arrays of global ids."""
    right = F.col("final.verdict").eqNullSafe(F.col("gold"))
    covered = (F.size(sets) == 0) | F.exists(sets, lambda s: F.size(F.array_except(s, F.col("final.evidence"))) == 0)
    recall = [F.avg(F.when(F.col("gold") == x, right.cast("double"))).alias(f"recall_{x.lower()}") for x in LABELS]
    return rows.agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy"), F.avg((right & covered).cast("double")).alias("strict"), F.avg(F.col("final.verdict").isNotNull().cast("double")).alias("valid"), *recall, F.avg("cost.n_ops").alias("mean_ops"), F.avg("cost.seconds").alias("mean_seconds"))


def conversation_steps(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, roles, n_user, n_assistant): a conversation's turns in order as one row."""
    order = F.array_sort(F.collect_list(F.struct("turn", "role")))
    rows = turns.groupBy("conv_id").agg(order.alias("s"))
    n = lambda r: F.size(F.filter("s", lambda x: x["role"] == r))
    return rows.select("conv_id", F.size("s").alias("n_turns"), F.array_join(F.transform("s", lambda x: x["role"]), ">").alias("roles"), n("user").alias("n_user"), n("assistant").alias("n_assistant"))


def numbered_rollout(results: Column) -> Column:
    """A multi-turn rollout's shown map: global ids of its searches in order, each once, numbered on across searches (E1, E2, ...)."""
    seen = F.array_distinct(F.flatten(results))
    return F.map_from_entries(F.transform(seen, lambda g, i: F.struct(F.concat(F.lit("E"), (i + 1).cast("string")), g)))
