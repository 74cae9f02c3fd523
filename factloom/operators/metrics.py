"""Evaluation of predictions: rates, recalls, calibration, risk at coverage, strata, confusion, costs, disagreement.

A prediction row has id, gold, pred (null if invalid), correct, fever_score, evidence_f1 (null without gold evidence),
confidences (null if not stated), gold_in_context (null without gold evidence) and token counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import LABELS, NOT_ENOUGH_INFO

TARGETS = (0.5, 0.8, 1.0)


def rate(flag: Column) -> Column:
    """The mean of a boolean over rows in which it isn't null; null without such rows."""
    return F.avg(flag.cast("double"))


def stratum(gold: Column = None, in_context: Column = None) -> Column:
    """gold_nei, gold_in_context or gold_not_in_context; null where it isn't known whether the evidence was shown."""
    gold, in_context = (F.col("gold") if gold is None else gold), (F.col("gold_in_context") if in_context is None else in_context)
    return F.when(gold == NOT_ENOUGH_INFO, "gold_nei").when(in_context, "gold_in_context").when(~in_context, "gold_not_in_context")


def with_strata(rows: DataFrame) -> DataFrame:
    """Every row once as ``all`` and once in its stratum, for one aggregation over both."""
    return rows.withColumn("stratum", F.explode(F.array_compact(F.array(F.lit("all"), stratum()))))


def rates(rows: DataFrame, *by: str) -> DataFrame:
    """n, accuracy, fever_score, evidence_f1 and the recall of each label, by the given columns."""
    recall = [F.avg(F.when(F.col("gold") == x, F.col("pred").eqNullSafe(F.lit(x)).cast("double"))).alias(f"recall_{x.lower()}") for x in LABELS]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), rate(F.col("correct")).alias("accuracy"), rate(F.col("fever_score")).alias("fever_score"), F.avg("evidence_f1").alias("evidence_f1"), *recall)


def brier(rows: DataFrame, confidence: str, *by: str) -> DataFrame:
    """n rows that state a confidence, their share of all, and the mean square of confidence less outcome."""
    c = F.col(confidence)
    return rows.groupBy(*by).agg(F.count(c).alias("n"), (F.count(c) / F.count("*")).alias("coverage"), F.avg(F.pow(c - F.col("correct").cast("double"), F.lit(2.0))).alias("brier"))


def reliability(rows: DataFrame, confidence: str, *by: str, bins: int = 10, intervals: bool = False) -> DataFrame:
    """(bin, n, conf, acc). A confidence x is in bin floor(x * bins), 1 in the last; ``intervals`` compares with the edges b / bins instead,
    which differs for doubles next to an edge."""
    c = F.col(confidence)
    if intervals:
        place = F.least(sum(((c >= F.lit(b / bins)).cast("int") for b in range(1, bins)), F.lit(0)), F.lit(bins - 1))
    else:
        place = F.least(F.floor(c * F.lit(float(bins))).cast("int"), F.lit(bins - 1))
    return rows.where(c.isNotNull()).groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"), F.avg(c).alias("conf"), rate(F.col("correct")).alias("acc"))


def ece(rows: DataFrame, confidence: str, *by: str, bins: int = 10, intervals: bool = False) -> DataFrame:
    """The expected calibration error: gaps of the bins weighted by their rows."""
    table = reliability(rows, confidence, *by, bins=bins, intervals=intervals)
    return table.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


#: Ranges that the distinct confidences of a group are cut into.
RANGES = 256


def _running(steps: DataFrame, keys: list[str], value: str, sums: dict[str, str]) -> DataFrame:
    """``steps`` with running sums from the highest ``value`` down, in two levels: within ranges of about equal length, and over the totals of these.

    ``value`` is unique within a group. A window holds one range, an array of a group as many totals as there are ranges.
    """
    join = lambda a, b, *on: a.join(b, [*keys, *on]) if keys or on else a.crossJoin(F.broadcast(b))
    cuts = steps.groupBy(*keys).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10_000).alias("__cuts"))
    rows = join(steps, cuts).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    totals = rows.groupBy(*keys, "__range").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    listed = totals.groupBy(*keys).agg(F.collect_list(F.struct("__range", *[f"__{c}" for c in sums])).alias("__all"))
    above = lambda c: F.aggregate(F.filter("__all", lambda x: x["__range"] > F.col("one.__range")), F.lit(0).cast("long"), lambda s, x: s + x[f"__{c}"])
    before = listed.select(*keys, "__all", F.explode("__all").alias("one")).select(*keys, F.col("one.__range").alias("__range"), *[above(c).alias(f"__{c}") for c in sums])
    inside = Window.partitionBy(*keys, "__range").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = join(rows, before, "__range")
    return rows.withColumns({name: F.col(f"__{c}") + F.sum(c).over(inside) for c, name in sums.items()}).drop("__range", *[f"__{c}" for c in sums])


def risk_at_coverage(rows: DataFrame, confidence: str, *by: str, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """(target, threshold, coverage, risk): the highest confidence from which at least the target share of stating rows is taken, ties included.

    coverage is the share of all rows. Rows are first summed by distinct confidence, so the running sums are over those.
    """
    keys = list(by)
    c = F.col(confidence)
    whole = rows.groupBy(*keys).agg(F.count("*").alias("all_rows"), F.count(c).alias("stating"))
    steps = rows.where(c.isNotNull()).groupBy(*keys, c.alias("threshold")).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("right"))
    steps = _running(steps, keys, "threshold", {"n": "taken", "right": "good"})
    steps = steps.join(whole, keys) if keys else steps.crossJoin(F.broadcast(whole))
    steps = steps.withColumn("target", F.explode(F.array(*map(F.lit, targets)))).where(F.col("taken") / F.col("stating") >= F.col("target"))
    first = steps.groupBy(*keys, "target").agg(F.max_by(F.struct("threshold", (F.col("taken") / F.col("all_rows")).alias("coverage"), (1 - F.col("good") / F.col("taken")).alias("risk")), "threshold").alias("r"))
    return first.select(*keys, "target", "r.*")


def summarize(rows: DataFrame) -> DataFrame:
    """One row for ``all`` and each stratum: the rates, and for both confidences n, coverage, Brier score and calibration error."""
    rows = with_strata(rows)
    out = rates(rows, "stratum")
    for c in ("stated_conf", "token_conf"):
        one = brier(rows, c, "stratum").join(ece(rows, c, "stratum"), "stratum", "left")
        out = out.join(one.select("stratum", *[F.col(x).alias(f"{c}_{x}") for x in ("n", "coverage", "brier", "ece")]), "stratum")
    return out


def reasoning_rates(rows: DataFrame) -> DataFrame:
    """The share of rows that reason, and of those that cite anything the share whose citations were all shown."""
    return rows.agg(rate(F.col("reasoning_present")).alias("reasoning_present_rate"), rate(F.col("reasoning_citations_valid")).alias("reasoning_valid_citations_rate"))


def confusion(rows: DataFrame, *extra: str) -> DataFrame:
    """(gold, pred, n); no prediction is a value of its own."""
    return rows.groupBy("gold", "pred", *extra).agg(F.count("*").alias("n"))


def costs(rows: DataFrame, dollars_in: float, dollars_out: float, *by: str) -> DataFrame:
    """Mean tokens in and out and dollars, prices being per million tokens."""
    spent = (F.sum("in_tokens") * F.lit(dollars_in) + F.sum("out_tokens") * F.lit(dollars_out)) / F.lit(1e6)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("in_tokens").alias("mean_in"), F.avg("out_tokens").alias("mean_out"), spent.alias("dollars"))


def problems(rows: DataFrame) -> DataFrame:
    """(problem, n): what makes a table of predictions unfit for scoring; no row if nothing does."""
    confidence = lambda c: F.col(c).isNotNull() & (F.isnan(c) | ~F.col(c).between(0.0, 1.0))
    found = F.array_compact(F.array(
        F.when(F.col("id").isNull(), "missing_id"), F.when(~F.coalesce(F.col("gold").isin(LABELS), F.lit(False)), "bad_gold"), F.when(~F.coalesce(F.col("pred").isin(LABELS), F.lit(True)), "bad_pred"),
        F.when(F.col("correct").isNull() | (F.col("correct") != F.col("gold").eqNullSafe(F.col("pred"))), "correct_disagrees"), F.when(confidence("stated_conf"), "bad_stated_conf"), F.when(confidence("token_conf"), "bad_token_conf"),
    ))
    single = rows.select(F.explode(found).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))
    twice = rows.groupBy("id").count().where("count > 1 and id is not null").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("duplicate_id").alias("problem"), "n")
    empty = rows.agg(F.count("*").alias("c")).where("c = 0").select(F.lit("no_rows").alias("problem"), F.lit(1).cast("long").alias("n"))
    return single.unionByName(twice).unionByName(empty)


def checked(rows: DataFrame) -> DataFrame:
    """``rows``, or an error that names what is wrong with them."""
    found = [f"{r['problem']}: {r['n']}" for r in problems(rows).collect()]
    if found:
        raise ValueError("unfit predictions: " + ", ".join(sorted(found)))
    return rows


def spread(samples: DataFrame, key: str) -> DataFrame:
    """Per prompt over its samples (reward, verdict, correct): reward_std (population), n_distinct_verdicts (none counts as one) and acc."""
    distinct = F.count_distinct("verdict") + F.max(F.col("verdict").isNull().cast("int"))
    return samples.groupBy(key).agg(F.count("*").alias("n"), F.stddev_pop("reward").alias("reward_std"), distinct.alias("n_distinct_verdicts"), rate(F.col("correct")).alias("acc"))


def spread_summary(table: DataFrame) -> DataFrame:
    """Over prompts: shares with spread and with disagreement, and how many are always or never right."""
    return table.agg(F.count("*").alias("n"), rate(F.col("reward_std") > 1e-9).alias("with_spread"), rate(F.col("n_distinct_verdicts") > 1).alias("disagreeing"), F.count_if(F.col("acc") == 1).alias("all_right"), F.count_if(F.col("acc") == 0).alias("all_wrong"))


def with_spread(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The rows whose prompt has any spread of rewards."""
    return rows.join(table.where("reward_std > 1e-9").select(key), key, "left_semi")


def compare_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that both runs have, the share with the same verdict (none equals none), and both accuracies."""
    both = left.select("id", F.col("pred").alias("a"), F.col("correct").alias("ca")).join(right.select("id", F.col("pred").alias("b"), F.col("correct").alias("cb")), "id")
    return both.agg(F.count("*").alias("n"), rate(F.col("a").eqNullSafe(F.col("b"))).alias("same_verdict"), rate(F.col("ca")).alias("accuracy_a"), rate(F.col("cb")).alias("accuracy_b"))
