"""The shaped reward as columns. Labels are SUPPORTED, REFUTED and NEI here; ``labels.short`` makes them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .evidence import evidence_f1
from .labels import NEI, REFUTED, SUPPORTED

# What a wrong verdict costs by (gold, predicted), and 1 where nothing is listed; the weights of the parts; the rule for claims without evidence.
HARM = {(REFUTED, SUPPORTED): 1.5, (SUPPORTED, REFUTED): 1.0, (NEI, SUPPORTED): 1.75, (NEI, REFUTED): 1.0}
EVIDENCE_WEIGHT, CALIBRATION_WEIGHT, COST_WEIGHT = 0.5, 0.5, 0.02
NEI_EMPTY, NEI_CITED = 1.0, -0.5
FORMAT_FAIL = -2.0


@dataclass(frozen=True)
class Config:
    """mode: full, format_only (1 if the output parsed) or random (a hash of the seed and id in [0, 1])."""

    mode: str = "full"
    calibration: bool = True
    harm: bool = True
    evidence: bool = True


ABLATIONS = {"full": Config(), "no_calibration": Config(calibration=False), "no_harm": Config(harm=False), "format_only": Config(mode="format_only"), "random": Config(mode="random")}


def correctness(gold: Column, pred: Column, harm: bool = True) -> Column:
    cost = F.lit(1.0)
    if harm:
        for (g, p), h in HARM.items():
            cost = F.when((gold == g) & (pred == p), F.lit(h)).otherwise(cost)
    return F.when(gold.eqNullSafe(pred), F.lit(1.0)).otherwise(1.0 - cost)


def evidence_score(gold: Column, pred: Column, gold_ids: Column, cited: Column) -> Column:
    any_cited = F.coalesce(F.size(cited) > 0, F.lit(False))
    wrong = F.when((gold == NEI) & any_cited, F.lit(NEI_CITED)).otherwise(F.lit(0.0))
    right = F.when(gold == NEI, F.when(any_cited, F.lit(NEI_CITED)).otherwise(F.lit(NEI_EMPTY))).otherwise(evidence_f1(gold_ids, cited))
    return F.when(gold.eqNullSafe(pred), right).otherwise(wrong)


def calibration(gold: Column, pred: Column, confidence: Column) -> Column:
    return -F.pow(confidence - gold.eqNullSafe(pred).cast("double"), F.lit(2.0))


def total(gold: Column, pred: Column, confidence: Column, gold_ids: Column, cited: Column, n_ops: Column, config: Config = Config(), format_ok: Column | None = None, draw: Column | None = None) -> Column:
    """A struct of the reward and its parts. The mode ``random`` needs ``draw``, a column of ids or hashes to draw from."""
    if config.mode == "random":
        if draw is None:
            raise ValueError("mode random needs a column to draw from")
        return F.struct((F.conv(F.substring(F.md5(draw.cast("string")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))).alias("reward"))
    if config.mode == "format_only":
        return F.struct(F.coalesce(format_ok if format_ok is not None else F.lit(True), F.lit(False)).cast("double").alias("reward"))
    if config.mode != "full":
        raise ValueError(f"unknown reward mode {config.mode!r}")
    parts = {
        "correctness": correctness(gold, pred, config.harm),
        "evidence": evidence_score(gold, pred, gold_ids, cited) if config.evidence else F.lit(0.0),
        "calibration": calibration(gold, pred, confidence) if config.calibration else F.lit(0.0),
        "cost": n_ops.cast("double"),
        "evidence_f1": evidence_f1(gold_ids, cited),
    }
    reward = parts["correctness"] + EVIDENCE_WEIGHT * parts["evidence"] + CALIBRATION_WEIGHT * parts["calibration"] - COST_WEIGHT * parts["cost"]
    return F.struct(reward.alias("reward"), *[c.alias(k) for k, c in parts.items()])


def of_output(parsed: Column, gold: Column, gold_ids: Column, shown: Column | None = None, n_ops: Column | None = None, config: Config = Config(), require_confidence: bool = True, label_mapping: bool = True, tool_call: Column | None = None) -> Column:
    """The reward of a model's output (a struct of ``parsing.parse``): a bad format gets ``FORMAT_FAIL``, 0 if only the format counts.

    Single-turn answers cite local ids; with ``shown`` (a map from them) global ones count. ``label_mapping=False`` leaves both labels
    in the long vocabulary, in which the rules for missing evidence never apply. A last message that is a ``tool_call`` is no answer.
    """
    from . import evidence, labels

    ok = parsed["json_ok"] & parsed["verdict_ok"] & parsed["evidence_ok"]
    ok = ok & parsed["confidence_ok"] if require_confidence else ok
    ok = ok & ~F.coalesce(tool_call, F.lit(False)) if tool_call is not None else ok
    cited = F.slice(parsed["evidence"], 1, evidence.MAX_CITED) if shown is None else evidence.resolve(parsed["evidence"], shown, slice_first=True)
    side = labels.short if label_mapping else (lambda c: c)
    if not require_confidence:
        config = Config(config.mode, False, config.harm, config.evidence)
    confidence = F.coalesce(parsed["confidence"], F.lit(0.0))
    good = total(side(gold), side(parsed["verdict"]), confidence, gold_ids, F.coalesce(cited, F.array().cast("array<string>")), n_ops if n_ops is not None else F.lit(0), config, ok)["reward"]
    fail = 0.0 if config.mode == "format_only" else FORMAT_FAIL
    return F.when(ok, good).otherwise(F.lit(fail))
