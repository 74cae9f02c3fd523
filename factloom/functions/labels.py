"""Verdict labels and how their vocabularies map onto each other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels of claims, of predictions and of rewards.
SUPPORTED, REFUTED, NOT_ENOUGH_INFO, NEI = "SUPPORTED", "REFUTED", "NOT_ENOUGH_INFO", "NEI"
LABELS = [SUPPORTED, REFUTED, NOT_ENOUGH_INFO]
RAW_LABELS = {"SUPPORTS": SUPPORTED, "REFUTES": REFUTED, "NOT ENOUGH INFO": NOT_ENOUGH_INFO}


def mapped(label: Column, table: dict[str, str]) -> Column:
    """The label's value in ``table``; null if it isn't listed."""
    return F.coalesce(*[F.when(label == k, F.lit(v)) for k, v in table.items()])


def canonical(label: Column) -> Column:
    """A raw claim label as SUPPORTED, REFUTED or NOT_ENOUGH_INFO; these stay as they are."""
    return mapped(label, RAW_LABELS | {x: x for x in LABELS})


def short(label: Column) -> Column:
    """The vocabulary of rewards, in which lack of evidence is NEI."""
    return mapped(label, {SUPPORTED: SUPPORTED, REFUTED: REFUTED, NOT_ENOUGH_INFO: NEI, NEI: NEI})
