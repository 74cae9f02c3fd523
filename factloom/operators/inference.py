"""Where a model comes in: searching and verifying as functions of DataFrames, with a deterministic stand-in for tests."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import parse
from ..sources.staging import ship

RESULT = "id long, text string, provider string, in_tokens int, out_tokens int"


class Model(Protocol):
    """Loaded once in each worker process."""

    def run(self, prompts: list[str]) -> list[str]: ...


def generate(rows: DataFrame, make: Callable[[], Model], provider: str = "local") -> DataFrame:
    """(id, text, provider, in_tokens, out_tokens) for rows (id, prompt). ``make`` is called once for each task, batches are Arrow's.

    Token counts are white-space words.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            texts = model.run(b["prompt"].tolist())
            yield pd.DataFrame({"id": b["id"], "text": texts, "provider": provider, "in_tokens": b["prompt"].str.split().str.len(), "out_tokens": [len(t.split()) for t in texts]})

    ship(rows.sparkSession)
    return rows.select("id", "prompt").mapInPandas(run, RESULT)


class Stub:
    """Says SUPPORTED with the first sentence as evidence if it shares a word of five letters with the claim, else that evidence is missing."""

    def run(self, prompts: list[str]) -> list[str]:
        return [self.answer(p) for p in prompts]

    def answer(self, prompt: str) -> str:
        claim, _, rest = prompt.partition("\n")
        first = next((line for line in rest.split("\n") if line.startswith("E1 ")), "")
        words = {w.lower() for w in claim.split()[1:] if len(w) >= 5}
        if words & {w.lower() for w in first.split()}:
            return '{"verdict": "SUPPORTED", "evidence": ["E1"], "confidence": 0.9}'
        return '{"verdict": "NOT_ENOUGH_INFO", "evidence": [], "confidence": 0.5}'


def probe(rows: DataFrame, make: Callable[[], Model], n: int | None = None, order: str = "id") -> DataFrame:
    """(orig_label, pred, n): verdicts of a model on all prompts, or the first n by id, by the label that the claim had. No valid verdict is a value of its own."""
    first = rows if n is None else rows.orderBy(order).limit(n)
    said = generate(first, make).select("id", parse(F.col("text"))["verdict"].alias("pred"))
    return first.select("id", "orig_label").join(said, "id").groupBy("orig_label", "pred").agg(F.count("*").alias("n"))
