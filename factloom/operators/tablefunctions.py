"""SQL table functions: the best rows of each query from a table argument, and the spans of a claim for ``LATERAL``."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..functions.text import BRACKETS
from ..sources.staging import ship
from .search import MAX_TITLE_WORDS


class BestRows:
    """``best_rows(TABLE(pairs), k)``: the k rows of each qid with the highest score, ties to the smaller sid, with their rank.

    The table has qid, sid and score, and any further columns. The function asks for the partitioning and the order itself, so Spark shuffles by
    qid and sorts, and a row is looked at and let go.
    """

    def __init__(self) -> None:
        self.rank = 0

    @staticmethod
    def analyze(pairs: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        if not pairs.isTable or not {"qid", "sid", "score"} <= set(pairs.dataType.names):
            raise ValueError("the first argument is TABLE(...) with qid, sid and score")
        if k.isTable or not isinstance(k.value, int) or k.value < 1:
            raise ValueError("the second argument is a positive constant")
        schema = StructType([*pairs.dataType.fields]).add("rank", IntegerType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("qid")], orderBy=[OrderingColumn("score", ascending=False), OrderingColumn("sid", ascending=True)])

    def eval(self, pairs: Row, k: int) -> Iterator[tuple]:
        self.rank += 1
        if self.rank <= k:
            yield (*pairs, self.rank)


class ClaimSpans:
    """``claim_spans(text, any_case)``: (i, j, form) of the word spans [i, j) that start like a name, in each form they are looked up in."""

    def eval(self, text: str, any_case: bool) -> Iterator[tuple[int, int, str]]:
        words = (text or "").split()
        for i, word in enumerate(words):
            if not any_case and not (word[0].isupper() or word[0].isdecimal()):
                continue
            for j in range(i + 1, min(len(words), i + MAX_TITLE_WORDS) + 1):
                span = " ".join(words[i:j])
                bare = re.sub(r'[,.;:!?"]+\Z', "", span)
                for form in dict.fromkeys(map(self.normal, (span, bare, bare.removesuffix("'s")))):
                    yield i, j, form

    @staticmethod
    def normal(title: str) -> str:
        title = title.replace("_", " ")
        for escape, sign in BRACKETS.items():
            title = title.replace(escape, sign)
        return title.lower()


def register(spark: SparkSession) -> None:
    """Makes both functions known to SQL."""
    ship(spark)
    spark.udtf.register("best_rows", udtf(BestRows))
    spark.udtf.register("claim_spans", udtf(ClaimSpans, returnType="i int, j int, form string"))
