"""A corpus from documents to token ids: quality rules, near-duplicates, secrets, source mixture, byte-level BPE.

Each stage gets the rows that the one before kept, as a table that was written and read again; all but the last
return the columns of ``documents``. No SQL gives these rows: they are tested against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, mixing, quality, queries, secretscan, simhash
from factloom.llm.common import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None
#: What stands in the text for a secret.
REDACTED = "[SECRET]"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the forest reject go; labels come from the ``labels`` table."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return simhash.keep_first(docs).select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, and n_chars follows."""
    found = secretscan.find_secrets(docs, redact_with=REDACTED)
    return found.withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document a Poisson number of times, so that sources have their target shares of characters."""
    return mixing.poisson_mix(docs, queries.SOURCE_WEIGHTS, size=F.col("n_chars"), seed=7).select(*COLUMNS)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", simhash_near_dedup), ("secret scans", secret_scans), ("mixing sources to target weights", mix_sources), ("BPE encoding and decoding", bpe_encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = ws.stage(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if before is not None:
            ws.drop(before)
        before = docs
    return docs
