"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Each source gets a mean repetition rate, target share x total size / own size. A document's number of
copies is a Poisson draw with that mean, made by inverting the distribution at a uniform number hashed from
the seed and the document's id, so a rerun, a lost executor or another partitioning gives the same copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: A larger mean is split into equal parts, each drawn with its own hash: sums of Poisson draws are Poisson.
PART = 16.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5; null parts count as the empty string."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float], key: str, size: Column | None = None) -> DataFrame:
    """(key, rate): one row for each listed source that has rows, so at most ``len(weights)`` rows.

    The total that is dealt out is the size of the listed sources that have rows, and the weights of those
    are scaled to a sum of one. ``size`` (default: one a row) is what the weights count.
    """
    if not weights or any(not w >= 0 or w == float("inf") for w in weights.values()) or not sum(weights.values()) > 0:
        raise ValueError("weights must be finite, not negative, and positive in sum")
    size = F.lit(1) if size is None else F.coalesce(size, F.lit(0))
    own = docs.where(F.col(key).isin(list(weights))).groupBy(F.col(key).alias("__key")).agg(F.sum(size).cast("double").alias("__n"))
    weight = F.coalesce(*[F.when(F.col("__key") == k, F.lit(float(w))) for k, w in weights.items()])
    own = own.where("__n > 0").withColumn("__w", weight)
    whole = own.agg(F.sum("__w").alias("__ws"), F.sum("__n").alias("__ns"))
    return own.join(F.broadcast(whole)).select("__key", (F.col("__w") / F.col("__ws") * F.col("__ns") / F.col("__n")).alias("__rate"))


def _distribution(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... far enough that what is left is under 2**-53."""
    top = F.ceil(rate + 12.0 * F.sqrt(rate) + 24).cast("int")
    first = F.exp(-rate)
    grown = F.aggregate(
        F.sequence(F.lit(1), top),
        F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("cdf")),
        lambda s, k: F.struct((s["p"] * rate / k).alias("p"), (s["c"] + s["p"] * rate / k).alias("c"), F.concat(s["cdf"], F.array(s["c"] + s["p"] * rate / k)).alias("cdf")),
    )
    return grown["cdf"]


def poisson_mix(docs: DataFrame, weights: dict[str, float], key: str = "source", id_col: str = "doc_id", size: Column | None = None, other_rate: float = 1.0, seed: int = 0, copy_col: str = "copy") -> DataFrame:
    """``docs`` with every row repeated a Poisson number of times, in a global random order.

    Rows out have the columns of ``docs`` plus ``copy_col`` (0, 1, ...; replaces a column of that name).
    Sources that ``weights`` doesn't list, null among them, have the mean rate ``other_rate``. Only the table of
    rates, no longer than ``weights``, is broadcast; rows are never grouped by source, so a hot source is
    spread like any other, and the one shuffle deals rows out by a hash of id and copy. Rows with the same id
    get the same number of copies; a null id counts as one id. An empty table gives an empty one; other columns stay, whatever they are called.
    """
    key_, m_, cdf_, n_, order_ = (unused(docs, c) for c in ("__key", "__m", "__cdf", "__n", "__order"))
    table = rates(docs, weights, key, size).withColumn("__m", F.greatest(F.lit(1), F.ceil(F.col("__rate") / PART)).cast("int"))
    table = table.select(F.col("__key").alias(key_), F.col("__m").alias(m_), _distribution(F.col("__rate") / F.col("__m")).alias(cdf_))
    parts = max(1, -int(-other_rate // PART))
    plain = _distribution(F.lit(float(other_rate) / parts))
    rows = docs.drop(copy_col).join(F.broadcast(table), F.col(key) == F.col(key_), "left")
    cdf, m = F.coalesce(cdf_, plain), F.coalesce(m_, F.lit(parts))
    draw = lambda j: F.size(F.filter(cdf, lambda c: c <= uniform(F.lit(seed), F.col(id_col), j)))
    n = F.aggregate(F.sequence(F.lit(0), m - 1), F.lit(0), lambda a, j: a + draw(j))
    rows = rows.withColumn(n_, n).where(F.col(n_) > 0).drop(key_, m_, cdf_)
    rows = rows.withColumn(copy_col, F.explode(F.sequence(F.lit(0), F.col(n_) - 1)))
    order = F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(copy_col).cast("string")))
    return rows.drop(n_).withColumn(order_, order).repartition(order_).sortWithinPartitions(order_).drop(order_)
