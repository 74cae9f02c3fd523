"""Evidence ids, sets of them, and scores over sets, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import labels

MAX_CITED = 5


def global_id(page: Column, line: Column) -> Column:
    return F.concat(page, F.lit(":"), line.cast("string"))


def split_id(eid: Column) -> Column:
    """(page, line) of a global id; the page may hold colons."""
    return F.struct(F.regexp_extract(eid, r"(?s)^(.*):(\d+)$", 1).alias("page"), F.regexp_extract(eid, r"(?s)^(.*):(\d+)$", 2).cast("int").alias("line"))


def by_number(eids: Column) -> Column:
    """Local ids in numeric order: E10 after E9."""
    number = lambda e: F.substring(e, 2, 9).cast("int")
    return F.transform(F.array_sort(F.transform(eids, lambda e: F.struct(number(e).alias("n"), e.alias("e")))), lambda s: s["e"])


def gold_sets(label: Column, evidence: Column) -> Column:
    """The complete evidence sets of a claim as arrays of (page, line); none if there isn't enough information."""
    decoded = F.transform(evidence, lambda s: F.array_distinct(F.transform(s, lambda e: F.struct(e["page"].alias("page"), e["line"].alias("line")))))
    return F.when(labels.canonical(label) == labels.NOT_ENOUGH_INFO, F.slice(decoded, 1, 0)).otherwise(decoded)


def covers(sets: Column, shown: Column) -> Column:
    """Whether some set lies wholly in ``shown``; null if there is no set."""
    return F.when(F.size(sets) > 0, F.exists(sets, lambda s: F.size(F.array_except(s, shown)) == 0))


def first_covered(sets: Column, shown: Column) -> Column:
    """The first set, in source order, that lies wholly in ``shown``; null if none does."""
    return F.get(F.filter(sets, lambda s: F.size(F.array_except(s, shown)) == 0), F.lit(0))


def smallest(sets: Column) -> Column:
    """The smallest set, the first of equals."""
    return F.array_sort(F.transform(sets, lambda s, i: F.struct(F.size(s).alias("n"), i.alias("i"), s.alias("s"))))[0]["s"]


def union_of(sets: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(sets)))


def resolve(cited: Column, shown: Column, slice_first: bool = False) -> Column:
    """Local ids mapped through ``shown`` (a map), unknown ones dropped, at most ``MAX_CITED``, in order, repeats kept.

    Evaluation drops first and cuts then; rewards cut first (``slice_first``).
    """
    known = lambda x: F.filter(F.transform(x, lambda e: shown[e]), lambda g: g.isNotNull())
    return known(F.slice(cited, 1, MAX_CITED)) if slice_first else F.slice(known(cited), 1, MAX_CITED)


def evidence_f1(gold: Column, cited: Column) -> Column:
    """F1 over the two sets of ids; 0 if either is empty or they share nothing."""
    g, c = F.array_distinct(gold), F.array_distinct(cited)
    hits = F.size(F.array_intersect(g, c)).cast("double")
    return F.when(hits > 0, 2 * hits / (F.size(g) + F.size(c))).otherwise(F.lit(0.0))


def strict(gold_label: Column, pred: Column, sets: Column, cited: Column) -> Column:
    """The right verdict with one complete set among the citations, or the right verdict that there isn't enough information."""
    return (gold_label.eqNullSafe(pred)) & F.coalesce(covers(sets, cited), F.lit(True))
