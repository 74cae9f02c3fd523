"""Text functions as columns: unescaping, titles, analysis into terms, packed sentences, token sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bracket escapes of the treebank notation, in the order in which they are replaced.
BRACKETS = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}", "-COLON-": ":"}
# Words that the toy retrieval leaves out.
TOY_STOPWORDS = ["the", "is", "in", "a", "of", "was", "and", "are", "to", "it", "from", "with", "than"]
# English words that an index may leave out.
ENGLISH_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there",
    "these", "they", "this", "to", "was", "will", "with",
]
#: Terms are runs of two or more word characters.
TERM = r"([\p{L}\p{N}_]{2,})"


def unescape(text: Column) -> Column:
    for escape, sign in BRACKETS.items():
        text = F.replace(text, F.lit(escape), F.lit(sign))
    return text


def page_title(page: Column) -> Column:
    """A page id as it is read: underscores are spaces, brackets unescaped."""
    return unescape(F.replace(page, F.lit("_"), F.lit(" ")))


def normal_title(page: Column) -> Column:
    return F.lower(page_title(page))


def base_title(title: Column) -> Column:
    """The title without a final disambiguator in brackets; null if it has none."""
    found = F.regexp_extract(title, r"(?s)^(.*) \([^()]*\)$", 1)
    return F.when(title.rlike(r"(?s)^(.*) \([^()]*\)$"), found)


def index_text(page: Column, text: Column) -> Column:
    return F.concat(page_title(page), F.lit(" . "), unescape(text))


def terms(text: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-case terms in order, repeats included; null text has none."""
    found = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(1)), F.array().cast("array<string>"))
    return F.filter(found, lambda t: ~t.isin(stopwords)) if stopwords else found


def stemmed(term: Column, stem: Callable[[str], str]) -> Column:
    """Terms through a Python stemmer, each distinct one of a batch once. Use it on tables of distinct terms."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = {t: stem(t) for t in s.dropna().unique()}
            yield pd.Series([known.get(t) for t in s], dtype=object)

    return run(term)


def stemmed_all(found: Column, stem: Callable[[str], str]) -> Column:
    """Arrays of terms through a Python stemmer, each distinct term of a batch once; terms without a stem are left out."""

    @F.arrow_udf("array<string>")
    def run(rows: pa.Array) -> pa.Array:
        coded = rows.flatten().dictionary_encode()
        known = pa.array([stem(t) or None for t in coded.dictionary.to_pylist()], pa.string())
        sizes = np.diff(rows.offsets.to_numpy())
        stems = known.take(coded.indices)
        kept = stems.is_valid().to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(kept))[np.append(0, np.cumsum(sizes))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), stems.drop_null())

    return run(found)


def sentences(lines: Column) -> Column:
    """(line, text) of each sentence of a packed page: rows with a number and a sentence that isn't blank, in stored order."""
    fields = F.transform(F.split(lines, "\n"), lambda r: F.split(r, "\t"))
    good = F.filter(fields, lambda f: (F.size(f) >= 2) & f[0].rlike(r"^\d+\z") & (F.trim(F.regexp_replace(f[1], r"\s+", " ")) != ""))
    return F.transform(good, lambda f: F.struct(f[0].cast("int").alias("line"), unescape(f[1]).alias("text")))


def starts_like_a_name(word: Column) -> Column:
    return word.rlike(r"^[\p{Lu}\p{Nd}]")


def span_forms(span: Column) -> Column:
    """The forms in which a span is looked up: as written, without final punctuation, and without a possessive as well."""
    bare = F.regexp_replace(span, r'[,.;:!?"]+$', "")
    return F.array_distinct(F.transform(F.array(span, bare, F.regexp_replace(bare, r"'s$", "")), normal_title))


def token_set(text: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-case white-space words without outer full stops and commas, without stopwords, each once."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[.,]+|[.,]+$", "")))
    return F.array_except(F.array_distinct(bare), F.array(*map(F.lit, TOY_STOPWORDS if stopwords is None else stopwords)).cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def is_compound(claim: Column) -> Column:
    return F.contains(claim, F.lit(" and "))


def decompose(claim: Column) -> Column:
    """The parts that ``and`` joins, blank ones left out; the claim itself if that leaves one part or none."""
    parts = F.filter(F.transform(F.split(claim, " and "), F.trim), lambda p: p != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array(claim))


def seeded(seed: int | str, *ids: Column) -> Column:
    """An order that depends on the seed and the ids alone, the same in any partitioning and engine."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[i.cast("string") for i in ids]))
