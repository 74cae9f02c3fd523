"""Resolution of WARC "not modified" revisits: an as-of join by canonical URL to the latest earlier full response.

A capture is a row with a record id, URL, time, status and lower-case header names. A revisit (status 304)
borrows the body of the latest full response (status 200) of the same canonical URL before it, if their
validators agree, and its permitted headers replace the stored ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import unused

# Header fields a 304 must not replace (RFC 9110 and 9111: framing, coding and hop-by-hop fields).
KEPT_HEADERS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]

#: Query parameters that only track where a visitor came from.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"


def canonical_url(url: Column) -> Column:
    """Scheme and ``www.``, ``m.`` host prefixes, default port, fragment, tracking parameters and a final slash don't tell URLs apart; parameters are sorted. Null stays null."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^(?i:https?://)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)$", ""), r"^(?:www\d*|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^(?i:https?://)?[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(?:=|$)")))
    return F.when(url.isNotNull(), F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit(""))))


def merge_headers(stored: Column, fresh: Column) -> Column:
    """The stored fields with the permitted ones of the revisit in their place."""
    allowed = F.map_filter(fresh, lambda k, v: ~k.isin(KEPT_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def _outcome(had: Column, has: Column) -> Column:
    """Validators in the order of their strength: entity tag (weak comparison), date, payload digest."""
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    cases = F.when(tag(had).isNotNull() & tag(has).isNotNull(), F.when(tag(had) == tag(has), "etag").otherwise("etag_differs"))
    for field in ("last-modified", "warc-payload-digest"):
        cases = cases.when(had[field].isNotNull() & has[field].isNotNull(), F.when(had[field] == has[field], field).otherwise(f"{field}_differs"))
    return cases.otherwise("no_validator")


def resolve_revisits(captures: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """``captures`` (record_id, url, ts in seconds, status, headers map) plus canonical_url, outcome, source_id and merged headers.

    Outcome: ``full`` for a response of its own, the validator that agreed, ``..._differs``, ``no_validator``,
    ``no_response`` (none before it), or ``other`` for any other status. source_id is the record the body comes
    from, null where there is none; headers are merged where a validator agreed. Ties in time go by record_id:
    the larger is the later; a record is never its own source. Null URLs or times resolve to ``no_response``.

    A URL's history is cut into buckets of time. The latest response of a bucket is a partial aggregation, and
    only those are carried across buckets, so a URL with very many captures is spread over its buckets.
    Bodies don't move: join them by source_id. Columns of the output's names are replaced, others stay whatever they are called.
    """
    rows = captures.drop("canonical_url", "outcome", "source_id").withColumn("canonical_url", canonical_url(F.col("url")))
    bucket_, headers_, full_, last_, carry_, near_, from_ = (unused(captures, f"__{c}") for c in ("bucket", "headers", "full", "last", "carry", "near", "from"))
    rows = rows.withColumn(bucket_, F.floor(F.col("ts") / bucket_seconds)).withColumn(headers_, F.coalesce("headers", F.expr("cast(map() as map<string,string>)")))
    found = F.when((F.col("status") == 200) & F.col("canonical_url").isNotNull() & F.col("ts").isNotNull(), F.struct("ts", "record_id", F.map_filter(headers_, lambda k, v: F.lit(True)).alias("headers")))
    rows = rows.withColumn(full_, found)
    last = rows.where(F.col(full_).isNotNull()).groupBy("canonical_url", bucket_).agg(F.max_by(full_, F.struct("ts", "record_id")).alias(last_))
    # The row of a bucket says what the next bucket that has captures starts from.
    known = rows.where("canonical_url is not null and ts is not null").select("canonical_url", bucket_).distinct().join(last, ["canonical_url", bucket_], "left")
    over = Window.partitionBy("canonical_url").orderBy(bucket_).rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn(carry_, F.last(last_, ignorenulls=True).over(over)).select("canonical_url", bucket_, carry_)
    inside = Window.partitionBy("canonical_url", bucket_).orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    timed = rows.where("canonical_url is not null and ts is not null").withColumn(near_, F.last(full_, ignorenulls=True).over(inside)).join(known, ["canonical_url", bucket_], "left")
    timed = timed.withColumn(from_, F.coalesce(near_, carry_))
    lost = rows.where("canonical_url is null or ts is null").withColumn(from_, F.lit(None).cast(timed.schema[from_].dataType))
    rows = timed.drop(near_, carry_).unionByName(lost)
    agreed = _outcome(F.col(from_)["headers"], F.col(headers_))
    outcome = F.when(F.col("status") == 200, "full").when(F.col("status") != 304, "other").when(F.col("status").isNull(), "other").when(F.col(from_).isNull(), "no_response").otherwise(agreed)
    rows = rows.withColumn("outcome", outcome)
    good = F.col("outcome").isin("etag", "last-modified", "warc-payload-digest")
    rows = rows.withColumn("source_id", F.when(F.col("outcome") == "full", F.col("record_id")).when(good, F.col(from_)["record_id"]))
    rows = rows.withColumn("headers", F.when(good, merge_headers(F.col(from_)["headers"], F.col(headers_))).otherwise(F.col("headers")))
    return rows.drop(bucket_, headers_, full_, from_)
