"""The queries ``opN_...`` over the driver's tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, debruijn, gridjoin, importance, mixing, packing, quality, secretscan, sharding, simhash, tokenfile, warc
from .common import Workspace

#: Target weights of the twenty sources: the largest is brought down to a tenth, the rest share evenly.
SOURCE_WEIGHTS = {"src0": 0.1} | {f"src{i}": 0.9 / 19 for i in range(1, 20)}
SHARD_BYTES = 1 << 20


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(_read(spark, sf_dir, "documents"), SOURCE_WEIGHTS, size=F.col("n_chars"), seed=7)


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards are written, and what is returned, their real bytes and rows included, is read from the files."""
    docs = _read(spark, sf_dir, "documents")
    folder = f"{Workspace(spark, 'shards').base}/files"
    sharded = sharding.shard(docs, SHARD_BYTES).select(*docs.columns, "shard_depth", "shard")
    sharding.write_shards(sharded, folder)
    rows = sharding.read_shards(spark, folder, sharded).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "shard", "shard_depth")
    sums = rows.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return rows.join(sums, "shard").select("doc_id", "n_bytes", "shard", "shard_depth", "shard_bytes", "shard_docs")


def captures(pages: DataFrame) -> DataFrame:
    """Three captures of each page, ten seconds a page: the response, a revisit under another spelling of the URL,
    and a later revisit whose entity tag is stale for every fifth page and missing for every seventh."""
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    date = F.concat(F.lit("day "), F.col("page_id").cast("string"))
    base = F.col("page_id").cast("long") * 10
    length = F.octet_length("html").cast("string")
    header = lambda **kv: F.map_from_arrays(F.array(*[F.lit(k.replace("_", "-")) for k in kv]), F.array(*kv.values()))
    rid = lambda i: F.col("page_id").cast("long") * 3 + i
    row = lambda i, url, ts, status, headers: F.struct(rid(i).alias("record_id"), F.lit(i).alias("seq"), url.alias("url"), ts.alias("ts"), F.lit(status).alias("status"), headers.alias("headers"))
    stale = F.when(F.col("page_id") % 5 == 0, F.lit('"stale"')).when(F.col("page_id") % 7 != 0, F.concat(F.lit("W/"), tag))
    third = F.map_filter(header(etag=stale, last_modified=date, server=F.lit("c")), lambda k, v: v.isNotNull())
    rows = F.array(
        row(0, F.col("url"), base, 200, header(content_length=length, content_type=F.lit("text/html"), etag=tag, last_modified=date, server=F.lit("a"))),
        row(1, F.concat("url", F.lit("#again")), base + 4, 304, header(content_length=F.lit("0"), date=(base + 4).cast("string"), etag=tag, server=F.lit("b"))),
        row(2, F.regexp_replace("url", "^https?://", "HTTPS://"), base + 9, 304, third),
    )
    return pages.select("page_id", F.explode(rows).alias("c")).select("page_id", "c.*")


def op3_resolve_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.resolve_revisits(captures(_read(spark, sf_dir, "pages")))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "; ")
    return rows.select("page_id", "seq", "record_id", "canonical_url", "status", "outcome", "source_id", shown.alias("headers"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = debruijn.remove_repeats(_read(spark, sf_dir, "documents"), k=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridjoin.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{Workspace(spark, 'tokenfile').base}/files"
    tokenfile.write(_read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenfile.read(spark, folder).withColumnRenamed("id", "doc_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.find_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("secret_spans", lambda s: s["kind"] != "crf")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, name), ",")
    return found.select("doc_id", *map(count, secretscan.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents of twenty words and more, drawn towards the language of ``benchmark``."""
    return importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), percent=25, seed=7)


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults by a checksum of conversation and turn; nulls are a space. A message that is dropped leaves a row without a role."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    text = F.when(case == 1, F.lit("")).when(case == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    role = F.when(case == 4, F.lit("user")).when(case != 0, known("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(damaged(_read(spark, sf_dir, "conversations")))


def op13_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, with_ids=False)


QUERIES = {"op1_mix_sources": op1_mix_sources, "op2_shard": op2_shard, "op3_resolve_revisits": op3_resolve_revisits, "op4_simhash": op4_simhash, "op5_quality": op5_quality, "op6_bpe": op6_bpe, "op7_grid_join": op7_grid_join, "op8_substring_dedup": op8_substring_dedup, "op9_token_file": op9_token_file, "op10_secrets": op10_secrets, "op11_resample": op11_resample, "op12_repair": op12_repair, "op13_pack": op13_pack}

_CANON = r"""regexp_replace(regexp_replace(lower(regexp_extract(bare, '^(?:[hH][tT][tT][pP][sS]?://)?([^/?]*)', 1)), ':(80|443)$', ''), '^(www[0-9]*|m)\.', '')
 || regexp_replace(regexp_extract(bare, '^(?:[hH][tT][tT][pP][sS]?://)?[^/?]*([^?]*)', 1), '/+$', '')
 || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END"""

ORACLE_SQL = {
    "op1_mix_sources": f"""
WITH w(source, weight) AS (VALUES {", ".join(f"('{k}', {v!r}::double)" for k, v in SOURCE_WEIGHTS.items())}),
n AS (SELECT source, sum(n_chars)::double AS n, any_value(weight) AS weight FROM documents JOIN w USING (source) GROUP BY source),
r AS (SELECT source, weight / (SELECT sum(weight) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n WHERE n > 0),
c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
      FROM r, (SELECT unnest(range(0, 120))::double AS k)),
u AS (SELECT d.*, ('0x' || substr(md5('7|' || doc_id || '|0'), 1, 13))::bigint::double / 4503599627370496 AS u FROM documents d),
k AS (SELECT u.doc_id, count(*) AS n FROM u JOIN c ON u.source = c.source AND c.cdf <= u.u GROUP BY u.doc_id)
SELECT d.*, unnest(range(0, k.n))::int AS copy FROM documents d JOIN k USING (doc_id)""",
    "op2_shard": f"""
WITH d AS (SELECT doc_id, strlen(text)::bigint AS n_bytes, ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint AS h FROM documents),
s AS (SELECT depth, h >> (60 - depth) AS prefix, sum(n_bytes) AS bytes, count(*) AS n
      FROM d, (SELECT unnest(range(0, 25)) AS depth) GROUP BY ALL),
f AS (SELECT d.doc_id, d.n_bytes, s.depth, s.prefix, s.bytes, s.n, row_number() OVER (PARTITION BY d.doc_id ORDER BY s.depth) AS rn
      FROM d JOIN s ON d.h >> (60 - s.depth) = s.prefix WHERE s.bytes <= {SHARD_BYTES})
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::int, '0') END AS shard,
       depth::int AS shard_depth, bytes::bigint AS shard_bytes, n::bigint AS shard_docs FROM f WHERE rn = 1""",
    "op3_resolve_revisits": rf"""
WITH p AS (SELECT page_id, url, '"' || md5(html) || '"' AS tag, 'day ' || page_id AS lm, strlen(html)::varchar AS len FROM pages),
c AS (SELECT page_id, 0 AS seq, url, page_id * 10 AS ts, 200 AS status, tag AS etag, lm, 'a' AS server, NULL::varchar AS date, len FROM p
 UNION ALL SELECT page_id, 1, url || '#again', page_id * 10 + 4, 304, tag, NULL, 'b', (page_id * 10 + 4)::varchar, '0' FROM p
 UNION ALL SELECT page_id, 2, regexp_replace(url, '^https?://', 'HTTPS://'), page_id * 10 + 9, 304,
   CASE WHEN page_id % 5 = 0 THEN '"stale"' WHEN page_id % 7 <> 0 THEN 'W/' || tag END, lm, 'c', NULL, NULL FROM p),
b AS (SELECT *, page_id * 3 + seq AS record_id, regexp_replace(url, '#.*$', '') AS bare,
   list_sort(list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1), '&'),
     lambda x: x <> '' AND NOT regexp_matches(x, '^{warc.TRACKING}(=|$)'))) AS params FROM c),
k AS (SELECT *, {_CANON} AS canonical_url FROM b),
f AS (SELECT k.*, last_value(CASE WHEN status = 200 THEN record_id END IGNORE NULLS) OVER
   (PARTITION BY canonical_url ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM k),
j AS (SELECT f.*, s.etag AS s_etag, s.lm AS s_lm, s.server AS s_server, s.len AS s_len FROM f LEFT JOIN k s ON s.record_id = f.src),
o AS (SELECT *, CASE WHEN status = 200 THEN 'full' WHEN src IS NULL THEN 'no_response'
   WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = s_etag THEN 'etag' ELSE 'etag_differs' END
   WHEN lm IS NOT NULL THEN CASE WHEN lm = s_lm THEN 'last-modified' ELSE 'last-modified_differs' END ELSE 'no_validator' END AS outcome FROM j)
SELECT page_id, seq, record_id, canonical_url, status, outcome,
 CASE WHEN outcome = 'full' THEN record_id WHEN outcome IN ('etag', 'last-modified') THEN src END AS source_id,
 CASE WHEN outcome IN ('etag', 'last-modified') THEN concat_ws('; ', 'content-length: ' || s_len, 'content-type: text/html', 'date: ' || date, 'etag: ' || coalesce(etag, s_etag), 'last-modified: ' || coalesce(lm, s_lm), 'server: ' || server)
  ELSE concat_ws('; ', 'content-length: ' || len, CASE WHEN status = 200 THEN 'content-type: text/html' END, 'date: ' || date, 'etag: ' || etag, 'last-modified: ' || lm, 'server: ' || server) END AS headers
FROM o""",
    "op7_grid_join": """
WITH RECURSIVE e AS (SELECT vec_id, embedding::double[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9::double),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::bigint AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)""",
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d),
k AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM s),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM f WHERE n > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
y AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) FILTER (g.i IS NULL) AS kept, count(g.i) AS n FROM x LEFT JOIN g USING (doc_id, i) GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(y.n, 0)::bigint AS n_removed, sha256(coalesce(y.kept, '')) AS kept_sha256 FROM d LEFT JOIN y USING (doc_id)""",
    "op11_resample": r"""
WITH RECURSIVE k AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
 UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
x AS (SELECT side, id, unnest(w) AS f FROM k UNION ALL SELECT side, id, a || ' ' || b FROM (SELECT side, id, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM k)),
bit(v, c, i) AS (SELECT v, v, 0 FROM range(256) t(v) UNION ALL SELECT v, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM bit WHERE i < 8),
tab AS MATERIALIZED (SELECT v, c FROM bit WHERE i = 8),
h AS MATERIALIZED (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM x)),
r(f, h, i, c) AS (SELECT f, h, 0, 4294967295 FROM h UNION ALL SELECT f, h, i + 1, xor(r.c >> 8, tab.c) FROM r JOIN tab ON tab.v = xor(r.c & 255, ('0x' || substr(h, 2 * i + 1, 2))::bigint) WHERE 2 * i < len(h)),
crc AS MATERIALIZED (SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM r WHERE 2 * i = len(h)),
n AS MATERIALIZED (SELECT side, id, bucket, count(*) AS n FROM x JOIN crc USING (f) GROUP BY ALL),
c AS (SELECT range AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM range(10000) LEFT JOIN (SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM n GROUP BY bucket) ON bucket = range),
g AS MATERIALIZED (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::double / ((s + 1) * (sum(t) OVER () + 10000))::double))::bigint AS gain FROM c),
m AS (SELECT id, sum(n)::bigint AS n_features, floor(sum(n * gain)::double / sum(n)::double)::bigint AS weight FROM n JOIN g USING (bucket) WHERE side = 'd' GROUP BY id),
d AS (SELECT id AS doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint AS score FROM k LEFT JOIN m USING (id) WHERE side = 'd'),
o AS (SELECT *, words >= 20 AS may, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, 25 * count(*) OVER (PARTITION BY words >= 20) // 100 AS draw FROM d)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= draw THEN place END AS rank FROM o""",
}
