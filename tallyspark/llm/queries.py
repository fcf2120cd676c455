"""Registered queries ``opN_<name>``: each applies its operator, with production
parameters, to the whole table it is meant for.

``QUERIES``: name -> (builder, DuckDB SQL or None).  None: SQL cannot express
the operator; tests compare it with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, hnsw, lexical, line_dedup, ngram_join, packing, pii, quality, revisits,
               substrings, token_counts, toxicity, variants)
from .staging import importable, new_folder, stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every row for each row whose vec_id 100 divides."""
    distinct = stage(hnsw.points(_table(spark, sf_dir, "embeddings"), k=10), "points")
    shards = stage(hnsw.index(distinct), "shards")
    queries = (hnsw.usable(_table(spark, sf_dir, "embeddings"))
               .where(F.col("id") % 100 == 0)
               .select(F.col("id").alias("query_id"), "vector"))
    return hnsw.search(shards, queries, k=10)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts of all documents."""
    return quality.quality_verdicts(_table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = _table(spark, sf_dir, "documents")
    chain = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "spans")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from a cache that starts empty."""
    counts = token_counts.count_tokens(
        _table(spark, sf_dir, "documents"), new_folder(spark, "token-cache"),
        public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens",
                         (F.col("n_tokens") > 512).alias("over_limit"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the bytes they decode to, as digests."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = byte_bpe.round_trip(_table(spark, sf_dir, "documents"), ranks,
                               public_tokenizers.PATTERN)
    return both.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("bytes", 256).alias("decoded_sha256"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 3-word Jaccard similarity of 0.9."""
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), size=3, percent=90)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data, and of terms that reveal it, in all documents."""
    found = pii.pii_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*[pii.span_list(k) for k in pii.PATTERNS])
    return found.select(
        "doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in pii.PATTERNS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, pii.span_list("term")), ",").alias("spans"))


def _records(pages: DataFrame) -> DataFrame:
    """Archive records that follow from the pages: each page as a full response, a
    later revisit of it under a variant of its URL, and for some an earlier one.

    Entity tags are digests of the pages.  Every 11th response has none, every 7th
    later revisit has a changed one, every 13th page names no time of modification.
    """
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    page = pages.select(
        "page_id", "url", (F.lit(1_700_000_000) + F.col("page_id") * 60).alias("at"),
        F.when(F.col("page_id") % 11 != 3, tag).alias("tag"),
        F.when(F.col("page_id") % 13 != 0, F.concat(F.lit("m"), F.col("page_id").cast("string")))
        .alias("modified"),
        F.md5("html").alias("digest"), F.octet_length("html").cast("string").alias("size"))
    later = F.col("at") + 30 + (F.col("page_id") % 50) * 3600
    record = lambda number, url, ts, kind, own, digest, **headers: F.struct(
        (F.col("page_id") * 3 + number).alias("record_id"), url.alias("url"), ts.alias("ts"),
        F.lit(kind).alias("kind"), own.alias("etag"), F.col("modified").alias("last_modified"),
        digest.alias("digest"),
        F.map_filter(F.create_map(*[x for k, v in headers.items()
                                    for x in (F.lit(k.replace("_", "-")), v)]),
                     lambda k, v: v.isNotNull()).alias("headers"))
    changed = F.when(F.col("page_id") % 7 == 0, F.lit('"changed"')).otherwise(F.col("tag"))
    none = F.lit(None).cast("string")
    records = F.array(
        record(0, F.col("url"), F.col("at"), "response", F.col("tag"), F.col("digest"),
               content_length=F.col("size"), date=F.col("at").cast("string"), etag=F.col("tag"),
               server=F.lit("origin")),
        record(1, F.concat("url", F.lit("#again")), later, "revisit", changed, none,
               cache_control=F.lit("max-age=60"), content_length=F.lit("0"),
               date=later.cast("string")),
        record(2, F.col("url"), F.col("at") - 7200, "revisit", F.col("tag"), none,
               date=(F.col("at") - 7200).cast("string")))
    return (page.select("page_id", F.explode(records).alias("r")).select("r.*")
            .where((F.col("record_id") % 3 != 2) | (F.expr("record_id div 3") % 5 == 0)))


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages with their revisits resolved."""
    found = revisits.resolve_revisits(_records(_table(spark, sf_dir, "pages")))
    listed = F.array_join(F.sort_array(F.transform(
        F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.withColumn("headers", listed)


OP8_SQL = r"""
WITH page AS (
  SELECT page_id, url, 1700000000 + page_id * 60 AS taken,
         CASE WHEN page_id % 11 <> 3 THEN '"' || md5(html) || '"' END AS tag,
         CASE WHEN page_id % 13 <> 0 THEN 'm' || page_id END AS modified,
         md5(html) AS digest, strlen(html) AS size FROM pages),
records AS (
  SELECT page_id * 3 AS record_id, url, taken AS ts, 'response' AS kind, tag AS etag, modified, digest,
         'content-length=' || size || ';date=' || taken || coalesce(';etag=' || tag, '')
           || ';server=origin' AS headers, size, tag FROM page
  UNION ALL
  SELECT page_id * 3 + 1, url || '#again', taken + 30 + (page_id % 50) * 3600, 'revisit',
         CASE WHEN page_id % 7 = 0 THEN '"changed"' ELSE tag END, modified, NULL,
         'cache-control=max-age=60;content-length=0;date=' || (taken + 30 + (page_id % 50) * 3600),
         NULL, NULL FROM page
  UNION ALL
  SELECT page_id * 3 + 2, url, taken - 7200, 'revisit', tag, modified, NULL, 'date=' || (taken - 7200),
         NULL, NULL FROM page WHERE page_id % 5 = 0),
split AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(url,
             '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(url,
             '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(
             string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
             lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))),
             '&') AS query
  FROM records),
named AS (
  SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url
  FROM split),
met AS (
  SELECT r.*, f.record_id AS f_id, f.etag AS f_etag, f.modified AS f_modified, f.digest AS f_digest,
         f.size AS f_size, f.tag AS f_tag
  FROM named r ASOF LEFT JOIN (SELECT * FROM named WHERE kind = 'response') f
    ON r.canonical_url = f.canonical_url AND r.ts > f.ts),
judged AS (
  SELECT *, CASE WHEN kind = 'response' THEN 'response'
      WHEN f_id IS NULL THEN 'no_earlier_response'
      WHEN etag IS NOT NULL AND f_etag IS NOT NULL
        THEN CASE WHEN etag = f_etag THEN 'resolved' ELSE 'validator_mismatch' END
      WHEN modified IS NOT NULL AND f_modified IS NOT NULL
        THEN CASE WHEN modified = f_modified THEN 'resolved' ELSE 'validator_mismatch' END
      ELSE 'no_validator' END AS outcome FROM met)
SELECT record_id, canonical_url, ts, outcome,
       CASE WHEN outcome = 'resolved' THEN f_id END AS refers_to,
       CASE WHEN outcome = 'resolved' THEN f_digest ELSE digest END AS digest,
       CASE WHEN outcome = 'resolved' THEN
         CASE WHEN record_id % 3 = 1 THEN 'cache-control=max-age=60;' ELSE '' END
         || 'content-length=' || f_size || ';date=' || ts || coalesce(';etag=' || f_tag, '')
         || ';server=origin' ELSE headers END AS headers
FROM judged
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines of 20 characters or more that 3 documents share."""
    left = line_dedup.drop_repeated_lines(
        _table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=20, min_docs=3)
    return left.select("doc_id", F.col("_n_lines").alias("n_lines"),
                       F.col("_n_dropped").alias("n_dropped"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, coalesce(shared.last <> keyed.doc_id, false) AS gone
  FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), ''))
         AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 tokens, by source."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"),
                          public_tokenizers.path("word_bpe_49k.json"), end_id=2, window=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return lexical.rank_documents(_table(spark, sf_dir, "documents"),
                                  _table(spark, sf_dir, "benchmark"), k=10)


OP11_SQL = r"""
WITH tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY ALL),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM sizes),
weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM tfs, totals GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // l))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id), totals
  GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words' most frequent one."""
    words = variants.count_words(_table(spark, sf_dir, "documents"), rate=97)
    return variants.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without bytes of 100-byte strings that start earlier too."""
    texts, rows = substrings.repeated_substrings(_table(spark, sf_dir, "documents"), 100)
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a),
                          F.lit(0).cast("long"), lambda s, x: s + x)
    digests = stage(texts.select("digest", "n_bytes", removed.alias("n_removed"),
                                 F.size("starts").cast("long").alias("n_spans"),
                                 F.sha2("kept", 256).alias("kept_sha256")).distinct(), "kept")
    return substrings.attach(digests, rows, 100)


QUERIES = {
    "op1_hnsw": (op1_hnsw, None),
    "op2_quality_rules": (op2_quality_rules, None),
    "op3_toxicity": (op3_toxicity, None),
    "op4_token_counts": (op4_token_counts, None),
    "op5_byte_bpe": (op5_byte_bpe, None),
    "op6_ngram_join": (op6_ngram_join, None),
    "op7_pii": (op7_pii, None),
    "op8_revisits": (op8_revisits, OP8_SQL),
    "op9_line_dedup": (op9_line_dedup, OP9_SQL),
    "op10_packing": (op10_packing, None),
    "op11_lexical_search": (op11_lexical_search, OP11_SQL),
    "op12_spelling_variants": (op12_spelling_variants, None),
    "op13_substrings": (op13_substrings, None),
}
