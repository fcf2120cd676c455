"""Registered queries: scalar rules (Column -> Column) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import fixed
from ..sources import ingest as I
from . import views as V
from .registry import register

# DuckDB twins of the text helpers.
STRIP = "regexp_replace(CAST({} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"
INT_RE = "'[+-]?\\d+'"


def _strip(x: str) -> str:
    return STRIP.format(x)


def _missing_sql(x: str, tokens=fixed.MISSING_TOKENS) -> str:
    toks = ", ".join(f"'{t}'" for t in tokens)
    return f"({x} IS NULL OR lower({_strip(x)}) IN ({toks}))"


@register("parse_structured_key", f"""
SELECT c_custkey, k AS key,
       NULLIF(regexp_extract(k, '^(\\d{{5}})_(\\d{{2}})(\\d{{2}})$', 2), '') AS area,
       NULLIF(regexp_extract(k, '^(\\d{{5}})_(\\d{{2}})(\\d{{2}})$', 3), '') AS unit,
       NULLIF(regexp_extract(n, '^(\\d{{5}})_(\\d{{2}})(\\d{{2}})$', 2), '') AS name_area
FROM (SELECT c_custkey, {_strip("lpad(CAST(c_nationkey AS VARCHAR), 5, '0') || '_' || right(c_name, 4)")} AS k,
             {_strip("c_name")} AS n FROM customer) AS t
""")
def parse_structured_key(spark, d):
    """Station key ``ddddd_aauu`` -> area and unit (null when no match)."""
    c = V.table(spark, d, "customer")
    text = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 5, "0"), F.lit("_"),
                    F.substring("c_name", -4, 4))
    k = X.parse_structured_key(text)
    n = X.parse_structured_key("c_name")
    return c.select("c_custkey", k["key"].alias("key"), k["area"].alias("area"),
                    k["unit"].alias("unit"), n["area"].alias("name_area"))


@register("padded_code", f"""
SELECT c_custkey,
       CASE WHEN regexp_full_match(a, {INT_RE}) THEN CAST(a AS INTEGER) END AS area,
       CASE WHEN regexp_full_match(u, {INT_RE}) THEN CAST(u AS INTEGER) END AS unit,
       CASE WHEN regexp_full_match(a, {INT_RE}) AND regexp_full_match(u, {INT_RE})
            THEN CAST(CAST(a AS INTEGER) AS VARCHAR) || '-' || CAST(CAST(u AS INTEGER) AS VARCHAR)
       END AS key
FROM (SELECT c_custkey, substr(s, 1, 2) AS a, substr(s, 3) AS u
      FROM (SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 4
                                   THEN lpad(CAST(c_custkey AS VARCHAR), 4, '0')
                                   ELSE CAST(c_custkey AS VARCHAR) END AS s
            FROM customer) AS p) AS q
""")
def padded_code(spark, d):
    """Zero-filled unit code -> area, unit and ``area-unit`` key."""
    c = V.table(spark, d, "customer")
    p = X.padded_code("c_custkey")
    return c.select("c_custkey", p["area"].alias("area"), p["unit"].alias("unit"),
                    p["key"].alias("key"))


@register("extract_year", """
SELECT o_orderkey,
       CAST(NULLIF(regexp_extract(CAST(o_orderdate AS VARCHAR), '(20\\d{2})', 1), '') AS INTEGER)
         AS annee
FROM orders
""")
def extract_year(spark, d):
    """P5: first ``20dd`` year in the text of the order date, else null."""
    return V.table(spark, d, "orders").select("o_orderkey",
                                              X.extract_year("o_orderdate").alias("annee"))


SPLIT_TEXT_SQL = ("CAST(year(o_orderdate) AS VARCHAR) || '_' || o_orderstatus || '_t' "
                  "|| substr(o_orderpriority, 1, 1)")


@register("split_key", f"""
SELECT o_orderkey, election_id,
       CASE WHEN ok THEN CAST(y AS INTEGER) END AS annee,
       CASE WHEN ok THEN CAST(r AS INTEGER) END AS tour
FROM (SELECT *, coalesce(regexp_full_match(y, {INT_RE}) AND regexp_full_match(r, '\\d'), false) AS ok
      FROM (SELECT o_orderkey, election_id,
                   {_strip("NULLIF(split_part(election_id, '_', 1), '')")} AS y,
                   substr(NULLIF(split_part(election_id, '_', 3), ''), 2, 1) AS r
            FROM (SELECT o_orderkey, {SPLIT_TEXT_SQL} AS election_id FROM orders) AS a) AS b) AS c
""")
def split_key(spark, d):
    """``year_kind_tN`` id -> year and round (both null if either fails)."""
    o = V.table(spark, d, "orders")
    text = F.concat(F.year("o_orderdate").cast("string"), F.lit("_"), F.col("o_orderstatus"),
                    F.lit("_t"), F.substring("o_orderpriority", 1, 1))
    o = o.select("o_orderkey", text.alias("election_id"))
    k = X.split_key("election_id")
    return o.select("o_orderkey", "election_id", k["year"].alias("annee"),
                    k["round"].alias("tour"))


def _category_sql(x: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.CATEGORY_CORRECTIONS)
    s = _strip(x)
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE CASE lower({s}) {cases} ELSE {s} END END"


@register("canonical_category", f"""
SELECT p_partkey, {_category_sql("p_type")} AS category FROM part
""")
def canonical_category(spark, d):
    """Known spellings corrected, otherwise the trimmed text."""
    return V.table(spark, d, "part").select("p_partkey",
                                            X.canonical_category("p_type").alias("category"))


@register("missing_like", f"""
SELECT doc_id, {_missing_sql("lang")} AS lang_missing,
       {_missing_sql("source")} AS source_missing,
       {_missing_sql("text", fixed.MISSING_TOKENS_WIDE)} AS text_missing
FROM documents
""")
def missing_like(spark, d):
    """P8 + P9: null or missing-like text (the wider token list for text)."""
    docs = V.table(spark, d, "documents")
    return docs.select("doc_id", X.missing_like("lang").alias("lang_missing"),
                       X.missing_like("source").alias("source_missing"),
                       X.missing_like("text", fixed.MISSING_TOKENS_WIDE).alias("text_missing"))


@register("finite_or_null", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_discount <> 0 AND isfinite(l_extendedprice / l_discount)
            THEN l_extendedprice / l_discount END AS ratio
FROM lineitem
""", ("ratio",))
def finite_or_null(spark, d):
    """P10: price / discount, null where it is not a finite number."""
    li = V.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     X.share("l_extendedprice", "l_discount").alias("ratio"))


def _name_sql(x: str) -> str:
    return f"replace(lower({_strip(f'coalesce(CAST({x} AS VARCHAR), {chr(39)}{chr(39)})')}), ' ', '_')"


@register("compose_name", f"""
SELECT p_partkey, CASE WHEN {_name_sql("p_type")} <> ''
                       THEN {_name_sql("p_name")} || '_' || {_name_sql("p_type")}
                       ELSE {_name_sql("p_name")} END AS candidate
FROM part
""")
def compose_name(spark, d):
    """``name_first`` in lower case with spaces as underscores."""
    return V.table(spark, d, "part").select(
        "p_partkey", X.compose_name("p_name", "p_type").alias("candidate"))


@register("safe_name", f"""
SELECT page_id, coalesce(NULLIF(regexp_replace(regexp_replace({_strip("url")},
         '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') AS file_name
FROM pages
""")
def safe_name(spark, d):
    """File-name-safe form of each page URL."""
    return V.table(spark, d, "pages").select("page_id", X.safe_name("url").alias("file_name"))


@register("file_key", f"""
SELECT page_id, coalesce(CASE WHEN n = '.' THEN '' ELSE n END, '') AS file_key
FROM (SELECT page_id,
             regexp_extract(regexp_replace({_strip("replace(url, chr(92), '/')")},
                                           '(/+\\.?)+$', ''), '([^/]*)$', 1) AS n
      FROM pages) AS p
""")
def file_key(spark, d):
    """Base name of each page URL path."""
    return V.table(spark, d, "pages").select("page_id", X.file_key("url").alias("file_key"))


def _contains_sql(cols, markers=fixed.LONG_FAMILY_MARKERS) -> str:
    terms = [f"coalesce(contains(lower({_strip(c)}), '{m}'), false)" for c in cols
             for m in markers]
    return "(" + " OR ".join(terms) + ")"


@register("class_flag", f"""
SELECT doc_id, {_contains_sql(["lang", "source"])} AS is_municipal FROM documents
""")
def class_flag(spark, d):
    """P20: family flag from marker substrings in the text columns."""
    return V.table(spark, d, "documents").select(
        "doc_id", X.class_flag(["lang", "source"]).alias("is_municipal"))


@register("check_status", """
SELECT l_orderkey, n_dup,
       CASE WHEN n_dup = 0 THEN 'OK' WHEN n_dup <= 5 THEN 'CHECK' ELSE 'PROBLEM' END AS status
FROM (SELECT l_orderkey, CAST(count_if(c > 1) AS BIGINT) AS n_dup
      FROM (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL) AS g
      GROUP BY l_orderkey) AS t
""")
def check_status(spark, d):
    """Per order, the number of repeated line numbers as OK / CHECK / PROBLEM."""
    li = V.table(spark, d, "lineitem")
    g = li.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("c"))
    t = g.groupBy("l_orderkey").agg(F.count_if(F.col("c") > 1).alias("n_dup"))
    return t.withColumn("status", X.check_status("n_dup"))


DATE_TEXT_SQL = ("CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') "
                 "ELSE strftime(o_orderdate, '%Y-%m-%d') END")


@register("parse_date_dayfirst", f"""
SELECT o_orderkey, date_text,
       coalesce(CAST(try_strptime(date_text, '%d/%m/%Y') AS DATE),
                CAST(try_strptime(date_text, '%Y-%m-%d') AS DATE)) AS date
FROM (SELECT o_orderkey, {DATE_TEXT_SQL} AS date_text FROM orders) AS t
""")
def parse_date_dayfirst(spark, d):
    """Day-first or ISO date text -> date, parsed once."""
    o = V.table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")) \
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    o = o.select("o_orderkey", text.alias("date_text"))
    return o.select("o_orderkey", "date_text", X.parse_date_dayfirst("date_text").alias("date"))


@register("coalesce_sum_columns", """
SELECT l_orderkey, l_linenumber,
       0.0::DOUBLE + coalesce(l_discount, 0.0::DOUBLE)
                   + coalesce(CASE WHEN l_tax <> 0 THEN l_tax END, 0.0::DOUBLE) AS nb_bl_nul
FROM lineitem
""", ("nb_bl_nul",))
def coalesce_sum_columns(spark, d):
    """Sum of two columns where a missing value counts as 0."""
    li = V.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     X.coalesce_sum("l_discount", F.when(F.col("l_tax") != 0, F.col("l_tax")))
                     .alias("nb_bl_nul"))


# Binding of the order columns to the station vocabulary (an alias map of
# the same kind as the fixed one, for this table).
ORDER_ALIASES = (("o_custkey", "id_bvote"), ("o_orderstatus", "scrutin"),
                 ("o_orderdate", "date"), ("o_totalprice", "nb_exprim"),
                 ("o_orderpriority", "tour"))


@register("alias_columns", """
SELECT o_orderkey, o_custkey AS id_bvote, o_orderstatus AS scrutin, o_totalprice AS nb_exprim,
       o_orderdate AS date, o_orderpriority AS tour
FROM orders
""", ("nb_exprim",))
def alias_columns(spark, d):
    """P1 + P2: trimmed lower-case names, renamed old -> new where the new name is free."""
    o = I.normalize_columns(V.table(spark, d, "orders"))
    return I.apply_aliases(o, ORDER_ALIASES)


@register("filter_isin", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
""", ("o_totalprice",))
def filter_isin(spark, d):
    """equality plus set-membership filter, pushed to the Parquet scan."""
    o = V.table(spark, d, "orders")
    return (o.where((F.col("o_orderstatus") == "F")
                    & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
            .select("o_orderkey", "o_custkey", "o_totalprice"))


@register("typed_projection", """
SELECT CAST(o_orderkey AS VARCHAR) AS id_bvote, o_orderstatus AS scrutin,
       CAST(NULLIF(regexp_extract(CAST(o_orderdate AS VARCHAR), '(20\\d{2})', 1), '') AS INTEGER)
         AS annee,
       CAST(o_orderdate AS DATE) AS date, o_totalprice AS nb_exprim, o_orderpriority AS tour,
       CAST(o_custkey AS BIGINT) AS raw_row_id
FROM orders
""", ("nb_exprim",))
def typed_projection(spark, d):
    """Output types forced by column name."""
    o = V.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id_bvote"), F.col("o_orderstatus").alias("scrutin"),
        F.col("o_orderdate").alias("annee"), F.col("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("nb_exprim"), F.col("o_orderpriority").alias("tour"),
        F.col("o_custkey").alias("raw_row_id"))
    return I.long_types(o)
