"""Registered queries over folders of raw files: the audit of a folder of both families
against the clean table, and the extract of wide files from a national long file.

The folders are written from the driver tables in the shared scratch area; every row
of the tables is in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit as AU
from ..session import ensure_checkpoint_dir
from ..sources import extract as EX
from ..sources import ingest as I
from ..sources import sinks as K
from . import sqlviews as S
from . import views as V
from .registry import register

# ------------------------------------------------------------ folder audit
def raw_folder(spark: SparkSession, d: str) -> str:
    """Raw files of both families: two wide files per order status, one long file per
    return flag.  Some ids, candidates and votes are missing or no numbers."""
    root = K.scratch_path(spark, "raw-folder")
    number = F.col("id_bvote").cast("bigint")
    wide = V.ballots_wide(spark, d).select(
        F.concat("dataset_id", F.lit("-"), (number % 2).cast("string"), F.lit(".parquet"))
        .alias("file"), number.alias("objectid"),
        F.when(number % 50 == 0, F.lit(" NaN ")).otherwise(F.col("id_bvote")).alias("id_bvote"),
        F.lit("Orders").alias("scrutin"), F.lit("2001").alias("annee"), F.lit("1").alias("tour"),
        "num_arrond", F.col("id_bvote").alias("num_bureau"), "nb_inscr",
        F.col("nb_exprim").alias("nb_votant"), "nb_exprim",
        *[F.col(f"`{p}`") for p in S.PRIORITIES], "c_mktsegment", "c_acctbal")
    K.write_named_files(wide, "file", ["objectid"], root)
    lines = V.table(spark, d, "lineitem").select(
        F.concat(F.lit(V.LINES_FILE), "l_returnflag", F.lit(".parquet")).alias("file"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    # Texts that follow from a row's numbers are made once it lies in its file's order.
    texts = lambda rows: rows.select(
        "__file", *lines.columns[1:], F.concat(F.lpad((F.col("l_suppkey") % 100000).cast("string"), 5, "0"), F.lit("_"),
                 F.lpad((F.col("l_suppkey") % 10000).cast("string"), 4, "0")).alias("source_bv_id"),
        F.lit("Lines").alias("scrutin"), F.lit("2001").alias("annee"), F.lit("1").alias("tour"),
        F.when(F.col("l_partkey") % 40 != 0, F.col("l_partkey").cast("string")).alias("candidate"),
        F.when(F.col("l_suppkey") % 50 == 7, F.lit("n/a"))
        .otherwise(F.col("l_quantity").cast("string")).alias("votes"))
    K.write_named_files(lines, "file", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                        "l_quantity"], root, texts)
    return root


def _tampered(clean: DataFrame) -> DataFrame:
    """The cleaner's rows with known faults: rows lost, changed, doubled and invented."""
    row = F.col("raw_row_id")
    rows = F.filter(F.array(
        row, F.when(row % 101 == 7, row), F.when(row % 103 == 9, row + 1_000_000_000)),
        lambda r: r.isNotNull())
    return clean.where(row % 97 != 5).select(
        "dataset_id", "source_file", F.explode(rows).alias("raw_row_id"),
        "candidate_source_column",
        (F.col("votes") + F.when(row % 89 == 3, 1.0).otherwise(0.0)).alias("votes"))


def _folder_audit(spark: SparkSession, d: str) -> AU.FolderAudit:
    ensure_checkpoint_dir(spark)
    root = raw_folder(spark, d)
    clean, _ = I.clean_folder(spark, root, materialize=True)  # read twice
    return AU.audit_folder(spark, root, _tampered(clean))


_WIDE_CELLS = "\nUNION ALL ".join(
    f"SELECT dataset_id, raw_row_id, '{c.lower()}' AS candidate_source_column, \"{c}\" AS v FROM raw_wide WHERE valid"
    for c in (*S.PRIORITIES, "c_acctbal"))

FOLDER_CASES = f"""
raw_wide AS (
  SELECT * REPLACE (dataset_id || '-' || (CAST(id_bvote AS BIGINT) % 2) AS dataset_id),
         row_number() OVER (PARTITION BY dataset_id, CAST(id_bvote AS BIGINT) % 2
                            ORDER BY CAST(id_bvote AS BIGINT)) - 1 AS raw_row_id,
         CAST(id_bvote AS BIGINT) % 50 <> 0 AS valid
  FROM ({S.BALLOTS_WIDE}) AS w),
raw_lines AS (
  SELECT 'lineitem_muni_' || l_returnflag AS dataset_id, l_quantity,
         row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber,
                            l_partkey, l_suppkey, l_quantity) - 1 AS raw_row_id,
         CAST(l_partkey AS VARCHAR) AS candidate,
         l_partkey % 40 <> 0 AND l_suppkey % 50 <> 7 AS valid FROM lineitem),
expected AS (
  SELECT dataset_id, dataset_id || '.parquet' AS source_file, raw_row_id, candidate_source_column, v
  FROM ({_WIDE_CELLS}) AS cells
  UNION ALL SELECT dataset_id, dataset_id || '.parquet', raw_row_id, candidate, l_quantity
  FROM raw_lines WHERE valid),
kept AS (
  SELECT * REPLACE (v + CASE WHEN raw_row_id % 89 = 3 THEN 1.0 ELSE 0.0 END AS v)
  FROM expected WHERE raw_row_id % 97 <> 5),
clean AS (
  SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE raw_row_id % 101 = 7
  UNION ALL SELECT * REPLACE (raw_row_id + 1000000000 AS raw_row_id) FROM kept
  WHERE raw_row_id % 103 = 9),
e AS (SELECT dataset_id, source_file, raw_row_id, candidate_source_column, count(*) AS n,
             sum(v) AS s, min(v) AS mn, max(v) AS mx FROM expected GROUP BY ALL),
c AS (SELECT dataset_id, source_file, raw_row_id, candidate_source_column, count(*) AS n,
             sum(v) AS s, min(v) AS mn, max(v) AS mx FROM clean GROUP BY ALL),
cases AS (
  SELECT dataset_id, source_file, raw_row_id, candidate_source_column,
         coalesce(e.n, 0) AS expected_rows, coalesce(e.s, 0) AS expected_votes,
         coalesce(c.n, 0) AS clean_rows, coalesce(c.s, 0) AS votes,
         CASE WHEN c.n IS NULL THEN 'left_only' WHEN e.n IS NULL THEN 'right_only' ELSE 'both' END AS _merge,
         coalesce(c.s, 0) - coalesce(e.s, 0) AS vote_diff,
         CASE WHEN c.n IS NOT NULL AND e.n IS NOT NULL THEN greatest(c.mx - e.mn, e.mx - c.mn)
              ELSE abs(coalesce(c.s, 0) - coalesce(e.s, 0)) END AS abs_vote_diff
  FROM e FULL OUTER JOIN c USING (dataset_id, source_file, raw_row_id, candidate_source_column)),
tagged AS (
  SELECT CASE WHEN _merge = 'left_only' THEN 'missing_from_clean'
              WHEN _merge = 'right_only' THEN 'extra_in_clean'
              WHEN abs_vote_diff > 0.000001 THEN 'vote_value_mismatch' END AS problem_type, * FROM cases)
"""


@register("folder_audit_problems", f"""
WITH {FOLDER_CASES}
SELECT * FROM tagged WHERE problem_type IS NOT NULL
UNION ALL SELECT * REPLACE ('duplicate_clean_case' AS problem_type) FROM tagged WHERE clean_rows > 1
UNION ALL SELECT * REPLACE ('duplicate_expected_case' AS problem_type) FROM tagged WHERE expected_rows > 1
""", ("expected_votes", "votes", "vote_diff", "abs_vote_diff"))
def folder_audit_problems(spark, d):
    """J4 + J7 + A6 + U4: a folder of wide and long raw files against the clean table on
    all four case keys, through checksums per bucket."""
    return _folder_audit(spark, d).problems


def _check(name: str, value: str, status: str) -> str:
    return f"SELECT '{name}' AS \"check\", CAST({value} AS VARCHAR) AS value, {status} AS status FROM m"


def _zero(value: str, bad: str = "PROBLEM") -> str:
    return f"CASE WHEN {value} = 0 THEN 'OK' ELSE '{bad}' END"


@register("folder_audit_summary", f"""
WITH {FOLDER_CASES},
m AS (SELECT
  (SELECT count(DISTINCT dataset_id) FROM expected) AS used,
  (SELECT count(DISTINCT dataset_id) FROM raw_wide) + (SELECT count(DISTINCT dataset_id) FROM raw_lines)
    - (SELECT count(DISTINCT dataset_id) FROM expected) AS skipped,
  (SELECT count(*) FROM expected) AS expected, (SELECT count(*) FROM clean) AS clean,
  coalesce(sum(expected_rows) FILTER (problem_type = 'missing_from_clean'), 0) AS missing,
  coalesce(sum(clean_rows) FILTER (problem_type = 'extra_in_clean'), 0) AS extra,
  count(*) FILTER (problem_type = 'vote_value_mismatch') AS mismatches,
  count(*) FILTER (clean_rows > 1) AS twice_clean, count(*) FILTER (expected_rows > 1) AS twice_expected
  FROM tagged)
{" UNION ALL ".join([
    _check("raw_files_used_for_expected_cases", "used", "CASE WHEN used > 0 THEN 'OK' ELSE 'PROBLEM' END"),
    _check("raw_files_skipped_for_expected_cases", "skipped", _zero("skipped", "CHECK")),
    _check("expected_raw_candidate_cases", "expected", "'INFO'"),
    _check("clean_long_cases", "clean", "'INFO'"),
    _check("missing_from_clean", "missing", _zero("missing")),
    _check("extra_in_clean", "extra", _zero("extra")),
    _check("vote_value_mismatches", "mismatches", _zero("mismatches")),
    _check("duplicate_clean_cases", "twice_clean", _zero("twice_clean")),
    _check("duplicate_expected_cases", "twice_expected", _zero("twice_expected"))])}
""")
def folder_audit_summary(spark, d):
    """The nine checks of the folder audit as (check, value, status)."""
    return _folder_audit(spark, d).summary


# ------------------------------------------------------------ national extract
REGION = "R"
ELECTIONS = tuple(f"{year}_muni_t{turn}" for year in (1994, 1995, 1996) for turn in (1, 2))
CANDIDATES = tuple(f"{b.lower()}{tail}" for b in S.BRANDS for tail in ("", "_de_l"))


def national(spark: SparkSession, d: str) -> DataFrame:
    """One long table of all elections: line items as results of parts' brands."""
    part = V.table(spark, d, "part").select("p_partkey", "p_brand")
    return V.table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.year("l_shipdate").cast("string"), F.lit("_muni_t"),
                 (F.col("l_linenumber") % 2 + 1).cast("string")).alias("id_election"),
        F.col("l_returnflag").alias("code_departement"),
        F.col("l_suppkey").cast("string").alias("code_bv"),
        F.when(F.col("l_partkey") % 30 != 0, F.col("p_brand")).alias("nom"),
        F.when((F.col("l_partkey") % 30 != 0) & (F.col("l_linestatus") == "F"), F.lit(" De L "))
        .alias("prenom"),
        F.when(F.col("l_linenumber") == 3, F.lit("x")).otherwise(F.col("l_quantity").cast("string"))
        .alias("voix"),
        (F.col("l_discount") * 100).alias("ratio_voix_exprimes"),
        (F.col("l_tax") * 100).alias("ratio_voix_inscrits"))


@register("extract_wide", f"""
WITH n AS (
  SELECT year(l_shipdate) || '_muni_t' || (l_linenumber % 2 + 1) AS id_election,
         CAST(year(l_shipdate) AS INTEGER) AS annee, CAST(l_linenumber % 2 + 1 AS INTEGER) AS tour,
         CASE WHEN length(CAST(l_suppkey AS VARCHAR)) < 4 THEN lpad(CAST(l_suppkey AS VARCHAR), 4, '0')
              ELSE CAST(l_suppkey AS VARCHAR) END AS code,
         CASE WHEN l_partkey % 30 = 0 THEN ''
              ELSE lower(p_brand) || CASE WHEN l_linestatus = 'F' THEN '_de_l' ELSE '' END END AS candidate,
         CASE WHEN l_linenumber <> 3 THEN l_quantity END AS voix,
         l_discount * 100 AS re, l_tax * 100 AS ri
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_returnflag = '{REGION}'),
r AS (
  SELECT *, CAST(code[1:2] AS INTEGER) AS num_arrond, CAST(code[3:] AS INTEGER) AS num_bureau
  FROM n WHERE id_election IN {S.names(ELECTIONS)}),
totals AS (
  SELECT id_election, num_arrond, num_bureau,
         CAST(round_even(median(CASE WHEN re > 0 THEN voix / (re / 100) END), 0) AS BIGINT) AS nb_exprim,
         CAST(round_even(median(CASE WHEN ri > 0 THEN voix / (ri / 100) END), 0) AS BIGINT) AS nb_inscr
  FROM r GROUP BY ALL),
wide AS (
  SELECT id_election, annee, tour, num_arrond, num_bureau,
         {", ".join(f"CAST(coalesce(sum(voix) FILTER (candidate = '{c}'), 0) AS DOUBLE) AS {chr(34)}{c}{chr(34)}" for c in CANDIDATES)}
  FROM r WHERE candidate <> '' GROUP BY ALL)
SELECT '{EX.fixed.LONG_FAMILY_PREFIX}' || annee || CASE tour WHEN 1 THEN '-1ertour' ELSE '-2emetour' END
         || '.parquet' AS source_file,
       num_arrond || '-' || num_bureau AS id_bvote, 'Municipales' AS scrutin, nb_exprim, nb_inscr,
       CAST(NULL AS BIGINT) AS nb_votant, wide.* EXCLUDE (id_election)
FROM wide LEFT JOIN totals USING (id_election, num_arrond, num_bureau)
""", CANDIDATES)
def extract_wide(spark, d):
    """F3 + P12-P14 + P24 + A3 + R4 + J2 + S11: the national file to one wide file per
    election, read back with the file names."""
    root = K.scratch_path(spark, "extract-wide")
    done = EX.extract_elections(national(spark, d), root, REGION, ELECTIONS, "Municipales",
                                CANDIDATES)
    back = I.read_with_provenance(spark, done.files)
    rest = [f"`{c}`" for c in back.columns if c not in I.PROVENANCE]
    return back.select("source_file", *rest)
