"""Station checks, row flags, wide checks, reconciliation (FIXTURES.md section 3)."""

from pyspark.sql import functions as F

from tallyspark.operators import quality as Q
from tallyspark.operators import reconcile as RC
from tallyspark.operators import reshape as R


def test_station_check_tolerances(spark):
    rows = [("s1", "a", 1177.0, 1155.0), ("s2", "a", 600.0, 1228.0), ("s2", "b", 627.0, 1228.0),
            ("s3", "a", 5.0, None), ("s4", "a", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id_bvote string, candidate string, votes double, "
                               "nb_exprim double")
    out = {r.id_bvote: r for r in Q.station_vote_check(df, ["id_bvote", "nb_exprim"]).collect()}
    assert not out["s1"].expressed_votes_ok and not out["s1"].vote_share_sum_ok
    assert not out["s2"].expressed_votes_ok and out["s2"].vote_share_sum_ok
    assert out["s2"].candidate_count == 2
    assert not out["s3"].expressed_votes_ok and out["s3"].vote_share_sum_ok   # null total
    assert out["s4"].expressed_votes_ok and out["s4"].vote_share_sum_from_votes is None
    mism = Q.station_mismatches(Q.station_vote_check(df, ["id_bvote", "nb_exprim"])).collect()
    assert [r.id_bvote for r in mism] == ["s1", "s2", "s3"]     # null difference last


def test_row_flags_and_counts(spark):
    rows = [("d", "f", 0, "c", "A", 10.0, 0.5, 0.1),
            ("d", "f", 0, "c", "A", 10.0, 0.5, 0.1),     # duplicate of the first
            ("d", "f", 1, "c2", "null", -1.0, 1.5, None),
            ("d", "f", 2, "c3", "B", None, 0.2, 0.2)]
    df = spark.createDataFrame(rows, "dataset_id string, source_file string, raw_row_id long, "
                               "candidate_source_column string, candidate string, votes double, "
                               "vote_share_exprimes double, vote_share_registered double")
    df = df.withColumn("id_bvote", F.lit("x"))
    flags = Q.row_problem_flags(df)
    counts = Q.row_problem_counts(flags).collect()[0]
    assert counts.municipal_rows == 4
    assert counts.municipal_duplicate_candidate_rows == 2
    assert counts.municipal_missing_candidate == 1
    assert counts.municipal_negative_votes == 1 and counts.municipal_missing_votes == 1
    assert counts.municipal_vote_share_exprimes_out_of_range == 1
    assert counts.municipal_vote_share_registered_out_of_range == 1
    assert counts.municipal_rows_with_any_problem == 4


def test_wide_check_and_long_form_agree(spark):
    long = spark.createDataFrame(
        [("s1", "a", 0.5), ("s1", "a", 0.7), ("s1", "b", -0.1), ("s2", "b", 0.4)],
        "id_bvote string, candidate string, vote_share_exprimes double")
    wide = R.pivot_shares(long, ["id_bvote"])
    a = Q.wide_range_check(wide, ["id_bvote"]).collect()[0]
    b = Q.wide_range_check_long(long, ["id_bvote"]).collect()[0]
    assert a == b
    assert (a.wide_rows, a.wide_columns, a.wide_values_above_one, a.wide_values_below_zero) == \
        (2, 3, 1, 1)


def test_wide_duplicate_index_rows(spark):
    wide = spark.createDataFrame([("s1", 0.5), ("s1", 0.5), ("s2", 1.0)],
                                 "id_bvote string, x double")
    assert Q.wide_range_check(wide).collect()[0].wide_duplicate_index_rows == 1


def test_row_count_check_lenient_and_strict(spark):
    report = spark.createDataFrame(
        [("raw/a.parquet", 10, 9, 2, 18, "ok"), ("raw/gone.parquet", 5, 5, 1, 5, "ok"),
         ("elections-municipales-x.parquet", 7, 7, 1, 7, "ok"), ("b.parquet", 1, 1, 1, 1, "skipped")],
        "file string, rows_raw long, rows_after_key_filter long, candidate_columns long, "
        "rows_clean_long long, status string")
    long = spark.createDataFrame([("a.parquet",)] * 18 + [("elections-municipales-x.parquet",)] * 7,
                                 "source_file string")
    lenient = {r.file: r for r in Q.row_count_check(report, long).collect()}
    assert set(lenient) == {"raw/a.parquet", "raw/gone.parquet", "elections-municipales-x.parquet"}
    assert lenient["raw/a.parquet"].row_count_ok                 # matched by base name
    assert lenient["raw/gone.parquet"].row_count_ok              # absent file passes (lenient)
    assert lenient["elections-municipales-x.parquet"].is_municipal
    strict = {r.file: r for r in Q.row_count_check(report, long, strict=True).collect()}
    assert not strict["raw/gone.parquet"].row_count_ok


def test_reconcile_five_problem_types(spark):
    keys = ["dataset_id", "source_file", "raw_row_id", "candidate_source_column"]
    exp = spark.createDataFrame(
        [("d", "f", 0, "a", 10.0), ("d", "f", 1, "a", 5.0), ("d", "f", 2, "a", 1.0),
         ("d", "f", 3, "a", 2.0), ("d", "f", 3, "a", 2.0), (None, "f", 9, "z", 4.0)],
        "dataset_id string, source_file string, raw_row_id long, "
        "candidate_source_column string, expected_votes double")
    clean = spark.createDataFrame(
        [("d", "f", 0, "a", 10.0000001), ("d", "f", 2, "a", 2.0), ("d", "f", 7, "a", 1.0),
         ("d", "f", 7, "a", 1.0), (None, "f", 9, "z", 4.0)],
        "dataset_id string, source_file string, raw_row_id long, "
        "candidate_source_column string, votes double")
    audit = RC.reconcile_outer(exp, clean, keys)
    kinds = [r.problem_type for r in audit.collect() if r.problem_type]
    # one row per key: a repeated key is one row (its rows are counted, not paired)
    assert sorted(kinds) == ["extra_in_clean", "missing_from_clean", "missing_from_clean",
                             "vote_value_mismatch"]
    rep = {r.raw_row_id: r for r in audit.collect()}
    assert rep[3].expected_rows == 2 and rep[7].clean_rows == 2
    assert rep[0].problem_type is None                                   # 1e-7 passes
    null_row = audit.where(F.col("dataset_id").isNull()).collect()
    assert len(null_row) == 1 and null_row[0]["_merge"] == "both"        # null keys match
    problems = RC.audit_problems(audit, exp, clean, keys)
    types = {r.problem_type for r in problems.collect()}
    assert types == {"missing_from_clean", "extra_in_clean", "vote_value_mismatch",
                     "duplicate_clean_case", "duplicate_expected_case"}
    summary = {r.check: (r.value, r.status) for r in
               RC.audit_summary(RC.audit_counts(audit, exp, clean, keys), 2, 1).collect()}
    assert summary["vote_value_mismatches"] == ("1", "PROBLEM")
    assert summary["missing_from_clean"] == ("3", "PROBLEM")            # rows, not keys
    assert summary["extra_in_clean"] == ("2", "PROBLEM")
    assert summary["duplicate_clean_cases"] == ("1", "PROBLEM")
    assert summary["raw_files_skipped_for_expected_cases"] == ("1", "CHECK")
    assert summary["clean_long_cases"] == ("5", "INFO")


def test_first_per_key_and_suspicious(spark):
    df = spark.createDataFrame([("k", "b", 1.0), ("k", "a", 2.0), ("j", "c", 3.0)],
                               "key string, name string, v double")
    got = {r.key: r.name for r in Q.first_per_key(df, ["key"], ["name"]).collect()}
    assert got == {"k": "a", "j": "c"}
    long = spark.createDataFrame([("nb_inscr",), ("Dupont",), ("geo_point_2d",), (None,)],
                                 "candidate string")
    assert [r.candidate for r in Q.suspicious_names(long).collect()] == ["geo_point_2d",
                                                                         "nb_inscr"]
