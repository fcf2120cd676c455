"""Scalar rules on hand-made values (FIXTURES.md section 3)."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tallyspark.functions import expr as X


def one_col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {typ}")


def col_values(df, c="out"):
    return [r[c] for r in df.collect()]


def test_missing_like_tokens(spark):
    df = one_col(spark, [None, "", " NaN ", "none", "<NA>", "null", "x"])
    out = col_values(df.select(X.missing_like("v").alias("out")))
    assert out == [True, True, True, True, True, False, False]
    wide = col_values(df.select(X.missing_like("v", X.fixed.MISSING_TOKENS_WIDE).alias("out")))
    assert wide[5] is True


def test_to_number_rules(spark):
    df = one_col(spark, ["1", " 2.5 ", "1d", "1f", "nan", "inf", "-Infinity", "x", None, "1e3"])
    out = col_values(df.select(X.to_number("v").alias("out")))
    assert out[:2] == [1.0, 2.5]
    assert out[2] is None and out[3] is None and out[4] is None
    assert out[5] == math.inf and out[6] == -math.inf
    assert out[7] is None and out[8] is None and out[9] == 1000.0


def test_finite_and_share(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (3.0, 4.0), (None, 2.0)], "a double, b double")
    out = col_values(df.select(X.share("a", "b").alias("out")))
    assert out == [None, None, 0.75, None]
    inf = spark.createDataFrame([(float("inf"),), (float("nan"),), (1.5,)], "v double")
    assert col_values(inf.select(X.finite_or_null("v").alias("out"))) == [None, None, 1.5]


def test_canonical_category(spark):
    df = one_col(spark, ["réguinales", " Présidentielles ", "Autre", None])
    out = col_values(df.select(X.canonical_category("v").alias("out")))
    assert out == ["Régionales", "Présidentielle", "Autre", None]


def test_extract_year_and_date(spark):
    df = one_col(spark, ["2017-04-23", "1999", None, "élection 2022 t1"])
    assert col_values(df.select(X.extract_year("v").alias("out"))) == [2017, None, None, 2022]
    d = one_col(spark, ["07/05/2017", "2024-06-09", "bad", "2017-04-23 10:00:00", None])
    assert col_values(d.select(X.parse_date_dayfirst("v").alias("out"))) == [
        dt.date(2017, 5, 7), dt.date(2024, 6, 9), None, dt.date(2017, 4, 23), None]


def test_structured_and_padded_keys(spark):
    df = one_col(spark, ["75056_0112", "75056_1", None, " 75056_2003 "])
    k = X.parse_structured_key("v")
    rows = df.select(k["area"].alias("a"), k["unit"].alias("u")).collect()
    assert [(r.a, r.u) for r in rows] == [("01", "12"), (None, None), (None, None), ("20", "03")]
    codes = one_col(spark, ["101", "0101", "12345", "x1"])
    p = X.padded_code("v")
    rows = codes.select(p["key"].alias("k"), p["area"].alias("a")).collect()
    assert [r.k for r in rows] == ["1-1", "1-1", "12-345", None]


def test_split_key(spark):
    df = one_col(spark, ["2020_muni_t1", "2014_muni_t2", "bad", "x_muni_t1", None])
    k = X.split_key("v")
    rows = df.select(k["year"].alias("y"), k["round"].alias("r")).collect()
    assert [(r.y, r.r) for r in rows] == [(2020, 1), (2014, 2), (None, None), (None, None),
                                         (None, None)]


def test_names(spark):
    df = spark.createDataFrame([("Dupont ", "Jean Paul"), ("DE LA X", None), (None, "A")],
                               "n string, p string")
    out = col_values(df.select(X.compose_name("n", "p").alias("out")))
    assert out == ["dupont_jean_paul", "de_la_x", "_a"]
    s = one_col(spark, ["a b/c", "___", None, "élections-2024"])
    assert col_values(s.select(X.safe_name("v").alias("out"))) == [
        "a_b_c", "unknown", "unknown", "lections-2024"]
    f = one_col(spark, ["data\\raw\\x.parquet", " a/b.csv ", None, "dir/"])
    assert col_values(f.select(X.file_key("v").alias("out"))) == ["x.parquet", "b.csv", "", "dir"]


def test_flags_and_status(spark):
    df = spark.createDataFrame([("Municipales", "x"), ("a", "2020_muni_t1"), ("b", None)],
                               "s string, d string")
    assert col_values(df.select(X.class_flag(["s", "d"]).alias("out"))) == [True, True, False]
    n = spark.createDataFrame([(0,), (5,), (6,)], "v int")
    assert col_values(n.select(X.check_status("v").alias("out"))) == ["OK", "CHECK", "PROBLEM"]
    names = one_col(spark, ["nb_inscr", "geo_x", "x_shape", "DUPONT", "num_bureau", "stx"])
    assert col_values(names.select(X.suspicious_name("v").alias("out"))) == [
        True, True, True, False, True, False]


def test_coalesce_sum_and_safe_int(spark):
    df = spark.createDataFrame([("1", None), ("x", "2"), (None, None)], "a string, b string")
    assert col_values(df.select(X.coalesce_sum("a", "b").alias("out"))) == [1.0, 2.0, 0.0]
    v = one_col(spark, ["3.7", "-3.7", "x", "inf", None])
    assert col_values(v.select(X.safe_int("v", 9).alias("out"))) == [3, -3, 9, 9, 9]


def test_backcalc_total(spark):
    df = spark.createDataFrame([(10.0, 50.0), (3.0, 0.0), (3.0, None)], "c double, p double")
    assert col_values(df.select(X.backcalc_total("c", "p").alias("out"))) == [20.0, None, None]


def test_round_half_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-2.5,)], "v double")
    assert col_values(df.select(X.round_half_even("v").alias("out"))) == [2.0, 4.0, -2.0]
    assert F is not None
