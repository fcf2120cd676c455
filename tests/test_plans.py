"""Plan shape: JVM-side expressions only, filters pushed to the scan."""

import os

import pytest

import __spark_entry__ as E
from tallyspark.plans import load_all

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                "MapInPandas", "PythonUDF")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(load_all()))
def test_no_python_in_plan(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert not any(node in plan for node in PYTHON_NODES), name


def test_filter_pushed_to_scan(spark):
    plan = _plan(E.queries()["filter_isin"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F), In(o_orderpriority" \
        in plan


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(E.queries()["station_vote_check"](spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan
    assert "l_shipdate" not in plan and "l_returnflag" not in plan


def test_purchases_sum_at_the_grain_of_the_view(spark, tmp_path):
    """No sum per (year, supplier, part), which holds about as many rows as the table."""
    import datetime

    from tallyspark.plans import views as V
    day = datetime.datetime(1995, 3, 1)
    spark.createDataFrame([(1, 1, 2.0, day), (1, 1, 3.0, day), (1, 2, 4.0, day), (2, 1, 5.0, day), (3, 1, 6.0, day),
                           (None, 1, 7.0, day), (1, 3, None, None)],
                          "l_suppkey long, l_partkey long, l_quantity double, l_shipdate timestamp_ntz"
                          ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, "b"), (2, "b"), (3, None)], "p_partkey long, p_brand string").write.parquet(
        str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, 5), (2, 6), (2, 6)], "s_suppkey long, s_nationkey int").write.parquet(
        str(tmp_path / "supplier.parquet"))
    got = V.purchases(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [("1995", "1", "5", "b", 9.0), ("1995", "2", "6", "b", 10.0), (None, "1", "5", None, None)], key=str)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_pivot_sums_each_cell_once(spark):
    from tallyspark.operators import reshape as R
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0), ("a", "y", None), ("b", None, 4.0)],
                               "k string, c string, v double")
    wide = R.pivot_sum(df, ["k"], "c", "v")
    assert sorted(map(tuple, wide.collect())) == [("a", 3.0, 0.0), ("b", 0.0, 0.0)]
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
