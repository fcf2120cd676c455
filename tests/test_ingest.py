"""Ingest of drifting raw files, shares, pivots, routing and sinks."""

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import reshape as R
from tallyspark.operators import totals as TT
from tallyspark.sources import catalog as C
from tallyspark.sources import ingest as I
from tallyspark.sources import sinks as K


@pytest.fixture(scope="module")
def raw_dir():
    d = tempfile.mkdtemp(prefix="tallyspark-raw-")
    # standard names, one bad total, one missing id, a text column
    pd.DataFrame({
        "ID_BVOTE": ["1-1", "1-2", None, "1-4"],
        "scrutin": [" Présidentielles ", "présidentielles", "x", "x"],
        "annee": ["2017-04-23", "2017", "2017", "2017"],
        "tour": ["1", "1", "1", "1"],
        "date": ["23/04/2017", "23/04/2017", "23/04/2017", "23/04/2017"],
        "num_arrond": ["1", "1", "1", "1"], "num_bureau": ["1", "2", "3", "4"],
        "nb_inscr": [100, 100, 100, 100], "nb_votant": [80, 80, 80, 80],
        "nb_exprim": ["70", "x", "70", "70"],
        "nb_bl": [1, 2, 3, None], "nb_nul": [1, 1, 1, 1],
        "DUPONT": [40, 41, 42, 43], "Martin": ["30", "29", "28", "27"],
        "comment": ["a", "b", "c", "d"],
        "geo_shape": ["p", "q", "r", "s"],
    }).to_parquet(os.path.join(d, "elections-presidentielles-2017-1ertour.parquet"))
    # alternative names; old and new name of one pair both present
    pd.DataFrame({
        "id_bv": ["2-1", "2-2"], "type_election": ["réguinales", "Autre"],
        "numero_tour": [2, 2], "annee": [2021, 2021], "arr_bv": [2, 2],
        "num_bureau": [1, 2], "nb_inscrit": [50, 60], "nb_votant": [40, 50],
        "nb_exprime": [30, 40], "nb_exprim": [30, 40], "A": [10, 20], "B": [20, 20],
    }).to_parquet(os.path.join(d, "elections-regionales-2021-2emetour.parquet"))
    # long family
    pd.DataFrame({
        "source_bv_id": ["75056_0112", "75056_0112", "75056_0113", "bad", None],
        "scrutin": ["Municipales"] * 5, "annee": [2020] * 5, "tour": [1] * 5,
        "candidate": ["Liste A", "Liste B", "Liste A", "Liste A", "Liste B"],
        "votes": [60, 40, 10, 5, 1],
        "vote_share_exprimes": [None, 0.4, float("inf"), 1.0, 1.0],
        "vote_share_registered": [0.3, 0.2, 0.05, 0.5, 0.5],
    }).to_parquet(os.path.join(d, "elections-municipales-2020-1ertour.parquet"))
    # a file missing required columns
    pd.DataFrame({"x": [1], "y": [2]}).to_parquet(os.path.join(d, "junk.parquet"))
    return d


def test_routing_and_provenance(spark, raw_dir):
    paths = I.list_sources(spark, raw_dir)
    routes = {s.name: s.shape for s in I.route_sources(spark, paths)}
    assert routes["elections-municipales-2020-1ertour.parquet"] == "long"
    assert routes["junk.parquet"] == "wide"
    df = I.read_with_provenance(spark, paths[0]).select("source_file", "dataset_id",
                                                        "raw_row_id").collect()
    assert [r.raw_row_id for r in df] == list(range(len(df)))
    assert df[0].dataset_id + ".parquet" == df[0].source_file


def test_aliases_drop_shadowed(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "nb_exprime int, nb_exprim int, nb_vote_blanc int, nb_blanc int")
    out = I.apply_aliases(df)
    assert out.columns == ["nb_exprim", "nb_bl"]


def test_clean_folder(spark, raw_dir):
    long, report = I.clean_folder(spark, raw_dir)
    rep = {r.file: r for r in report.collect()}
    wide = rep["elections-presidentielles-2017-1ertour.parquet"]
    assert wide.status == "ok" and wide.rows_raw == 4
    assert wide.rows_after_key_filter == 2 and wide.rows_dropped_missing_keys == 2
    # DUPONT and Martin are candidates; the text and geo columns are not
    assert wide.candidate_column_names == "dupont | martin"
    assert rep["junk.parquet"].status == "skipped"
    reg = rep["elections-regionales-2021-2emetour.parquet"]
    assert reg.candidate_column_names == "a | b"          # nb_exprime dropped, not a candidate
    muni = rep["elections-municipales-2020-1ertour.parquet"]
    assert muni.rows_after_key_filter == 4 and muni.rows_clean_long == 4
    rows = long.collect()
    pres = [r for r in rows if r.dataset_id.startswith("elections-presidentielles")]
    assert {r.scrutin for r in pres} == {"Présidentielle", "x"}
    assert {r.annee for r in pres} == {2017}
    m = {(r.id_bvote, r.candidate): r for r in rows if r.dataset_id.endswith("2021-2emetour")}
    assert m[("2-1", "a")].vote_share_exprimes == pytest.approx(10 / 30)
    assert {r.scrutin for r in m.values()} == {"Régionales", "Autre"}
    mu = {(r.id_bvote, r.candidate): r for r in rows if "municipales" in r.dataset_id}
    a = mu[("75056_0112", "Liste A")]
    assert a.num_arrond == "01" and a.num_bureau == "12"
    assert a.nb_exprim == 100.0                    # rebuilt from the votes
    assert a.nb_inscr == 200.0                     # median(60/.3, 40/.2) = 200
    assert a.vote_share_exprimes == pytest.approx(0.6)       # source null -> computed
    b = mu[("75056_0113", "Liste A")]
    assert b.vote_share_exprimes == pytest.approx(1.0)       # source inf -> computed 10/10


def test_same_schema_files_one_scan(spark):
    d = tempfile.mkdtemp(prefix="tallyspark-same-")
    for i, n in ((1, 3), (2, 2)):
        pd.DataFrame({"id_bvote": [f"{i}-{k}" for k in range(n)], "scrutin": ["x"] * n,
                      "annee": ["2019"] * n, "tour": ["1"] * n, "num_arrond": ["1"] * n,
                      "num_bureau": [str(k) for k in range(n)], "nb_inscr": [9.0] * n,
                      "nb_votant": [8.0] * n, "nb_exprim": [7.0] * n, "A": [3.0] * n,
                      "B": [4.0] * n}).to_parquet(os.path.join(d, f"elections-europeennes-201{i}.parquet"))
    long, report = I.clean_folder(spark, d)
    rep = {r.file: (r.rows_raw, r.rows_clean_long) for r in report.collect()}
    assert rep == {"elections-europeennes-2011.parquet": (3, 6),
                   "elections-europeennes-2012.parquet": (2, 4)}
    ids = sorted((r.dataset_id, r.raw_row_id) for r in
                 long.select("dataset_id", "raw_row_id").distinct().collect())
    assert ids == [("elections-europeennes-2011", 0), ("elections-europeennes-2011", 1),
                   ("elections-europeennes-2011", 2), ("elections-europeennes-2012", 0),
                   ("elections-europeennes-2012", 1)]


def _wide_file(folder, name, n, **extra):
    os.makedirs(folder, exist_ok=True)
    pd.DataFrame({"id_bvote": [f"1-{k}" for k in range(n)], "scrutin": ["x"] * n,
                  "annee": ["2019"] * n, "tour": ["1"] * n, "num_arrond": ["1"] * n,
                  "num_bureau": [str(k) for k in range(n)], "nb_inscr": [9.0] * n,
                  "nb_votant": [8.0] * n, "nb_exprim": [7.0] * n, "A": [3.0] * n,
                  "B": [4.0] * n, **{k: [v] * n for k, v in extra.items()}}
                 ).to_parquet(os.path.join(folder, name))


def test_files_are_told_by_path_and_routed_by_columns(spark):
    d = tempfile.mkdtemp(prefix="tallyspark-paths-")
    name = "elections-municipales-2020-1ertour.parquet"   # long family by name, wide by columns
    _wide_file(os.path.join(d, "a"), name, 3)
    _wide_file(os.path.join(d, "b"), name, 2)
    _wide_file(d, "own.parquet", 2, dataset_id="theirs", raw_row_id=5)
    long, report = I.clean_folder(spark, d)
    rows = sorted((r.file, r.status, r.rows_raw, r.rows_clean_long) for r in report.collect())
    assert rows == [(name, "ok", 2, 4), (name, "ok", 3, 6), ("own.parquet", "ok", 2, 4)]
    keys = long.select("source_path", "raw_row_id", "candidate")
    assert keys.distinct().count() == long.count() == 14
    assert {r.dataset_id for r in long.select("dataset_id").collect()} \
        == {"own", name.removesuffix(".parquet")}


def test_empty_folder_is_an_error(spark):
    with pytest.raises(FileNotFoundError):
        I.clean_folder(spark, tempfile.mkdtemp(prefix="tallyspark-empty-"))


def test_exact_median_half_even(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 9.0),
                                ("b", 2.0), ("b", 3.0), ("c", None)], "k string, v double")
    med = {r.k: r.m for r in TT.exact_median(df, ["k"], "v", "m").collect()}
    assert med == {"a": 3.0, "b": 2.5}
    df2 = spark.createDataFrame([("b", 2.0, 1.0), ("b", 3.0, 1.0)], "k string, votes double, s double")
    out = TT.reconstruct_registered(df2, ["k"], share="s").collect()
    assert {r.nb_inscr for r in out} == {2.0}      # 2.5 rounds half to even


def test_backcalc_totals(spark):
    df = spark.createDataFrame([("x", "e", 10.0, 50.0, 10.0), ("x", "e", 20.0, 40.0, 20.0),
                                (None, "e", 1.0, 1.0, 1.0)],
                               "s string, e string, voix double, rx double, ri double")
    out = TT.backcalc_totals(df, ["s", "e"], "voix", {"nb_exprim": "rx", "nb_inscr": "ri"})
    rows = out.collect()
    assert len(rows) == 1 and rows[0].nb_exprim == 35 and rows[0].nb_inscr == 100


def test_pivot_name_collision(spark):
    df = spark.createDataFrame([("s1", "Dupont", 0.5), ("s1", "DUPONT", 0.25),
                                ("s2", "M. X", 1.0), ("s1", "Dupont", 0.1)],
                               "id string, candidate string, v double")
    wide = R.pivot_sum(df, ["id"], "candidate", "v")
    assert sorted(wide.columns) == sorted(["id", "DUPONT", "Dupont", "M. X"])
    rows = {r[0]: r for r in wide.collect()}
    assert rows["s2"][1:] == (0.0, 0.0, 1.0)
    assert rows["s1"][1:] == (0.25, pytest.approx(0.6), 0.0)


def test_unpivot_mixed_types(spark):
    df = spark.createDataFrame([("a", 1, "2", 3.5), ("b", None, "x", 1.0)],
                               "id string, p int, q string, r double")
    long = R.unpivot_votes(df, ["id"], ["p", "q", "r"])
    got = sorted((r.id, r.candidate_source_column, r.votes) for r in long.collect())
    assert got == [("a", "p", 1.0), ("a", "q", 2.0), ("a", "r", 3.5),
                   ("b", "p", 0.0), ("b", "q", 0.0), ("b", "r", 1.0)]


def test_unpivot_lanes(spark):
    """Numbers are widened, not printed; bad cells are 0; names with dots."""
    df = spark.createDataFrame(
        [("a", 0.1, "1e3", float("nan"), 7), ("b", 16777216.0, " 2 ", float("inf"), None)],
        "id string, `f.32` float, t string, d double, n int")
    long = R.unpivot_votes(df, ["id"], ["f.32", "t", "d", "n"])
    got = {(r.id, r.candidate_source_column): r.votes for r in long.collect()}
    single = 0.10000000149011612  # the nearest 32-bit number to 0.1
    assert got == {("a", "f.32"): single, ("a", "t"): 1000.0, ("a", "d"): 0.0, ("a", "n"): 7.0,
                   ("b", "f.32"): 16777216.0, ("b", "t"): 2.0, ("b", "d"): float("inf"),
                   ("b", "n"): 0.0}
    numbers = {(r.id, r.candidate_source_column): r.votes for r in
               R.unpivot_numbers(df, ["id"], ["f.32", "d"]).collect()}
    assert numbers[("a", "d")] is None and numbers[("a", "f.32")] == single
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(f.32" in plan and "as string" not in plan.split("Expand")[-1]


def test_detect_in_one_pass(spark):
    """No unpivot of the cells: one aggregate, whatever the number of columns."""
    df = spark.createDataFrame([("f", 1, "x", 0.5), ("g", None, "3", float("nan")),
                                ("g", 4, "5", 1.0)], "g string, p int, q string, r double")
    found = R.detect_value_columns(df, ["g"], [])
    got = {(r.g, r.column): (r.numeric_ratio, r.is_value_column) for r in found.collect()}
    assert got == {("f", "p"): (1.0, True), ("f", "q"): (0.0, False), ("f", "r"): (1.0, True),
                   ("g", "p"): (0.5, False), ("g", "q"): (1.0, True), ("g", "r"): (0.5, False)}
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert R.detect_value_columns(df.where("p > 9"), ["g"], []).count() == 0


def test_detect_80_percent_rule(spark):
    rows = [("f", str(i) if i < 4 else "x", str(i) if i < 3 else "y") for i in range(5)]
    df = spark.createDataFrame(rows, "g string, four string, three string")
    det = {r.column: r.is_value_column for r in
           R.detect_value_columns(df, ["g"], []).collect()}
    assert det == {"four": True, "three": False}


def test_id_grid_size(spark):
    grid = C.id_grid(spark)
    assert grid.count() == 234
    ids = {r.dataset_id for r in grid.collect()}
    assert "elections-europeennes-2019" in ids
    assert "elections-legislatives-2024-2emetour" in ids
    present = spark.createDataFrame([("elections-europeennes-2019",)], "dataset_id string")
    assert C.gaps(grid, present).count() == 233


def test_export_by_key_roundtrip(spark):
    df = spark.createDataFrame([("a b", 1.0), (None, 2.0), ("a b", 3.0)],
                               "dataset_id string, v double")
    path = K.scratch_path(spark, "test-export")
    K.export_by_key(df, "dataset_id", path, fmt="csv")
    keys = sorted(os.listdir(path.replace("file:", "")))
    assert "dataset_key=a_b" in keys and "dataset_key=unknown" in keys
    back = spark.read.option("header", True).option("basePath", path).csv(path)
    assert back.where(F.col("dataset_key") == "a_b").count() == 2


def test_exact_median_bracketed_large_group(spark):
    """A group far larger than the sketch accuracy: the bracket path must give
    numpy's exact median; a tiny accuracy forces the whole-range fallback."""
    import numpy as np
    rng = np.random.default_rng(7)
    vals = np.round(rng.normal(100, 30, 20001), 3)
    rows = [("hot", float(x)) for x in vals] + [("small", 1.0), ("small", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for acc in (100, 10000, 1):
        med = {r.k: r.m for r in TT.exact_median(df, ["k"], "v", "m", accuracy=acc).collect()}
        assert med["hot"] == float(np.median(vals))
        assert med["small"] == 2.5


def test_export_tables_skips_absent(spark):
    root = K.scratch_path(spark, "test-tables")
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    done = K.export_tables({"long": a, "wide": None}, root)
    assert set(done) == {"long"}
    back = spark.read.option("header", True).csv(done["long"])
    assert [tuple(r) for r in back.collect()] == [("1", "x")]


def test_materialized_long_rows_are_parsed_once(spark, monkeypatch):
    """The counts and the medians of the totals read the parsed rows, not the source."""
    seen = []
    whole = I.TT.rebuild_station_totals
    monkeypatch.setattr(I.TT, "rebuild_station_totals",
                        lambda df, keys: seen.append(df) or whole(df, keys))
    rows = [("d", "d.parquet", i, "s", "2001", "1", f"75056_000{i % 3}" if i % 4 else " nan ", "A", str(i), 0.5)
            for i in range(12)]
    df = spark.createDataFrame(rows, "dataset_id string, source_file string, raw_row_id long, scrutin string, annee string, "
                                     "tour string, source_bv_id string, candidate string, votes string, vote_share_registered double")
    got = [I.clean_long(df, materialize=m) for m in (False, True)]
    (a, ra), (b, rb) = got
    assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert list(map(str, ra.select(*rb.columns).collect())) == list(map(str, rb.collect()))
    assert ra.first().rows_raw == 12 and ra.first().rows_dropped_missing_keys == 3
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in seen]
    assert "regexp_extract" in plans[0] and "regexp_extract" not in plans[1]
