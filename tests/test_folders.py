"""Folder audit and national extract on small hand-made files."""

import os

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import audit as AU
from tallyspark.operators.reconcile import CASE_KEYS
from tallyspark.sources import extract as EX
from tallyspark.sources import ingest as I
from tallyspark.sources import sinks as K

WIDE = ("id_bvote string, scrutin string, annee string, tour string, num_arrond string, "
        "num_bureau string, nb_inscr string, nb_votant string, nb_exprim string, ")


def station(key, exprim, *votes):
    return (key, "s", "2001", "1", "1", key, "9", "9", exprim, *votes)


@pytest.fixture
def folder(spark, tmp_path):
    """Wide files of two schemas, a long one, one without the columns, one unreadable."""
    root = tmp_path / "raw"

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "w" / name))
        part = next((tmp_path / "w" / name).glob("part-*.parquet"))
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(part.read_bytes())

    write("a.parquet", [station("1", "3", "1", 2.0, "x"), station(" nan ", "3", "1", 2.0, "x"),
                        station("2", "bad", "5", 5.0, "x"), station("3", "4", None, 4.0, "y")],
          WIDE + "ada string, bob double, note string")
    write("b.parquet", [station("1", "3", 7)], WIDE + "cy int")
    write("sub/b.parquet", [station("4", "3", 8)], WIDE + "cy int")
    write("long.parquet", [("x_1", "s", "2001", "1", "Eve", "4"), ("x_2", "s", "2001", "1", None, "4"),
                           (" NONE ", "s", "2001", "1", "Eve", "4"), ("x_3", "s", "2001", "1", "Flo", "n/a"),
                           ("x_4", "s", "2001", "1", "Flo", "0")],
          "source_bv_id string, scrutin string, annee string, tour string, candidate string, votes string")
    write("other.parquet", [("1", 2)], "id_bvote string, n int")
    (root / "broken.parquet").write_bytes(b"no parquet")
    return str(root)


EXPECTED = {("a", 0, "ada", 1.0), ("a", 0, "bob", 2.0), ("a", 3, "ada", 0.0), ("a", 3, "bob", 4.0),
            ("b", 0, "cy", 7.0), ("b", 0, "cy", 8.0), ("long", 0, "Eve", 4.0), ("long", 4, "Flo", 0.0)}


def frame(spark, rows):
    rows = [(d, d and f"{d}.parquet", r, c, v) for d, r, c, v in rows]
    return spark.createDataFrame(rows, "dataset_id string, source_file string, raw_row_id long, "
                                       "candidate_source_column string, votes double")


def checks(audit):
    return {r.check: (int(r.value), r.status) for r in audit.summary.collect()}


def problems(audit):
    return sorted((r.problem_type, r.dataset_id or "", r.raw_row_id, r.candidate_source_column or "")
                  for r in audit.problems.collect())


def test_expected_cases(spark, folder):
    # "ada" holds numbers in half of its rows, which is too few
    rows = AU.expected_cases(spark, I.list_sources(spark, folder)).collect()
    got = {(r.dataset_id, r.raw_row_id, r.candidate_source_column, r.expected_votes) for r in rows}
    assert got == {x for x in EXPECTED if x[2] != "ada"} and len(rows) == len(got)


def test_audit_without_faults(spark, folder):
    clean = frame(spark, [x for x in EXPECTED if x[2] != "ada"])
    audit = AU.audit_folder(spark, folder, clean)
    got = checks(audit)
    # two files called b.parquet repeat a key, on both sides
    assert got == {
        "raw_files_used_for_expected_cases": (4, "OK"),
        "raw_files_skipped_for_expected_cases": (2, "CHECK"),
        "expected_raw_candidate_cases": (6, "INFO"), "clean_long_cases": (6, "INFO"),
        "missing_from_clean": (0, "OK"), "extra_in_clean": (0, "OK"),
        "vote_value_mismatches": (1, "PROBLEM"), "duplicate_clean_cases": (1, "PROBLEM"),
        "duplicate_expected_cases": (1, "PROBLEM")}
    # buckets with equal sums never reach the join
    assert {r.dataset_id for r in audit.cases.collect()} == {"b"}
    assert sum(r.expected_rows for r in audit.files.collect()) == 6


@pytest.mark.parametrize("buckets", [1, 4096])
def test_audit_finds_every_class(spark, folder, buckets):
    clean = frame(spark, [("a", 0, "bob", 2.0 + 1e-7), ("a", 3, "bob", 5.0), ("a", 9, "bob", 1.0),
                          ("b", 0, "cy", 7.0), ("long", 0, "Eve", 4.0), ("long", 0, "Eve", 4.0),
                          (None, 1, None, 2.0)])
    audit = AU.audit_folder(spark, folder, clean, buckets=buckets)
    assert problems(audit) == sorted([
        ("vote_value_mismatch", "a", 3, "bob"), ("extra_in_clean", "a", 9, "bob"),
        ("missing_from_clean", "long", 4, "Flo"), ("duplicate_clean_case", "long", 0, "Eve"),
        ("duplicate_expected_case", "b", 0, "cy"), ("vote_value_mismatch", "b", 0, "cy"),
        ("extra_in_clean", "", 1, "")])
    got = checks(audit)
    assert got["missing_from_clean"] == (1, "PROBLEM") and got["extra_in_clean"] == (2, "PROBLEM")
    assert got["clean_long_cases"] == (7, "INFO") and got["duplicate_clean_cases"] == (1, "PROBLEM")


def test_audit_of_the_cleaner(spark, folder):
    """What the cleaner makes of the folder has no fault but the shared name."""
    clean, _ = I.clean_folder(spark, folder)
    got = checks(AU.audit_folder(spark, folder, clean))
    assert got["missing_from_clean"][0] == got["extra_in_clean"][0] == 0


def test_audit_shuffles_cases_once(spark, folder):
    """Where all buckets differ, all cases are joined: they are dealt out once, and only
    problem rows are written."""
    clean = frame(spark, [(*x[:3], x[3] + 1) for x in EXPECTED if x[2] != "ada"] + [("a", 9, "bob", 1.0)] * 2)
    audit = AU.audit_folder(spark, folder, clean)
    plan = audit.cases._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(dataset_id" in x]
    assert len(dealt) == 1 and "SortMergeJoin" not in plan
    rows = audit.cases.collect()
    assert len([r for r in rows if r.problem_type == "vote_value_mismatch"]) == 5
    # more buckets than are broadcast: the same cases
    few = AU.BROADCAST_BUCKETS
    AU.BROADCAST_BUCKETS = 0
    try:
        other = AU.audit_folder(spark, folder, clean)
    finally:
        AU.BROADCAST_BUCKETS = few
    assert sorted(map(str, other.cases.collect())) == sorted(map(str, rows))
    assert checks(other) == checks(audit) and problems(other) == problems(audit)


def test_staged_rows_leave_no_shuffles_behind(spark, monkeypatch):
    """Shuffle files go as a write ends, checked rows once the clean ones are written."""
    seen, write = [], K.write_parquet

    def put(df, path, *a, **b):
        seen.append((path, spark.conf.get(K._SHUFFLE_CLEANUP)))
        return write(df, path, *a, **b)

    monkeypatch.setattr(K, "write_parquet", put)
    rows = [("d", "d.parquet", i, "s", "2001", "1", f"75056_000{i}", "A", "3") for i in range(4)]
    df = spark.createDataFrame(rows, "dataset_id string, source_file string, raw_row_id long, scrutin string, "
                                     "annee string, tour string, source_bv_id string, candidate string, votes string")
    out, report = I.clean_long(df, materialize=True)
    assert out.count() == 4 and report.first().rows_raw == 4
    assert [on for _, on in seen] == ["true", "true"] and spark.conf.get(K._SHUFFLE_CLEANUP) == "false"
    checked, clean = (p.removeprefix("file:") for p, _ in seen)
    assert not os.path.exists(checked) and os.path.exists(clean)


def test_parted_source_is_named_once(spark, tmp_path):
    """A source's id is made once a file, not once a row."""
    df = spark.createDataFrame([(f"{k}.x.parquet", i) for i in range(6) for k in "ab"], "file string, i long")
    files = K.write_named_files(df, "file", ["i"], str(tmp_path), lambda d: d.withColumn("j", F.col("i") * 2))
    got = I.read_with_provenance(spark, files)
    assert sorted((r.dataset_id, r.raw_row_id, r.j) for r in got.collect()) == [
        (f"{k}.x", i, 2 * i) for k in "ab" for i in range(6)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join ") < plan.index("regexp_replace")


def test_audit_refuses(spark, folder, tmp_path):
    with pytest.raises(ValueError, match="raw_row_id"):
        AU.audit_folder(spark, folder, frame(spark, []).drop("raw_row_id"))
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        AU.audit_folder(spark, str(tmp_path / "none"), frame(spark, []))
    empty = checks(AU.audit_folder(spark, folder, frame(spark, [])))
    assert empty["missing_from_clean"] == (6, "PROBLEM") and empty["clean_long_cases"][0] == 0


def test_checksums_ignore_order_and_see_values(spark):
    rows = [("a", i, "x", float(i)) for i in range(50)]
    sums = [AU.checksums(AU.with_bucket(frame(spark, r), buckets=4), "votes", AU.BUCKET_KEYS)
            .drop("__bucket").collect() for r in (rows, rows[::-1], rows[:-1] + [("a", 49, "x", 0.0)])]
    assert sorted(sums[0]) == sorted(sums[1]) != sorted(sums[2])
    assert set(CASE_KEYS) <= set(frame(spark, []).columns)


NATIONAL = ("id_election string, code_departement string, code_bv string, nom string, prenom string, "
            "voix string, ratio_voix_exprimes double, ratio_voix_inscrits double")


def test_extract(spark, tmp_path):
    e1, e2, e3 = "2020_muni_t1", "2020_muni_t2", "2014_muni_t1"
    rows = [(e1, "75", "101", "Da Silva", " Ana ", "30", 30.0, 20.0),
            (e1, "75", "0101", "DA SILVA", "ana", "1", 0.0, None),     # same station and name
            (e1, "75", "0101", "Roy", None, "70", 70.0, 40.0),
            (e1, "75", "0101", None, " ", "500", 50.0, 50.0),           # counts for totals only
            (e1, "75", "zz", "Roy", "", "9", 9.0, 9.0),                 # no station
            (e1, "13", "0101", "Roy", "", "9", 9.0, 9.0), ("1999_muni_t1", "75", "0101", "Roy", "", "9", 9.0, 9.0),
            (e2, "75", "2003", "Roy", "", "bad", 10.0, 0.0), (None, "75", "0101", "Roy", "", "9", 9.0, 9.0)]
    done = EX.extract_elections(spark.createDataFrame(rows, NATIONAL), str(tmp_path), "75",
                                [e1, e2, e3], "Municipales")
    assert [f.rsplit("/", 1)[-1] for f in done.files] == [
        "elections-municipales-2020-1ertour.parquet", "elections-municipales-2020-2emetour.parquet"]
    assert done.absent == [e3]
    assert done.counts == {"rows": 6, "rows_without_station": 1, "rows_without_name": 1,
                           f"rows_{e1}": 5, f"rows_{e2}": 1, f"rows_{e3}": 0}
    first, second = (spark.read.parquet(f).collect() for f in done.files)
    assert [r.asDict() for r in first] == [{
        "id_bvote": "1-1", "scrutin": "Municipales", "annee": 2020, "tour": 1, "num_arrond": 1,
        "num_bureau": 1, "nb_exprim": 100, "nb_inscr": 175, "nb_votant": None,
        "da_silva_ana": 31.0, "roy": 70.0}]
    assert second[0].id_bvote == "20-3" and second[0].roy == 0.0 and second[0].nb_exprim is None
    # what it writes is a wide file for the cleaner
    long, report = I.clean_folder(spark, str(tmp_path))
    assert long is not None and {r.status for r in report.collect()} <= {"ok", "skipped"}


def test_extract_of_nothing(spark, tmp_path):
    done = EX.extract_elections(spark.createDataFrame([], NATIONAL), str(tmp_path), "75",
                                ["2020_muni_t1"], "Municipales")
    assert done.files == [] and done.absent == ["2020_muni_t1"] and done.counts["rows"] == 0


def test_named_files(spark, tmp_path):
    df = spark.createDataFrame([(f"f {i % 3}=%.parquet", i) for i in range(30, 0, -1)], "file string, i long")
    files = K.write_named_files(df.withColumn("__x", F.lit(1)), "file", ["i"], str(tmp_path))
    assert [f.rsplit("/", 1)[-1] for f in files] == [f"f {k}=%.parquet" for k in range(3)]
    assert [r.i for r in spark.read.parquet(files[1]).collect()] == list(range(1, 31, 3))


def test_named_sources_in_parts(spark, tmp_path):
    """A large source is many tasks' work; its rows are numbered through its parts."""
    rows = [(f"{k}.parquet", i, None if i % 7 else f"{i}") for i in range(400) for k in "ab"] + [(None, 1, "x")]
    df = spark.createDataFrame(rows[::-1], "file string, i long, v string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = K.write_named_files(df, "file", ["i"], str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "out" / "a.parquet").glob("part-*"))) > 1
    assert I.list_sources(spark, str(tmp_path / "out")) == [f"file:{f}" for f in files]
    spark.createDataFrame([(9, "y")], "i long, v string").toPandas().to_parquet(tmp_path / "out" / "c.parquet")
    got = I.read_with_provenance(spark, I.list_sources(spark, str(tmp_path / "out")), "source_path").collect()
    assert sorted((r.dataset_id, r.raw_row_id, r.i) for r in got) == [
        *(("a", i, i) for i in range(400)), *(("b", i, i) for i in range(400)), ("c", 0, 9)]
    assert {(r.source_file, r.source_path.rsplit("/", 1)[-1]) for r in got} == {
        (f"{k}.parquet", f"{k}.parquet") for k in "abc"}
