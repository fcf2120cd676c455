"""National long file -> one wide file per election, as one flow.

The source is read once: the filtered and parsed rows are staged, and what the log of
the run needs (rows found per election, rows left out) is observed in that same pass.
Totals, names and the wide rows come from the staged rows; all files are written by
one job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import fixed
from ..operators import reshape as R
from ..operators import totals as TT
from .sinks import scratch_path, write_named_files, write_parquet

STATION = ("id_election", "id_bvote")
META = ("id_bvote", "scrutin", "annee", "tour", "num_arrond", "num_bureau", "nb_exprim",
        "nb_inscr", "nb_votant")


@dataclass(frozen=True)
class Extract:
    """``files`` written, elections that had no rows, and observed row counts."""

    files: list[str]
    absent: list[str]
    counts: dict[str, int]


def election_file(election: str) -> str:
    """File name of an election id such as ``2020_muni_t1``."""
    year, _, turn = election.split(fixed.ELECTION_ID_SEPARATOR)
    return f"{fixed.LONG_FAMILY_PREFIX}{year}-{fixed.ROUND_LABELS[turn]}.parquet"


def parse_rows(national: DataFrame, region: str, elections: Sequence[str]) -> DataFrame:
    """Rows of the region and elections, with station, election and candidate parsed.
    Both filters and the column list reach the scan."""
    rows = national.where((F.col("code_departement") == region)
                          & F.col("id_election").isin(*elections))
    code, election = X.padded_code("code_bv"), X.split_key("id_election")
    votes = X.to_number("voix", R.is_numeric_type(national.schema["voix"].dataType))
    return rows.select(
        "id_election", code["key"].alias("id_bvote"), election["year"].alias("annee"),
        election["round"].alias("tour"), code["area"].alias("num_arrond"),
        code["unit"].alias("num_bureau"), X.compose_name("nom", "prenom").alias("candidate"),
        votes.alias("votes"), "voix", "ratio_voix_exprimes", "ratio_voix_inscrits")


def wide_rows(parsed: DataFrame, category: str, candidates: Sequence[str] | None = None
              ) -> DataFrame:
    """One row per election and station with a vote column per candidate (absent: 0) and
    both totals back-calculated from the percentages; rows without a station or a
    candidate name are left out, after they have counted for the totals."""
    totals = TT.backcalc_totals(parsed, ["id_bvote", "id_election"], "voix",
                                {"nb_exprim": "ratio_voix_exprimes",
                                 "nb_inscr": "ratio_voix_inscrits"})
    named = parsed.where(F.col("id_bvote").isNotNull() & (X.strip_text("candidate") != ""))
    # The other index columns follow from the two keys: they split no group.
    index = [*STATION, "annee", "tour", "num_arrond", "num_bureau"]
    wide = R.pivot_sum(named.withColumn("votes", F.coalesce("votes", F.lit(0.0))),
                       index, "candidate", "votes", candidates)
    wide = (wide.join(totals, list(STATION), "left")
            .withColumn("scrutin", F.lit(category))
            .withColumn("nb_votant", F.lit(None).cast("bigint")))
    first = ["id_election", *META]
    return wide.select(*first, *[f"`{c}`" for c in wide.columns if c not in first])


def extract_elections(national: DataFrame, root: str, region: str, elections: Sequence[str],
                      category: str, candidates: Sequence[str] | None = None,
                      file_names: Mapping[str, str] | None = None) -> Extract:
    """Write one wide Parquet file per election under ``root``.

    ``candidates`` fixes the candidate columns (default: the names found).  An
    election without rows gets no file and is listed as absent; no rows at all write
    nothing.  The station's turnout is not in such a source: null.
    """
    spark = national.sparkSession
    seen = Observation("extract")
    parsed = parse_rows(national, region, elections)
    staged = write_parquet(parsed.observe(
        seen, F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("id_bvote").isNull()).alias("rows_without_station"),
        F.count_if(X.strip_text("candidate") == "").alias("rows_without_name"),
        *[F.count_if(F.col("id_election") == e).alias(f"rows_{e}") for e in elections]),
        scratch_path(spark, "extract"))
    counts = seen.get
    absent = [e for e in elections if not counts[f"rows_{e}"]]
    files: list[str] = []
    if counts["rows"]:
        rows = spark.read.schema(parsed.schema).parquet(staged)
        names = file_names or {e: election_file(e) for e in elections}
        named = F.create_map(*[x for e in elections for x in (F.lit(e), F.lit(names[e]))])
        wide = wide_rows(rows, category, candidates).withColumn(
            "__name", named[F.col("id_election")]).drop("id_election")
        files = write_named_files(wide, "__name", ["num_arrond", "num_bureau", "id_bvote"], root)
    return Extract(files, absent, counts)
