"""Resolution of not-modified (304) revisit records of a web archive.

A revisit stands for the latest full response of the same canonical URL that was
captured before it.  That is an as-of join: records are cut into time slices per
URL, the latest response inside a slice comes from a running window, the latest
of all earlier slices from a window over one summary row per slice, so a URL that
holds a third of the archive is worked on by as many tasks as it has slices.
A resolved revisit takes the response's payload digest and headers, updated by
those header fields of its own that a 304 may carry.

Validators decide whether the response found is the one meant: entity tags are
compared weakly if both records have one, else the times of last modification;
without either there is no proof and the revisit stays unresolved.

Contract: a null URL or time never resolves; only strictly earlier responses
count, and of several at one time the largest record id; repeated rows give
repeated results; null headers are empty; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 response may update.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified",
             "vary"]
#: Query parameters that only say where a visitor came from.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
#: Seconds of a time slice.
SLICE = 86_400


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default ports, path, sorted query; no
    scheme, fragment, tracking parameters or closing slash.  Blanks and angle brackets
    around a URL go; one without scheme://host is its own name, without fragment."""
    url = F.regexp_replace(F.trim(url), "^<(.*)>$", "$1")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    opaque = F.regexp_replace(url, "(?s)(?<=.)#.*$", "")
    named = host != ""
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(
        F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.sort_array(F.filter(
        F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(named, F.concat(
        host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))).otherwise(opaque)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, slice_seconds: int = SLICE) -> DataFrame:
    """(record_id, canonical_url, ts, outcome, refers_to, digest, headers) of all records.

    ``records``: record_id long, url, ts (seconds), kind ('response' or 'revisit'),
    etag, last_modified, digest, headers map<string,string>.
    outcome: response, resolved, validator_mismatch, no_validator, no_earlier_response.
    """
    empty = F.create_map().cast("map<string,string>")
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind", "etag",
        "last_modified", "digest", F.coalesce("headers", empty).alias("headers"),
        F.expr(f"ts div {slice_seconds}").alias("slice"))
    full = F.when((F.col("kind") == "response") & F.col("ts").isNotNull()
                  & F.col("canonical_url").isNotNull(),
                  F.struct("record_id", "ts", "etag", "last_modified", "digest", "headers"))
    # Within one second revisits come first, so they see earlier responses only.
    order = [F.col("ts"), F.col("kind") == "response", F.col("record_id")]
    inside = (Window.partitionBy("canonical_url", "slice").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("full", full).withColumn(
        "near", F.last("full", ignorenulls=True).over(inside))
    slices = (rows.where(F.col("full").isNotNull()).groupBy("canonical_url", "slice")
              .agg(F.max_by("full", F.struct("ts", "record_id")).alias("last")))
    # Every slice that has records, so that each one finds what lies before it.
    known = (rows.where(F.col("canonical_url").isNotNull() & F.col("slice").isNotNull())
             .select("canonical_url", "slice").distinct()
             .join(slices, ["canonical_url", "slice"], "left"))
    before = (Window.partitionBy("canonical_url").orderBy("slice")
              .rowsBetween(Window.unboundedPreceding, -1))
    known = known.select("canonical_url", "slice",
                         F.last("last", ignorenulls=True).over(before).alias("earlier"))
    found = (rows.join(known, ["canonical_url", "slice"], "left")
             .withColumn("of", F.when(F.col("ts").isNotNull() & F.col("canonical_url").isNotNull(),
                                      F.coalesce("near", "earlier"))))
    both = lambda c: F.col(c).isNotNull() & F.col(f"of.{c}").isNotNull()
    outcome = (F.when(F.col("kind") == "response", "response")
               .when(F.col("of").isNull(), "no_earlier_response")
               .when(both("etag"), F.when(_weak(F.col("etag")) == _weak(F.col("of.etag")),
                                          "resolved").otherwise("validator_mismatch"))
               .when(both("last_modified"),
                     F.when(F.col("last_modified") == F.col("of.last_modified"), "resolved")
                     .otherwise("validator_mismatch"))
               .otherwise("no_validator"))
    found = found.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    own = F.map_filter("headers", lambda k, v: F.lower(k).isin(PERMITTED))
    kept = F.map_filter("of.headers", lambda k, v: ~F.coalesce(F.exists(
        F.map_keys(own), lambda o: F.lower(o) == F.lower(k)), F.lit(False)))
    return found.select(
        "record_id", "canonical_url", "ts", "outcome",
        F.when(resolved, F.col("of.record_id")).alias("refers_to"),
        F.when(resolved, F.col("of.digest")).otherwise(F.col("digest")).alias("digest"),
        F.when(resolved, F.map_concat(kept, own)).otherwise(F.col("headers")).alias("headers"))
