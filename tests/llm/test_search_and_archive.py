"""HNSW recall and edge cases; revisit resolution."""

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import hnsw, revisits
from tallyspark.llm.staging import stage

TABLE = "vec_id long, embedding array<float>, label int"


def search(table, k=10, shard_points=hnsw.SHARD_POINTS):
    shards = stage(hnsw.index(hnsw.points(table, k), shard_points), "shards")
    queries = (hnsw.usable(table).where("id % 100 = 0")
               .select(F.col("id").alias("query_id"), "vector"))
    out = {}
    for r in sorted(hnsw.search(shards, queries, k).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def exact(ids, vectors, query, k=10):
    away = np.sqrt(((vectors - vectors[list(ids).index(query)]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, away)) if ids[i] != query][:k]
    return [(int(ids[i]), float(away[i])) for i in order]


def test_recall(spark):
    random = np.random.default_rng(4)
    vectors = random.normal(size=(3000, 24)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    got = search(spark.createDataFrame(rows, TABLE), shard_points=700)
    ids, hits = np.arange(3000), 0
    for q, found in got.items():
        want = exact(ids, vectors.astype(float), q)
        hits += len({v for v, _ in found} & {v for v, _ in want})
        true = {v: s for v, s in exact(ids, vectors.astype(float), q, 2999)}
        assert all(s == true[v] for v, s in found)
        assert found == sorted(found, key=lambda x: (x[1], x[0]))
    assert len(got) == 30 and hits >= 0.9 * 300


def test_small_and_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, None, 0),
            (4, [], 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [1.0, None], 0),
            (8, [inf, 1.0], 0), (9, [1.0, 2.0, 3.0], 0), (100, [1.0, 0.0], 0),
            (200, [1.0, 2.0, 4.0], None), (300, [0.0, -0.0], 0), (None, [1.0, 0.0], 0),
            (0, [1.0, 0.0], 0)]
    got = search(spark.createDataFrame(rows, TABLE))
    assert got[0] == [(1, 0.0), (100, 0.0), (2, 2 ** 0.5)]
    assert got[100] == [(0, 0.0), (1, 0.0), (2, 2 ** 0.5)]
    assert got[200] == [(9, 1.0)] and set(got) == {0, 100, 200}
    assert search(spark.createDataFrame(rows[:1], TABLE)) == {}
    assert search(spark.createDataFrame([], TABLE)) == {}


def test_one_very_common_vector(spark):
    random = np.random.default_rng(1)
    rows = [(i, [1.0] * 8, 0) for i in range(400)]
    rows += [(400 + i, random.normal(size=8).tolist(), 0) for i in range(400)]
    got = search(spark.createDataFrame(rows, TABLE), shard_points=128)
    assert got[0] == [(i, 0.0) for i in range(1, 11)]
    assert got[300] == [(i, 0.0) for i in range(10)]


RECORDS = ("record_id long, url string, ts long, kind string, etag string, last_modified string, "
           "digest string, headers map<string,string>, extra int")


def test_revisits(spark):
    day = 86_400
    rows = [
        (1, "http://www.A.org/x/?b=2&a=1&utm_source=q#f", 10, "response", '"1"', "m1", "d1",
         {"Content-Type": "t", "Date": "old"}, 0),
        (2, "https://a.org/x?a=1&b=2", 5 * day, "revisit", 'W/"1"', None, None,
         {"date": "new", "Content-Length": "0"}, 0),
        (3, "https://a.org/x?a=1&b=2", 6 * day, "response", '"2"', "m2", "d2", None, 0),
        (4, "https://a.org:443/x/?a=1&b=2", 6 * day, "revisit", '"2"', None, None, {}, 0),
        (5, "https://a.org/x?a=1&b=2", 6 * day + 1, "revisit", '"2"', None, None, {}, 0),
        (6, "https://a.org/x?a=1&b=2", 9 * day, "revisit", None, "m2", None, None, 0),
        (7, "https://a.org/x?a=1&b=2", 9 * day, "revisit", None, "m1", None, None, 0),
        (8, "https://a.org/x?a=1&b=2", 9 * day, "revisit", None, None, None, None, 0),
        (9, "https://a.org/other", 9 * day, "revisit", '"1"', None, None, None, 0),
        (10, None, 9, "revisit", '"1"', None, None, None, 0),
        (11, "https://a.org/x?a=1&b=2", None, "revisit", '"1"', None, None, None, 0)]
    frame = spark.createDataFrame(rows + [rows[1]], RECORDS)
    result = revisits.resolve_revisits(frame).collect()
    assert len(result) == len(rows) + 1
    got = {r.record_id: (r.outcome, r.refers_to, r.digest) for r in result}
    assert got == {1: ("response", None, "d1"), 2: ("resolved", 1, "d1"),
                   3: ("response", None, "d2"), 4: ("validator_mismatch", None, None),
                   5: ("resolved", 3, "d2"), 6: ("resolved", 3, "d2"),
                   7: ("validator_mismatch", None, None), 8: ("no_validator", None, None),
                   9: ("no_earlier_response", None, None),
                   10: ("no_earlier_response", None, None),
                   11: ("no_earlier_response", None, None)}
    headers = {r.record_id: r.headers for r in result}
    assert headers[2] == {"Content-Type": "t", "date": "new"} and headers[5] == {}
    assert revisits.resolve_revisits(frame.where("ts < 0")).count() == 0


def test_revisits_of_urls_without_host(spark):
    rows = [(1, "dns:a.org", 1, "response", '"1"'), (2, "dns:b.org", 2, "response", '"2"'),
            (3, "dns:a.org", 3, "revisit", '"1"'), (4, "<http://c.org/x>", 1, "response", '"3"'),
            (5, "http://c.org/x#y", 5, "revisit", '"3"'), (6, " d.org/x ", 1, "response", '"4"'),
            (7, "d.org/x#again", 6, "revisit", '"4"'), (8, "e.org/x?q=1", 7, "revisit", '"4"')]
    frame = spark.createDataFrame(
        [(*r, None, None, None) for r in rows],
        "record_id long, url string, ts long, kind string, etag string, last_modified string, "
        "digest string, headers map<string,string>")
    got = {r.record_id: (r.outcome, r.refers_to) for r in
           revisits.resolve_revisits(frame).collect() if r.outcome != "response"}
    assert got == {3: ("resolved", 1), 5: ("resolved", 4), 7: ("resolved", 6),
                   8: ("no_earlier_response", None)}
