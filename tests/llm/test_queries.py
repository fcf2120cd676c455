"""The registered queries on the smallest tables, and the pipeline."""

import hashlib
import os
import zlib

import duckdb
import helpers as H
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from tallyspark.llm import byte_bpe, quality
from tallyspark.llm.queries import QUERIES
from tallyspark.llm.staging import new_folder
from tools.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def documents(con):
    return con.sql("SELECT doc_id, text FROM documents").fetchall()


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join",
                                                      "pii", "packing"]


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_sql(spark, con, name):
    frame = QUERIES[name][0](spark, SF)
    columns = sorted(frame.columns)
    con.sql(QUERIES[name][1]).create_view(f"view_{name}")
    want = con.sql(f"SELECT {', '.join(columns)} FROM view_{name}").fetchall()
    got = [tuple(r[c] for c in columns) for r in frame.collect()]
    assert digest(got)[0] == digest(want)[0]


def test_quality_query(spark, con):
    rows = {r.doc_id: r for r in QUERIES["op2_quality_rules"][0](spark, SF).collect()}
    for key, text in documents(con):
        r = rows[key]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) \
            == H.quality(text)
        assert not (r.kept and r.base_failed)


def exact_fences(scales, groups):
    """group -> (low, high) per measure: exact quartiles, blended by numbers of rows."""
    def quartiles(keys):
        at = np.sort([scales[k] for k in keys], axis=0)
        return np.array([at[int(np.ceil(q * len(at))) - 1] for q in (0.25, 0.75)])

    def blend(keys, above):
        n, prior = len(keys), quality.PRIOR_ROWS
        return (n * quartiles(keys) + prior * above) / (n + prior)
    langs = {}
    for (lang, _), keys in groups.items():
        langs.setdefault(lang, []).extend(keys)
    whole = quartiles(list(scales))
    reach = np.array([3.0, 4.0, 5.0, 4.0])
    out = {}
    for group, keys in groups.items():
        low, high = blend(keys, blend(langs[group[0]], whole))
        spread = reach * np.maximum(high - low, [0.5, 0.5, 0.5, 0.05])
        out[group] = np.array([-np.inf] * 3 + [low[3] - spread[3]]), high + spread
    return out


def test_quality_fences_by_exact_quantiles(spark, con):
    """A sketch of so few rows is exact."""
    odds = lambda k, n: np.log((k + 0.5) / (n - k + 0.5))
    scales, groups, of, rows = {}, {}, {}, con.sql(
        "SELECT doc_id, text, lang, source FROM documents").fetchall()
    for key, text, lang, source in rows:
        n, chars, symbols, lines, again = H.quality(text)
        spoken = sum(bool(H.WORD.search(x)) for x in (text or "").split("\n"))
        if n >= quality.MIN_WORDS and 2 * again <= n:
            scales[key] = [odds(symbols, chars), odds(lines, spoken), odds(again, n),
                           np.log(chars / n)]
            groups.setdefault((lang, source), []).append(key)
            of[key] = lang, source
    fences = exact_fences(scales, groups)
    assert len({tuple(np.round(high, 6)) for _, high in fences.values()}) > len(fences) / 2 > 1
    want = {key: key in scales and bool(((np.array(scales[key]) <= fences[of[key]][1])
                                         & (np.array(scales[key]) >= fences[of[key]][0])).all())
            for key, *_ in rows}
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    got = quality.quality_verdicts(frame, ["doc_id"]).collect()
    assert {r.doc_id: r.kept for r in got} == want
    assert all(r.kept == (not r.base_failed and not r.beyond) for r in got)
    query = QUERIES["op2_quality_rules"][0](spark, SF).collect()
    assert {r.doc_id: r.kept for r in query} == want


def test_ngram_query(spark, con):
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in QUERIES["op6_ngram_join"][0](spark, SF).collect()}
    assert got == H.components(documents(con), 3, 90)


def test_pii_query(spark, con):
    """All spans of the table, base kinds and terms."""
    rows = documents(con)
    got = {r.doc_id: r.spans for r in QUERIES["op7_pii"][0](spark, SF).collect()}
    told = H.pii_terms([t for _, t in rows])
    for key, text in rows:
        want = H.pii(text) + [f"term:{a}:{b}" for a, b, _ in told[text or ""]]
        assert got[key] == ",".join(want)


@pytest.mark.parametrize("name", ["op1_hnsw", "op3_toxicity", "op4_token_counts", "op5_byte_bpe",
                                  "op10_packing"])
def test_runs_whole(spark, con, name):
    table = "embeddings" if name == "op1_hnsw" else "documents"
    frame = QUERIES[name][0](spark, SF)
    rows = frame.collect()
    if name == "op10_packing":
        assert {r.doc_id for r in rows} == {k for k, _ in documents(con)}
    elif name == "op1_hnsw":
        queries = con.sql("SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0").fetchall()[0][0]
        assert len(rows) == 10 * queries
    else:
        assert len(rows) == con.sql(f"SELECT count(*) FROM {table}").fetchall()[0][0]
    if name == "op3_toxicity":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_nearest_values(spark, con):
    """Scores and ranks of every row against the dense distance table."""
    table = con.sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids = [k for k, _ in table]
    vectors = np.array([v for _, v in table], float)
    got = {}
    for r in QUERIES["op1_hnsw"][0](spark, SF).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    found = 0
    for query, ranked in got.items():
        far = np.sqrt(((vectors - vectors[ids.index(query)]) ** 2).sum(axis=1))
        assert sorted(ranked) == list(range(1, 11))
        listed = [ranked[i] for i in range(1, 11)]
        assert np.allclose([s for _, s in listed], [far[ids.index(k)] for k, _ in listed])
        assert listed == sorted(listed, key=lambda x: (x[1], x[0]))
        others = np.array([f for k, f in zip(ids, far) if k != query])
        found += sum(s <= np.sort(others)[9] + 1e-9 for _, s in listed)
    assert set(got) == {k for k in ids if k % 100 == 0} and found >= 9.5 * len(got)


def test_token_count_values(spark, con):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for key, text in documents(con):
        n = len(tokenizer.encode(text or "", add_special_tokens=False))
        want.append((key, len((text or "").encode()), n, n > 512))
    assert sorted(map(tuple, QUERIES["op4_token_counts"][0](spark, SF).collect())) == sorted(want)


def test_byte_bpe_values(spark, con):
    own = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    want = []
    for key, text in documents(con):
        ids = own.encode_ordinary(text or "")
        want.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, QUERIES["op5_byte_bpe"][0](spark, SF).collect())) == sorted(want)


def test_packing_values(spark, con):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
           for k, t in documents(con)}
    rows = QUERIES["op10_packing"][0](spark, SF).collect()
    spans = {}
    for r in rows:
        piece = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert r.doc_tokens == len(ids[r.doc_id])
        assert len(piece) == r.length and r.ids_crc32 == zlib.crc32(piece.tobytes())
        assert 0 <= r.offset and r.offset + r.length <= 4096
        spans.setdefault(r.doc_id, []).append((r.start, r.length))
    for key, pieces in spans.items():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [a for a, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] == len(ids[key])
    assert set(spans) == set(ids)


def test_pipeline_against_brute_force(spark, con):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = {r.doc_id: r for r in docs.collect()}
    verdicts = {r.doc_id: r.kept for r in quality.quality_verdicts(docs, ["doc_id"]).collect()}
    good = [(k, r.text) for k, r in source.items() if verdicts[k]]
    lines = H.keep_lines(good)
    left = [(k, lines[k, t][2]) for k, t in good if lines[k, t][2].strip(" \t\n\x0b\x0c\r")]
    first = H.components(left, 5, 80)
    stay = {k: t for k, t in left if first[k][1] == k}
    frames, frame = [], docs
    for name, function in corpus_pipeline.STAGES[:4]:
        path = new_folder(spark, "test-stage")
        function(spark, frame, SF).write.parquet(path)
        frame = spark.read.parquet(path)
        frames.append({r.doc_id: r.text for r in frame.collect()})
        assert frame.columns == docs.columns
    assert frames[0] == dict(good) and frames[1] == dict(left) and frames[2] == stay
    assert set(frames[3]) == set(stay)
    assert all(frames[3][k] == t or H.pii(t) for k, t in stay.items())
    pieces = corpus_pipeline.STAGES[4][1](spark, frame, SF).collect()
    assert {r.doc_id for r in pieces} == set(stay)
    ends = sorted((r.sequence_id * 4096 + r.offset, r.length) for r in pieces)
    assert [a for a, _ in ends] == np.cumsum([0] + [n for _, n in ends])[:-1].tolist()
