"""Lexical search, spelling variants and repeated substrings against brute force."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import fold, prose
from pyspark.sql import functions as F

from tallyspark.llm import lexical, substrings, variants
from tallyspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


def table(spark, name):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


# lexical search

def ranked(documents, items, k=10):
    tfs = [(key, Counter(TERM.findall(fold(text)))) for key, text in documents]
    n = sum(bool(c) for _, c in tfs)
    total = sum(sum(c.values()) for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    asked = defaultdict(set)
    for key, text in items:
        asked[key] |= set(TERM.findall(fold(text)))
    out = {}
    for item, terms in asked.items():
        scores = []
        for key, c in tfs:
            m = 10 + 90 * sum(c.values()) * n // total if c else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, key is None, key or 0))
        for rank, (score, none, key) in enumerate(sorted(scores)[:k], 1):
            out[item, rank] = (None if none else key, -score)
    return out


def search(spark, documents, items, k=10):
    docs = spark.createDataFrame(documents, "doc_id long, text string") \
        .withColumn("term", F.lit(1)).withColumn("block", F.lit("x")).withColumn("w", F.lit(2))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(3))
    rows = lexical.rank_documents(docs, asked, k).collect()
    got = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in rows}
    assert len(got) == len(rows)
    return got


def test_search_equals_full_sums(spark):
    docs = [(i, prose(i, 5 + i % 60, 90)) for i in range(300)]
    docs += [(300, None), (301, ""), (302, " .,; "), (None, docs[3][1]), (304, docs[3][1]),
             (304, docs[3][1]), (305, "É Ünï中文 É ünï"), (306, "word " * 500 + docs[5][1])]
    items = [(i, prose(1000 + i, 12, 90)) for i in range(20)]
    items += [(20, None), (21, ""), (22, "nowhere"), (23, "É 中文 ÜNÏ"), (None, docs[7][1]),
              (24, docs[3][1]), (24, docs[4][1])]
    assert search(spark, docs, items) == ranked(docs, items)
    assert search(spark, docs, items, k=3) == ranked(docs, items, 3)


def test_search_in_many_blocks(spark):
    """Several blocks of the same documents, one text longer than a slice."""
    docs = [(i, prose(i, 40, 200)) for i in range(3000)]
    docs.append((3000, prose(5, 300_000, 200)))
    items = [(i, prose(5000 + i, 6, 200)) for i in range(5)]
    assert search(spark, docs, items) == ranked(docs, items)


def test_search_empty_tables(spark):
    some = [(1, "a b")]
    assert search(spark, [], some) == {}
    assert search(spark, some, []) == {}
    assert search(spark, [], []) == {}


def test_bundle_keeps_what_can_still_win():
    """Accumulators dropped between owners never belong to the k best."""
    random = np.random.default_rng(4)
    items, docs, k = 7, 60, 5
    loads = random.integers(1, 5000, (items, lexical.OWNERS))
    left = {"m": random.integers(10, 200, docs), "items": np.arange(items), "loads": loads.ravel(),
            "places": np.zeros(0, np.int32), "scores": np.zeros(0, np.int64)}
    column = lambda v: pa.array([v], pa.list_(pa.from_numpy_dtype(v.dtype)))
    state = pa.table({c: column(v) for c, v in left.items()})
    full = np.zeros((items, docs), np.int64)
    for owner in range(lexical.OWNERS):
        w = int(loads[:, owner].min())
        tfs = random.integers(1, 4, 20).astype(np.int32)
        held = np.sort(random.choice(docs, 20, replace=False)).astype(np.int32)
        right = pa.table({"w": [w], "asking": column(np.arange(items, dtype=np.int32)),
                          "docs": column(held), "tfs": column(tfs)})
        t = tfs.astype(np.int64)
        full[:, held] += w * (10 ** 9 * t // (1000 * t + 8 * left["m"][held]))
        if owner < lexical.OWNERS - 1:
            state = lexical._owner_stage(owner, k)(state, right)
    last = lexical._last_stage(lexical.OWNERS - 1, k)
    state = state.append_column("ids", column(np.arange(docs)))
    rows = last(state, right).to_pylist()
    for item in range(items):
        got = sorted(((-r["score"], r["doc_id"]) for r in rows if r["item_id"] == item))[:k]
        want = sorted((-s, d) for d, s in enumerate(full[item]) if s)[:k]
        assert got == want


# spelling variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(documents, rate, min_chars=5, min_count=3):
    n = Counter()
    for key, text in documents:
        for run in RUN.findall(text or ""):
            run = fold(run)
            h = zlib.crc32(f"{key}:{run}".encode())
            if rate and key is not None and h % rate == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= min_chars and c >= min_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def variants_of(n):
    gone = defaultdict(set)  # words that share a deletion may be near
    for w in n:
        for i in range(len(w)):
            gone[w[:i] + w[i + 1:]].add(w)
        gone[w].add(w)
    near = defaultdict(set)
    for group in gone.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def as_rows(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


@needs_tables
def test_variants_query(spark):
    docs = [r[:2] for r in table(spark, "documents")]
    got = as_rows(QUERIES["op12_spelling_variants"][0](spark, SF))
    assert got == variants_of(counted(docs, 97))
    assert any(form for form, *_ in got.values())


def test_variants_of_words(spark):
    random = np.random.default_rng(9)
    letters = list("abcdéÿ")
    n = {"".join(random.choice(letters, size)): int(random.integers(1, 50))
         for size in random.integers(1, 8, 900)}
    n |= {"chain": 1, "chains": 2, "chainsa": 4, "chainsab": 9, "aaaaa": 3, "aaaaaa": 6, "aaaaab": 6}
    words = spark.createDataFrame(list(n.items()), "word string, n long") \
        .withColumn("signature", F.lit(1)).withColumn("near", F.lit(2))
    got = as_rows(variants.spelling_variants(words))
    assert got == variants_of(n)
    assert got["chain"][:2] == ("chains", "chainsab")


def test_variants_broadcast_no_table(spark, monkeypatch):
    """The staged files are small, but what is joined grows with the corpus."""
    plans, put = [], variants.stage

    def seen(df, name, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return put(df, name, **options)

    monkeypatch.setattr(variants, "stage", seen)
    words = spark.createDataFrame([("chain", 1), ("chains", 2), ("chainsa", 4)], "word string, n long")
    assert as_rows(variants.spelling_variants(words))["chain"][1] == "chainsa"
    assert sum("SortMergeJoin" in p for p in plans) >= 4  # pairs, forms, roots, result
    assert not any("Broadcast" in p for p in plans)


def test_counting_words(spark):
    docs = [(1, None), (2, ""), (3, "Ab ab-ABÉé xĀy ×÷ 中"), (3, "ab"),
            (None, "ab " * 7), (4, "long " * 400_000), (5, "z" * 3_000_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("w"))
    for rate in (0, 2):
        got = {r.word: r.n for r in variants.count_words(frame, rate, 1, 1).collect()}
        assert got == counted(docs, rate, 1, 1)
    assert variants.spelling_variants(variants.count_words(frame.limit(0))).count() == 0


def test_near_words_share_a_signature():
    random = np.random.default_rng(2)
    for _ in range(3000):
        w = "".join(random.choice(list("abcà"), int(random.integers(1, 12))))
        i = int(random.integers(0, len(w) + 1))
        near = [w[:i] + "b" + w[i:]] + ([w[:i] + "d" + w[i + 1:]] if i < len(w) else [])
        for other in near:
            assert set(variants.signatures(w)) & set(variants.signatures(other))


# repeated substrings

def without_repeats(rows, width):
    """(key, text) -> (bytes, removed, spans, kept); equal rows are one text"""
    order = sorted({(key is None, key or 0, hashlib.sha256((text or "").encode()).digest(),
                     (text or "").encode()) for key, text in rows})
    seen, out = set(), {}
    for none, key, _, raw in order:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - width + 1):
            if raw[i:i + width] in seen:
                gone[i:i + width] = True
            seen.add(raw[i:i + width])
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[None if none else key, raw] = (len(raw), int(gone.sum()), spans, kept)
    return out


def cleaned(spark, rows, width):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("order", "digest", "tie", "shared", "block", "size"):
        frame = frame.withColumn(c, F.lit(c))
    texts, ids = substrings.repeated_substrings(frame, width)
    removed = F.expr("aggregate(zip_with(starts, ends, (a, b) -> b - a), 0L, (s, x) -> s + x)")
    texts = texts.select("digest", "n_bytes", removed.alias("n_removed"),
                         F.size("starts").cast("long").alias("n_spans"),
                         F.sha2("kept", 256).alias("kept_sha256")).distinct()
    return sorted(map(tuple, substrings.attach(texts, ids, width).collect()), key=str)


def check_cleaned(spark, rows, width):
    want = without_repeats(rows, width)
    listed = []
    for key, text in rows:
        n, removed, spans, kept = want[key, (text or "").encode()]
        listed.append((key, n, removed, spans, hashlib.sha256(kept).hexdigest()))
    assert cleaned(spark, rows, width) == sorted(listed, key=str)


@needs_tables
def test_substrings_query(spark):
    rows = [r[:2] for r in table(spark, "documents")]
    want = {key: (n, removed, spans, hashlib.sha256(kept).hexdigest())
            for (key, _), (n, removed, spans, kept) in without_repeats(rows, 100).items()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in QUERIES["op13_substrings"][0](spark, SF).collect()}
    assert got == want and any(w[1] for w in want.values())


@pytest.mark.parametrize("width", [12, 40])
def test_substrings_of_small_alphabet(spark, width):
    random = np.random.default_rng(width)
    passage = "".join(random.choice(list("abé"), 300))
    rows = [(i, "".join(random.choice(list("ab"), int(random.integers(0, 60))))) for i in range(40)]
    for i in range(40, 90):  # cut-outs of one passage at every offset, in odd places
        a, b = sorted(random.integers(0, 300, 2))
        rows.append((i, "x" * int(random.integers(0, 9)) + passage[a:b] + str(i)))
    rows += [(7, rows[3][1] + "other"), (7, rows[60][1]), (None, rows[70][1]), (None, "a" * 200),
             (90, None), (91, ""), (92, rows[80][1]), (93, rows[80][1]), (93, rows[80][1]),
             (94, "ab" * 100), (95, "b" + "ab" * 100)]
    check_cleaned(spark, rows, width)


def test_substrings_of_long_texts(spark):
    body = prose(1, 60_000, 5000)
    rows = [(1, body), (2, prose(2, 200_000, 5000) + body[1000:200_000]), (3, body + "!" + body[:500])]
    check_cleaned(spark, rows, 100)


def test_substrings_empty_table(spark):
    assert cleaned(spark, [], 100) == []
    with pytest.raises(ValueError):
        substrings.cover(11)


@pytest.mark.parametrize("period", sorted(substrings.COVERS))
def test_covers_hold_every_difference(period):
    held = substrings.COVERS[period]
    assert {(a - b) % period for a in held for b in held} == set(range(period))


def test_block_by_slices(monkeypatch):
    """Slices smaller than the texts change nothing."""
    import zstandard
    raw = [prose(i, 400, 50).encode() for i in range(6)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    row = {"packed": zstandard.compress(b"".join(raw)), "block": 0, "bounds": bounds.tolist(),
           "orders": list(range(6)), "digests": [b""] * 6, "notes": None}
    whole = substrings._Block(row, 100).samples()
    monkeypatch.setattr(substrings, "SLICE_BYTES", 777)
    parts = substrings._Block(row, 100).samples()
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))
    at = np.flatnonzero(np.array([x % 3 == 0 for x in range(1500)]))
    assert np.array_equal(substrings._Block(row, 100).leaders(at)[0][:5].shape, (5,))
