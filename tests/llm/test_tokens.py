"""Token counts, byte BPE and packing against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from helpers import docs_frame, prose
from tokenizers import Tokenizer

from tallyspark.llm import byte_bpe, packing, staging, token_counts
from tallyspark.llm.tokens import WordChunks

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COUNTS = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a  b", "\n\nx\n y\t\tz ", "don't  we'll 's", " lead", "trail ", "a\n", "\na",
       "é" * 50, "x" * 5000, "日本語 漢字", "\U0001f642\U0001f642 e",
       "a b", "a\x1cb \x1c c", "1 2  33 ٣", "<|endoftext|> a<|endoftext|>b", "\r\n a\r\nb",
       "a.\nB, c;d", "word.", "İstanbul Σίσυφος",
       "é x", "<|STARTOFTEXT|> <|startoftext|>x", "a b", "It's THE End, end."]


def texts():
    random.seed(5)
    alphabet = "ab c\n\t.,'sdé漢1 2 \x1c\U0001f642ll"
    drawn = ["".join(random.choices(alphabet, k=random.randint(1, 40))) for _ in range(300)]
    return ODD + drawn + [prose(1, 30_000)]


@pytest.fixture(scope="module")
def odd_docs(spark):
    return docs_frame(spark, [*enumerate(texts()), (-1, None), (None, "null key"), (3, "x y")])


def test_byte_bpe_equals_tiktoken(spark, odd_docs):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                            mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    rows = byte_bpe.round_trip(odd_docs.withColumnRenamed("lang", "ids"), RANKS,
                               public_tokenizers.PATTERN).collect()
    want = sorted((None if k is None else k, tuple(own.encode_ordinary(t or "")), (t or "").encode())
                  for k, t in [(r.doc_id or -9, r.text) for r in odd_docs.collect()])
    got = sorted((r.doc_id or -9, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.bytes))
                 for r in rows)
    assert got == want
    again = byte_bpe.decode(byte_bpe.encode(odd_docs, RANKS, public_tokenizers.PATTERN), RANKS)
    assert sorted(bytes(r.bytes) for r in again.collect()) == sorted(x[2] for x in want)


def test_seams_of_random_bytes():
    bpe = byte_bpe.load(RANKS)
    own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=bpe.ranks, special_tokens={})
    random.seed(3)
    for _ in range(300):
        text = "".join(random.choices("abcdetionrsh  éü\n0", k=random.randint(1, 60)))
        assert bpe.encode(text.encode()) == own.encode_ordinary(text)


def test_counts_and_cache(spark, odd_docs):
    tokenizer = Tokenizer.from_file(COUNTS)
    cache = staging.new_folder(spark, "test-cache")
    first = token_counts.count_tokens(odd_docs, cache, COUNTS).collect()
    assert len(first) == odd_docs.count()
    want = sorted((r.doc_id or -9, len((r.text or "").encode()),
                   len(tokenizer.encode(r.text or "", add_special_tokens=False)))
                  for r in odd_docs.collect())
    assert sorted((r.doc_id or -9, r.n_bytes, r.n_tokens) for r in first) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({r.text or "" for r in odd_docs.collect()})
    more = docs_frame(spark, [(1, "brand new text"), (2, ODD[2])])
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(more, cache, COUNTS).collect()} \
        == {1: 3, 2: len(tokenizer.encode(ODD[2], add_special_tokens=False))}
    assert spark.read.parquet(cache).count() == stored + 1  # only the miss was added
    empty = docs_frame(spark, [(1, "x")]).where("doc_id > 1")
    assert token_counts.count_tokens(empty, staging.new_folder(spark, "none"), COUNTS).count() == 0


def pieces_of(frame):
    return sorted(frame.collect(), key=lambda r: (r.sequence_id, r.offset))


def check_pieces(rows, docs, window):
    tokenizer = Tokenizer.from_file(WORDS)
    at = 0
    for r in rows:  # gapless, and only the last window is short
        assert r.sequence_id * window + r.offset == at
        at += r.length
        assert r.offset + r.length <= window
    whole = {}
    for key, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        whole.setdefault(key, []).append(ids)
    assert at == sum(len(x) for v in whole.values() for x in v)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(),
                                             r.doc_tokens))
    for key, texts_ in whole.items():
        if len(texts_) == 1:
            parts = sorted(got[key])
            assert [i for _, ids, _ in parts for i in ids] == texts_[0]
            assert [s for s, _, _ in parts] == list(np.cumsum([0] + [len(p[1]) for p in parts])[:-1])
            assert {n for _, _, n in parts} == {len(texts_[0])}


def test_packing_covers_every_id_once(spark, odd_docs):
    rows = pieces_of(packing.pack(odd_docs, WORDS, 2, window=256, packet=64))
    check_pieces(rows, [(r.doc_id, r.text) for r in odd_docs.collect()], 256)


def test_packing_mixture_and_shares(spark):
    docs = [(i, prose(i, 40 + i % 50), "en", "abc"[min(i % 6, 2)] if i % 5 else None)
            for i in range(400)]
    frame = docs_frame(spark, docs).repartition(5)
    rows = pieces_of(packing.pack(frame, WORDS, 2, window=512, packet=128))
    check_pieces(rows, [(d[0], d[1]) for d in docs], 512)
    source = {d[0]: d[3] or "" for d in docs}
    total = {}
    for r in rows:
        total[source[r.doc_id]] = total.get(source[r.doc_id], 0) + r.length
    whole = sum(total.values())
    last = rows[-1].sequence_id
    run = dict.fromkeys(total, 0)
    for r in rows:  # deficits stay within two packets of a source's share, at every window
        run[source[r.doc_id]] += r.length
        if r.offset + r.length == 512 and r.sequence_id < last:
            for s, n in run.items():
                assert abs(n - (r.sequence_id + 1) * 512 * total[s] / whole) <= 3 * 128
    given = pieces_of(packing.pack(frame, WORDS, 2, window=512, packet=128,
                                   weights={"a": 1, "b": 1, "c": 4, "": 1}))
    check_pieces(given, [(d[0], d[1]) for d in docs], 512)
    head = [r for r in given if r.sequence_id < 8]
    share = sum(r.length for r in head if source[r.doc_id] == "c") / sum(r.length for r in head)
    assert abs(share - 4 / 7) < 0.1
    assert zlib.crc32(rows[0].ids) >= 0 and hashlib.sha256(rows[0].ids).digest()


def test_packing_nothing(spark):
    empty = docs_frame(spark, [(1, "x")]).where("doc_id > 1")
    assert packing.pack(empty, WORDS, 2).count() == 0


def test_every_window_holds_small_shares(spark):
    """20 equal sources of 800-token documents: a window of 4096 has room for all."""
    rows = [(q * 100 + i, f"s{q}", 800, 800 * i, 0) for q in range(20) for i in range(40)]
    sizes = spark.createDataFrame(rows, "row long, queue string, n long, before long, part long")
    held = {}
    for r in packing.schedule(sizes, 4096).collect():
        held.setdefault(r.sequence_id, set()).add(r.row // 100)
    fewest = min(len(held[w]) for w in range(2, max(held) - 2))
    assert fewest >= 15


def test_different_chunks_are_looked_up_once():
    asked = []

    def encode(chunks):
        asked.extend(chunks)
        return [c and c.encode() + b"|" or b"" for c in chunks]

    words = WordChunks(encode, limit=2)
    column = pa.array(["skipped", "b a  a", None, "", " a b\tC ", "a\x1cb"]).slice(1)
    assert words.values(column).to_pylist() == [b"b|a|a|", b"", b"", b"a|b|c|", b"a\x1cb|"]
    assert len(asked) == len(set(asked))
    seen = len(asked)
    assert words.values(pa.array(["d c", "a d"])).to_pylist() == [b"d|c|", b"a|d|"]
    assert asked[seen:] == ["d"]  # the others came back from the older half
    assert words.values(pa.array([], pa.string())).to_pylist() == []


def test_packed_ids_are_the_librarys():
    """Letters that leave a combining mark when lowered or composed; closing marks in a row."""
    tokenizer = Tokenizer.from_file(WORDS)
    chunks, kind = packing._encoder(WORDS)
    odd = ["\u0130, \u0130.", "\ufb2a, a", "\u0958! b", "H\u0331 T\u0308 Y\u030a J\u030c", "\u01c5.",
           "<|ENDOFTEXT|>", "word!!) word!!) WORD'. don't'", "\u00e9t\u00e9?! \u00c9T\u00c9", "x<|endoftext|>."]
    random.seed(7)
    drawn = ["".join(random.choices("aHT\u0130\u00e9\u0331\u0308\ufb2a.,!' \n<|", k=12)) for _ in range(2000)]
    rows = [*texts(), *odd, *drawn, None]
    got = chunks.values(pa.array(rows, pa.string())).to_pylist()
    for text, ids in zip(rows, got):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, kind).tolist() == want, text


def test_slices_hold_all_rows_within_their_bytes(monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 10)
    rows = ["x" * 25, None, "", "abcd", "efgh", "ijkl", "m" * 10, "n"]
    batch = pa.RecordBatch.from_pydict({"text": rows})
    parts = [p.column("text").to_pylist() for p in packing._slices(batch, "text")]
    assert [x for p in parts for x in p] == rows
    assert all(len(p) == 1 or sum(len(x or "") for x in p) <= 10 for p in parts)
    assert len(parts) == 5
    assert not list(packing._slices(batch.slice(0, 0), "text"))
