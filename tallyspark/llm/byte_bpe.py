"""Byte-level BPE encoding by backtracking, and decoding.

Merging by rank is replaced by a search that yields the same ids: from each
position take the longest token and accept it only if it may follow the token
before it; otherwise take the next shorter one, or step back.  Two tokens may be
neighbours iff undoing their merges from the seam outward never meets a pair
that would have merged across it earlier.  A position that failed once is never
entered again, so the work is linear in the bytes.  Bytes are mapped one to one
to Latin-1 so that pyahocorasick finds all tokens of a match in one pass.

Contract: a null text encodes as empty (no ids, digests of nothing); rows keep
their key, null or repeated; other columns are ignored; any length is encoded
whole.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import SpaceChunks

#: Neighbour pairs remembered per Python worker.
PAIR_LIMIT = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BacktrackBPE:
    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick
        self.ranks = ranks
        self.vocab = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.seams: dict[tuple[int, int], bool] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int | None] = {}
        automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            cut = next((n for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), 0)
            self.shorter[rank] = ranks[token[:cut]] if cut else None
            if len(token) == 1:
                self.parts[rank] = (rank, rank)
            elif (pair := self._last_merge(token, rank)) is not None:
                self.parts[rank] = pair
                self.merged[pair] = rank
            else:
                continue  # no sequence of merges makes it, so it never occurs
            automaton.add_word(token.decode("latin-1"), rank)
        for rank, prefix in self.shorter.items():
            while prefix is not None and prefix not in self.parts:
                prefix = self.shorter[prefix]
            self.shorter[rank] = prefix
        automaton.make_automaton()
        self.automaton = automaton
        self.seams.clear()

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        for n in range(len(token) - 1, 0, -1):
            left, right = self.ranks.get(token[:n]), self.ranks.get(token[n:])
            if (left is not None and right is not None and left < rank and right < rank
                    and left in self.parts and right in self.parts
                    and self._seam_holds(left, right)):
                return left, right
        return None

    def _seam_holds(self, left: int, right: int) -> bool:
        """No merge would join the two tokens across their seam."""
        limit = float("inf")
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    limit, inner = left, self.parts[left][1]
                    moved = inner != left
                    left = inner
                else:
                    limit, inner = right + 1, self.parts[right][0]
                    moved = inner != right
                    right = inner
                if moved:
                    break
                undo_left = not undo_left
            else:
                return True

    def may_follow(self, left: int, right: int) -> bool:
        pair = (left, right)
        holds = self.seams.get(pair)
        if holds is None:
            if len(self.seams) >= PAIR_LIMIT:
                self.seams.clear()
            holds = self.seams[pair] = self._seam_holds(left, right)
        return holds

    def encode(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        rank = self.ranks.get(data)
        if rank is not None and rank in self.parts:
            return [rank]
        size, length, shorter = len(data), self.length, self.shorter
        may_follow = self.may_follow
        longest: list[int] = [0] * size
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - length[token]] = token  # ends rise, so the longest stays
        open_end = bytearray(b"\x01") * (size + 1)
        ids: list[int] = []
        at, token = 0, longest[0] if size else None
        while at < size:
            end = at + length[token]
            if open_end[end] and (not ids or may_follow(ids[-1], token)):
                ids.append(token)
                at = end
                token = longest[at] if at < size else None
            elif shorter[token] is not None:
                token = shorter[token]
            else:
                open_end[at] = 0
                token = ids.pop()
                at -= length[token]
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str) -> BacktrackBPE:
    return BacktrackBPE(read_ranks(path))


@lru_cache(maxsize=2)
def _chunks(path: str, pattern: str) -> SpaceChunks:
    import regex
    bpe, matches = load(path), regex.compile(pattern)

    def packed(match: str) -> bytes:
        return array("I", bpe.encode(match.encode())).tobytes()

    def encode(texts: list[str]) -> list[bytes]:
        return [b"".join(map(packed, matches.findall(text))) for text in texts]

    def encode_words(words: list[str]) -> list[bytes]:  # letters after a space: one match
        return [packed(" " + word) for word in words]

    return SpaceChunks(encode, encode_words)


def encode_text(text: str, path: str, pattern: str) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    return b"".join(_chunks(path, pattern).pieces(text))


def decode_ids(ids: bytes, path: str) -> bytes:
    return load(path).decode(np.frombuffer(ids, "<u4").tolist())


def _over(table: DataFrame, key: str, value: str, outputs: dict) -> DataFrame:
    """``key`` and, for each row's ``value``, the binary ``outputs``: name -> function chain."""
    names = list(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in names]
            for x in batch.column(1):
                value = x.as_py()
                for column, name in zip(columns, names):
                    value = outputs[name](value)
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.binary()) for c in columns)], [key, *names])

    kind = table.schema[key].dataType.simpleString()
    return (table.select(key, value)
            .mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"`{n}` binary" for n in names)))


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """(key, ids) per row: the ids as little-endian unsigned 32-bit integers."""
    return _over(docs, key, text, {"ids": lambda t: encode_text(t or "", ranks, pattern)})


def decode(encoded: DataFrame, ranks: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes): the bytes that the ids stand for."""
    return _over(encoded, key, ids, {"bytes": lambda i: decode_ids(i or b"", ranks)})


def round_trip(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """(key, ids, bytes): texts encoded and their ids decoded, in one pass over the rows."""
    return _over(docs, key, text, {"ids": lambda t: encode_text(t or "", ranks, pattern),
                                   "bytes": lambda i: decode_ids(i, ranks)})
