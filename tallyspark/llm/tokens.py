"""Word-memoised use of tokenizers inside tasks.

A tokenizer spends nearly all its time on words it has met before.  Text is cut
at places where no token can cross and the tokens of each chunk are kept in two
generations of a dictionary of bounded size; the library itself encodes every chunk that is not
in it, so results are the library's.

Byte-level patterns never cross a single space between two non-space
characters: the space opens the next match.  A single newline between two
non-space characters is a match of its own.  Chunks therefore are ``" word"``
(stored without its space) or ``"\\nword"``; text with other runs of white space
is cut only at the former places.

A chunk of letters and one closing mark is the letters' tokens followed by the
mark's, as both patterns here match letters and marks apart.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RUNS = re.compile(r"\s\s|\A\s|\s\Z|[^\S \n]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_MARKS = frozenset(".,;:!?")
#: Before a combining mark, a capital composes to other letters than a small one; a special
#: token in capitals is none.
_CASE_COUNTS = "<\\||[\\x{300}-\\x{36f}]"

#: Chunks in a generation of the memo, of which a Python worker keeps two.
MEMO_LIMIT = 250_000

Encode = Callable[[list[str]], list]


class ChunkMemo:
    """chunk -> value; values of consecutive chunks add up to that of the text.

    ``encode`` gives the values of strings as they stand; ``encode_words`` (by
    default the same) those of chunks of letters only, which it may encode in
    one call, as one text.
    """

    def __init__(self, encode: Encode, as_text: Callable[[str], str],
                 encode_words: Encode | None = None, limit: int = MEMO_LIMIT):
        self.as_text, self.limit = as_text, limit
        self.encode = lambda chunks: encode([as_text(c) for c in chunks])
        self.encode_words = encode_words or self.encode
        self.known: dict = {}
        self.older: dict = {}
        self.marks = dict(zip(sorted(_MARKS), encode(sorted(_MARKS))))

    def values(self, chunks: list[str]) -> list:
        """The value of each chunk, encoding unknown ones together."""
        found = list(map(self.known.get, chunks))
        if None not in found:
            return found
        if len(self.known) > self.limit:  # chunks still in use come back from the older half
            self.older, self.known = self.known, {}
            found = [None] * len(chunks)
        known, older = self.known, self.older
        words: dict[str, None] = {}
        others: list[str] = []
        marked: list[str] = []
        for chunk in {c for c, v in zip(chunks, found) if v is None}:
            if (value := older.get(chunk)) is not None:
                known[chunk] = value
            elif chunk.isalpha():
                words[chunk] = None
            elif chunk and chunk[-1] in _MARKS and chunk[:-1].isalpha():
                marked.append(chunk)
                if chunk[:-1] not in known:
                    words[chunk[:-1]] = None
            else:
                others.append(chunk)
        if words:
            known.update(zip(words, self.encode_words(list(words))))
        if others:
            known.update(zip(others, self.encode(others)))
        for chunk in marked:
            known[chunk] = known[chunk[:-1]] + self.marks[chunk[-1]]
        return [known[c] if v is None else v for c, v in zip(chunks, found)]


class SpaceChunks:
    """Values of whole texts under a byte-level pattern (``" ?\\p{L}+"`` and the like)."""

    def __init__(self, encode: Encode, encode_words: Encode | None = None,
                 limit: int = MEMO_LIMIT):
        self.encode = encode
        self.memo = ChunkMemo(encode, lambda c: c if c[0] == "\n" else " " + c,
                              encode_words, limit)

    def pieces(self, text: str) -> list:
        """Values that add up to that of the text."""
        if not text:
            return []
        if _RUNS.search(text) is None:
            first, *rest = text.replace("\n", " \n").split(" ")
        else:
            first, *rest = _CUT.split(text)
        return [*self.encode([first]), *self.memo.values(rest)]


class WordChunks:
    """Values (byte strings) of whole texts, a column at a time, under a pattern that drops
    white space and case: Arrow cuts the texts, and each different chunk is looked up once."""

    def __init__(self, encode: Encode, limit: int = MEMO_LIMIT):
        self.encode, self.limit = encode, limit
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def look_up(self, chunks: list[str]) -> list[bytes]:
        """The value of each of different chunks, encoding unknown ones together."""
        if len(self.known) > self.limit:  # chunks still in use come back from the older half
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        found = list(map(known.get, chunks))
        new = []
        for i in [i for i, value in enumerate(found) if value is None]:
            if (value := older.get(chunks[i])) is None:
                new.append(i)
            else:
                found[i] = known[chunks[i]] = value
        for i, value in zip(new, self.encode([chunks[i] for i in new]) if new else []):
            found[i] = known[chunks[i]] = value
        return found

    def values(self, texts: pa.Array) -> pa.Array:
        """The joined values of each text's chunks; a null text is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        kept = pc.match_substring_regex(texts, _CASE_COUNTS)
        chunks = pc.ascii_split_whitespace(pc.if_else(kept, texts, pc.ascii_lower(texts)))
        ends = np.cumsum(pc.list_value_length(chunks).to_numpy())
        found = chunks.flatten().dictionary_encode()
        known = self.look_up(found.dictionary.to_numpy(zero_copy_only=False).tolist())
        out = pa.array(known, pa.binary()).take(found.indices)
        _, offsets, data = out.buffers()
        bounds = np.frombuffer(offsets, np.int32)[np.append(0, ends)]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds), data])


def grouped(tokenizer, text: str, edge: np.ndarray, groups: int,
            opens: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids of a text of ``groups`` words and the end of each word's ids.

    ``edge`` marks the ids that open (or else end) a word.  None if the ids do
    not fall into so many words; the words are then encoded one by one.
    """
    ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
    at = np.flatnonzero(edge[ids])
    if len(at) != groups or (opens and at[0] != 0) or (not opens and at[-1] != len(ids) - 1):
        return None
    return ids, (np.append(at[1:], len(ids)) if opens else at + 1)


def edges(tokenizer, is_edge: Callable[[str], bool]) -> np.ndarray:
    """By id: whether its token opens or ends a word."""
    flags = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab().items():
        flags[i] = is_edge(token)
    return flags
