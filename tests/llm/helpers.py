"""Brute-force versions of the operators and small tables that try them."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import regex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows):
    """documents from (doc_id, text[, lang, source])."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    random = np.random.default_rng(seed)
    words = ["w" + np.base_repr(i * 7919 + 13, 36).lower() for i in range(vocabulary)]
    return " ".join(words[i] for i in random.integers(0, vocabulary, n))


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    text = text or ""
    words = WORD.findall(text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated,
            len(covered))


def shingles(text, size):
    words = WORD.findall(fold(text))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(zip(*(words[k:] for k in range(size))))


def components(rows, size, percent):
    """key -> (set size, smallest key reachable)"""
    sets = {k: shingles(t, size) for k, t in rows}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders = defaultdict(list)
    for k in sorted(sets):
        overlap = Counter(o for gram in sets[k] for o in holders[gram])
        for gram in sets[k]:
            holders[gram].append(k)
        for o, n in overlap.items():
            if 100 * n >= percent * (len(sets[k]) + len(sets[o]) - n):
                a, b = sorted((root(k), root(o)))
                parent[b] = a
    return {k: (len(s), root(k)) for k, s in sets.items()}


def line_key(line):
    return fold(line.strip(" \t\n\x0b\x0c\r"))


def keep_lines(rows, min_chars=20, min_docs=3):
    """(key, text) -> (n_lines, n_dropped, kept text); rows whose key is null stay whole"""
    holders = defaultdict(set)
    for key, text in rows:
        if key is not None:
            for line in (text or "").split("\n"):
                if len(line_key(line)) >= min_chars:
                    holders[line_key(line)].add(key)
    out = {}
    for key, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key is None or len(holders[line_key(x)]) < min_docs
                or key == max(holders[line_key(x)])]
        out[key, text] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
       "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
       "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))
                    for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


_LETTERS = regex.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|[\p{L}\p{M}]+")


def pii_units(text):
    """What the base spans of a text stand for."""
    out = set()
    for span in pii(text):
        kind, start, end = span.split(":")
        value = text[int(start):int(end)]
        digits = re.sub("[^0-9]", "", value)
        parts = value.split(".")
        out |= {(kind, n) for n in {
            "email": (value.lower(), value.lower().rsplit("@", 1)[-1], ""),
            "ip": (value, ".".join(parts[:3]) + ".", ".".join(parts[:2]) + "..", ""),
            "card": (digits, digits[:6], ""), "phone": (digits, digits[:-4] + "-", "")}[kind]}
    return out


def pii_terms(texts):
    """text -> [(start, end, bits left open)] of its disclosing terms (scripts with blanks)."""
    words = {t: [(m.start(), m.end(), m.group().lower()) for m in _LETTERS.finditer(t)
                 if "@" not in m.group()] for t in {t or "" for t in texts}}
    units = {t: pii_units(t) for t in words}
    n_t = Counter(w for t in words for w in {w for *_, w in words[t]})
    n_x = Counter(x for t in words for x in units[t])
    n_tx = Counter((w, x) for t in words for w in {w for *_, w in words[t]} for x in units[t])
    left = {}
    for (w, x), n in n_tx.items():
        size, z = n_t[w], 1.645
        middle, half = n + z * z / 2, z * (n * (size - n) / size + z * z / 4) ** 0.5
        bound = (middle - half) / (size + z * z)
        if -np.log2(bound) <= 1 and np.log2(bound * len(words) / n_x[x]) >= 1:
            left[w, x] = -np.log2(bound)
    out = {}
    for t in words:
        told = [(a, b, min((left[w, x] for x in units[t] if (w, x) in left), default=None))
                for a, b, w in words[t]]
        out[t] = [s for s in told if s[2] is not None]
    return out


def pii(text):
    return [f"{kind}:{m.start()}:{m.end()}" for kind, pattern in PII.items()
            for m in re.finditer(pattern, text or "") if _valid(kind, m.group())]
