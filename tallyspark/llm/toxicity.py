"""Toxic spans by a linear-chain conditional random field, and document scores.

Labels are given for documents only, so tokens are labelled first: token features
(word, prefixes, suffix) that hardly occur outside toxic documents are chosen
greedily until no further one adds a word to enough toxic documents that fewer
than ``EXPLAINED`` words explain; in toxic documents, tokens that carry a chosen feature are toxic.
Copies of a toxic document add no features that way.  A two-label chain is then
fitted to these tokens by gradient ascent on the conditional likelihood; marginals
come from the forward-backward recursion.  The probability that some token of a
document is toxic, 1 - prod(1 - marginal), is calibrated on the document labels.

Fitting takes a bounded sample of labelled rows (``SAMPLE_DOCS``, ``SAMPLE_CHARS``,
whole texts in hash order, each that still fits, very long ones last) in one task;
where toxic rows are so rare that it would hold none, they come first.  Scoring takes
all rows in parallel.

Contract: a null or empty text has no tokens and gets the score of no evidence;
rows that repeat a key are scored each; unlabelled rows and null labels do not
teach; without any toxic label every score is 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .words import Texts, mix, slices

#: Bounds of the sample that the model is fitted on.
SAMPLE_DOCS, SAMPLE_CHARS = 6_000, 24_000_000
#: A feature may label tokens if this share of its documents is toxic, and if it
#: explains so many toxic documents that no earlier feature does.
PURITY, LEAST_DOCS = 0.9, 4
#: Different words that should explain a toxic document, where it has them.
EXPLAINED = 2
#: Features of the chain: those in so many toxic documents, the most telling first.
VOCABULARY, VOCABULARY_DOCS = 4_000, 3
ROUNDS, RATE, RIDGE = 40, 0.3, 0.02
#: Marginal from which a token belongs to a span.
SPAN_AT = 0.5
THRESHOLD = 0.7

#: A token is a run of ASCII letters and bytes of other characters.
_GAPS = np.ones(256, bool)
_GAPS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False
_CHUNK = 64


def _features(texts: Texts) -> np.ndarray:
    """(templates, tokens) feature hashes: word, 4 and 5 byte prefix, 3 byte suffix."""
    start, end = texts.word_start, texts.word_end
    rows = [texts.hashes(start, end), texts.hashes(start, np.minimum(start + 4, end)),
            texts.hashes(start, np.minimum(start + 5, end)),
            texts.hashes(np.maximum(end - 3, start), end)]
    return np.stack([mix(r + np.uint64(k + 1)) for k, r in enumerate(rows)])


def marginals(score: np.ndarray, first: np.ndarray, moves: np.ndarray,
              pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """P(label 1) per token of chains laid end to end (``first`` opens a chain).

    ``moves``: log weights of the label pairs.  Products of the step matrices are
    taken over chunks of tokens side by side, carried over chunks, and then
    unrolled inside them, so the recursion is exact and costs few array steps.
    With ``pairs`` also the expected number of each label pair.
    """
    n = len(score)
    size = -(-n // _CHUNK) * _CHUNK
    lift = np.exp(np.clip(np.concatenate([score, np.zeros(size - n)]), -40, 40))
    opens = np.concatenate([first, np.ones(size - n, bool)])
    step = np.empty((2, 2, size))
    weight = np.exp(moves)
    for a in range(2):
        for b in range(2):
            step[a, b] = np.where(opens, 1.0, weight[a, b]) * (lift if b else 1.0)
    step /= step.sum((0, 1))
    step = step.reshape(2, 2, -1, _CHUNK)
    whole = np.broadcast_to(np.eye(2)[:, :, None], (2, 2, step.shape[2]))
    for c in range(_CHUNK):
        whole = np.einsum("abk,bck->ack", whole, step[..., c])
        whole = whole / whole.sum((0, 1))
    carried = whole.transpose(2, 0, 1).tolist()
    ahead, back = [(0.5, 0.5)], [(0.5, 0.5)]
    for (p, q), (r, s) in carried[:-1]:
        x, y = ahead[-1]
        u, v = x * p + y * r, x * q + y * s
        ahead.append((u / (u + v), v / (u + v)))
    for (p, q), (r, s) in reversed(carried[1:]):
        x, y = back[-1]
        u, v = p * x + q * y, r * x + s * y
        back.append((u / (u + v), v / (u + v)))
    alpha, beta = np.array(ahead).T, np.array(back[::-1]).T
    forward, backward = np.empty((2, step.shape[2], _CHUNK)), np.empty((2, step.shape[2], _CHUNK))
    for c in range(_CHUNK):
        alpha = np.einsum("ak,abk->bk", alpha, step[..., c])
        alpha = alpha / alpha.sum(0)
        forward[..., c] = alpha
    for c in reversed(range(_CHUNK)):
        backward[..., c] = beta
        beta = np.einsum("abk,bk->ak", step[..., c], beta)
        beta = beta / beta.sum(0)
    both = forward * backward
    both /= both.sum(0)
    marginal = both[1].reshape(-1)[:n]
    if not pairs:
        return marginal, None
    forward, backward = forward.reshape(2, -1), backward.reshape(2, -1)
    joint = forward[:, None, :-1] * step.reshape(2, 2, -1)[..., 1:] * backward[None, :, 1:]
    joint /= joint.sum((0, 1))
    inside = ~opens[1:]
    inside[max(n - 1, 0):] = False
    return marginal, joint[..., inside].sum(-1)


def _token_labels(features: np.ndarray, doc: np.ndarray, toxic: np.ndarray):
    """(label per token, (feature, toxic documents, clean documents) of all features)."""
    count = len(toxic)
    held, holders = [], []
    cuts = np.unique(np.searchsorted(doc, doc[::1 << 18]))  # a document is in one part
    for part in (slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(doc)])):
        own = np.broadcast_to(doc[part], features[:, part].shape).reshape(-1)
        flat = features[:, part].reshape(-1)
        _, once = np.unique(mix(flat + mix(own.astype(np.uint64))), return_index=True)
        held.append(flat[once])
        holders.append(own[once].astype(np.int32))
    held, holder = np.concatenate(held), np.concatenate(holders)
    names = np.unique(held)
    bad, good = (np.bincount(np.searchsorted(names, held[toxic[holder] == t]),
                             minlength=len(names)) for t in (True, False))
    del held, holder, holders
    # Shares are taken as if both kinds of documents were equally many.
    rate = bad / max(1, toxic.sum())
    pure = rate / (rate + good / max(1, count - toxic.sum()) + 1e-12)
    able = np.flatnonzero((bad >= LEAST_DOCS) & (pure >= PURITY) & (good <= bad * (1 - PURITY)))
    label = np.zeros(len(doc), bool)
    if not len(able):
        return label, (names, bad, good)
    own = np.flatnonzero(toxic[doc])
    at = np.searchsorted(names[able], features[:, own])
    at[at == len(able)] = 0
    template, token = np.nonzero(names[able][at] == features[:, own])
    feature, token = at[template, token], own[token]
    holder_of = lambda x: np.unique(x, axis=1, return_inverse=True)
    (feature_at, _), spot = holder_of(np.stack([feature, doc[token]]))
    (word_doc, _), word = holder_of(np.stack([doc[token].astype(np.uint64), features[0][token]]))
    word_doc, spot, word = word_doc.astype(np.int64), spot.reshape(-1), word.reshape(-1)
    explained = np.zeros(count, np.int64)
    while True:  # the feature that explains most of what too little explains yet
        open_ = (explained[doc[token]] < EXPLAINED) & ~label[token]
        hit = np.zeros(len(feature_at), bool)
        hit[spot[open_]] = True
        gain = np.bincount(feature_at[hit], minlength=len(able))
        best = int(np.lexsort((bad[able], gain))[-1])
        if gain[best] < LEAST_DOCS:
            return label, (names, bad, good)
        label[token[feature == best]] = True
        told = np.zeros(len(word_doc), bool)
        told[word[label[token]]] = True
        explained = np.bincount(word_doc[told], minlength=count)


class Chain:
    """Weights of the chain and of the calibration; plain arrays, so tasks can have it."""

    def __init__(self, names, weights, bias, moves, slope, offset):
        self.names, self.weights, self.bias = names, weights, bias
        self.moves, self.slope, self.offset = moves, slope, offset

    def token_scores(self, features: np.ndarray) -> np.ndarray:
        score = np.full(features.shape[1], self.bias)
        if len(self.names):
            for row in features:
                at = np.searchsorted(self.names, row)
                at[at == len(self.names)] = 0
                score += np.where(self.names[at] == row, self.weights[at], 0.0)
        return score

    def evidence(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(marginal per token, per text log odds that some token is toxic)."""
        first = np.ones(len(texts.word_text), bool)
        first[1:] = texts.word_text[1:] != texts.word_text[:-1]
        marginal = np.zeros(0)
        if len(first):
            marginal, _ = marginals(self.token_scores(_features(texts)), first, self.moves)
        none = np.bincount(texts.word_text, np.log1p(-np.minimum(marginal, 1 - 1e-9)),
                           minlength=texts.count)
        return marginal, np.log(np.maximum(-np.expm1(none), 1e-9)) - none

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -30, 30)))


def fit(texts: list[str], toxic: np.ndarray) -> Chain:
    """The chain of labelled documents."""
    column = pa.array(texts, pa.string())
    parts = [(_features(t), t.word_text + row) for row, t in slices(column, True, _GAPS)]
    features = np.concatenate([f for f, _ in parts] or [np.zeros((4, 0), np.uint64)], axis=1)
    doc = np.concatenate([d for _, d in parts] or [np.zeros(0, np.int64)])
    del parts
    if not toxic.any() or not len(doc):
        return Chain(np.zeros(0, np.uint64), np.zeros(0), -30.0, np.zeros((2, 2)), 0.0, -30.0)
    label, (names, bad, good) = _token_labels(features, doc, toxic)
    lift = np.abs(np.log((bad + 0.5) / (toxic.sum() + 1)
                         / ((good + 0.5) / ((~toxic).sum() + 1)))) * np.sqrt(bad + good)
    able = np.flatnonzero(bad >= VOCABULARY_DOCS)
    names = np.sort(names[able[np.argsort(-lift[able], kind="stable")[:VOCABULARY]]])
    del bad, good, lift
    # The chain learns from the toxic documents and as many others.
    some = toxic | (~toxic & (np.cumsum(~toxic) <= toxic.sum()))
    features, label, doc = features[:, some[doc]], label[some[doc]], doc[some[doc]]
    at = np.searchsorted(names, features)
    at[at == len(names)] = 0
    template, token = np.nonzero(names[at] == features)
    column_of = at[template, token]
    del features, at, template
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    both = ~first[1:]
    seen = np.array([[np.sum(both & (label[:-1] == a) & (label[1:] == b)) for b in range(2)]
                     for a in range(2)], float)
    positives = max(1.0, float(label.sum()))
    theta = np.zeros(len(names) + 5)
    theta[-5] = np.log(positives / len(label))
    mean, spread = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, ROUNDS + 1):  # Adam on the mean log likelihood per toxic token
        moves = theta[-4:].reshape(2, 2)
        score = theta[-5] + np.bincount(token, theta[column_of], minlength=len(doc))
        expected, joint = marginals(score, first, moves, pairs=True)
        rest = label - expected
        slope = np.concatenate([
            np.bincount(column_of, rest[token], minlength=len(names)), [rest.sum()],
            (seen - joint).reshape(-1)]) / positives - RIDGE / 100 * theta
        mean = 0.9 * mean + 0.1 * slope
        spread = 0.99 * spread + 0.01 * slope ** 2
        theta += RATE * (mean / (1 - 0.9 ** k)) / (np.sqrt(spread / (1 - 0.99 ** k)) + 1e-8)
    chain = Chain(names, theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2), 1.0, 0.0)
    x = np.concatenate([chain.evidence(t)[1] for _, t in slices(column, True, _GAPS)])
    y = toxic.astype(float)
    # Calibration: logistic regression on the log odds, kept from running away.
    a, b = 0.5, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([np.dot(y - p, x) - (a - 0.5), (y - p).sum() - 0.1 * b])
        h = np.array([[np.dot(w, x * x) + 1, np.dot(w, x)], [np.dot(w, x), w.sum() + 0.1]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(a + move[0], 0.05), b + move[1]
    chain.slope, chain.offset = float(a), float(b)
    return chain


def held_out(key: Column) -> Column:
    """Rows that never teach."""
    return F.crc32(key.cast("string")) % 3 == 1


def fitting(sizes: list[int], toxic: list[bool], limit: int) -> list[int]:
    """Places of the texts that the sample takes: in the order given, each that still fits.

    Texts of more than a sixteenth of ``limit`` come after the others, so that they do not
    take their room.  Where that leaves no toxic text, toxic ones come first, and get half
    the room; if none fits at all, there is nothing to learn from and this is an error.
    """
    def greedy(order: list[int], room: int) -> list[int]:
        taken = []
        for i in order:
            if sizes[i] <= room:
                room -= sizes[i]
                taken.append(i)
        return taken

    order = sorted(range(len(sizes)), key=lambda i: 16 * sizes[i] > limit)
    taken = greedy(order, limit)
    if any(toxic) and not any(toxic[i] for i in taken):
        bad = sorted((i for i in order if toxic[i]), key=lambda i: sizes[i])
        first = greedy(bad, limit // 2) or greedy(bad[:1], limit)
        if not first:
            raise ValueError("every toxic text of the sample is longer than sample_chars")
        left = limit - sum(sizes[i] for i in first)
        taken = first + greedy([i for i in order if not toxic[i]], left)
    return sorted(taken)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          label: str = "toxic", sample_docs: int = SAMPLE_DOCS,
          sample_chars: int = SAMPLE_CHARS) -> Chain:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    pool = (labels.where(F.col(key).isNotNull() & ~held_out(F.col(key))
                         & F.col(label).isNotNull())
            .groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_label")))
    hashed = [F.xxhash64("_key"), F.col("_key")]

    def texts_of(taught: DataFrame) -> DataFrame:
        found = (docs.where(F.col(text).isNotNull())
                 .join(F.broadcast(taught), F.col(key) == F.col("_key"))  # sample_docs at most
                 .groupBy("_key", "_label").agg(F.first(text).alias("_text")))
        return stage(found, "labelled")

    def rows_of(sample: DataFrame) -> list:  # sample_docs rows at most
        return sample.select("_key", "_label", F.length("_text").alias("_size")) \
            .orderBy(*hashed).collect()

    sample = texts_of(pool.orderBy(*hashed).limit(sample_docs))
    listed = rows_of(sample)
    if not any(r._label > 0 for r in listed):  # toxic rows are rarer than one in the sample
        bad, good = (pool.where(c).orderBy(*hashed) for c in ("_label > 0", "_label <= 0"))
        half = max(sample_docs // 2, 1)
        sample = texts_of(bad.limit(half).unionByName(good.limit(sample_docs - half)))
        listed = rows_of(sample)
    taken = fitting([r._size for r in listed], [r._label > 0 for r in listed], sample_chars)
    fits = docs.sparkSession.createDataFrame([(listed[i]._key,) for i in taken],
                                             sample.select("_key").schema)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_key", kind="stable")
        chain = fit(rows["_text"].tolist(), rows["_label"].to_numpy() > 0)
        head = [chain.bias, *chain.moves.reshape(-1), chain.slope, chain.offset]
        return pd.DataFrame({
            "name": np.concatenate([np.arange(len(head)), chain.names.view(np.int64)]),
            "head": [True] * len(head) + [False] * len(chain.names),
            "weight": np.concatenate([head, chain.weights])})

    model = (sample.join(F.broadcast(fits), "_key").groupBy(F.lit("all").alias("one"))
             .applyInPandas(run, "name long, head boolean, weight double").toPandas())
    if not len(model):
        return Chain(np.zeros(0, np.uint64), np.zeros(0), -30.0, np.zeros((2, 2)), 0.0, -30.0)
    head = model[model["head"]].sort_values("name")["weight"].to_numpy()
    body = model[~model["head"]]
    names = body["name"].to_numpy().view(np.uint64)
    order = np.argsort(names)
    return Chain(names[order], body["weight"].to_numpy()[order], head[0],
                 head[1:5].reshape(2, 2), head[5], head[6])


def score(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, spans): spans are (start, end) in code points, end exclusive."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = [], []
            for _, texts in slices(batch.column(1), fold=True, gaps=_GAPS):
                marginal, evidence = chain.evidence(texts)
                scores.append(chain.scores(evidence))
                found: list[list] = [[] for _ in range(texts.count)]
                hit = np.flatnonzero(marginal >= SPAN_AT)
                if len(hit):
                    points = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
                    owner = texts.word_text[hit]
                    base = points[texts.bounds[owner]]
                    for i, a, b in zip(owner.tolist(),
                                       (points[texts.word_start[hit]] - base).tolist(),
                                       (points[texts.word_end[hit]] - base).tolist()):
                        found[i].append({"start": a, "end": b})
                spans.extend(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0)),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                [key, "score", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, score double, spans array<struct<start:long,end:long>>")
