"""Quality classifier from weak labels: no gold label is used.

1. Heuristic labellers vote on every document: bad, good, or no vote. Only the counts of vote
   patterns leave the tasks (at most 3 ** labellers rows, over all documents).
2. Expectation-maximisation on those counts estimates the shares of good documents and of kinds
   of bad ones and, for each labeller, how it votes on each. The labellers overlap and abstain;
   how far each is believed follows from how it agrees with the others. This gives each pattern
   its posterior.
3. The posteriors of a sample of documents - those with the smallest hashes of their text, at
   most about ``TRAIN_DOCS``, a documented bound - train a logistic scorer on hashed features:
   words, shapes of words (case, digits, symbols) and repeats of the word before.
4. Every document is scored by the linear scorer; below ``THRESHOLD`` it is
   rejected. Training weighs both classes alike, so the threshold is about the share of bad ones.

Broadcast are the weights (``SLOTS`` numbers) and the pattern posteriors, both of fixed size.

Defined results. A null or empty text has no words: no labeller votes, its
score is 0 and it is rejected. Repeated rows get the same
result. Very long texts are scored whole. An empty table gives an empty result. Extra columns
are carried; clashing ones are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from maskloom.llm import words as wd
from maskloom.llm.common import chunks, table, text_bytes

TRAIN_DOCS = 6000
THRESHOLD = 0.1
SHAPES, WORDS = 1024, 2048
SLOTS = SHAPES + WORDS + 2
CHUNK_BYTES = 1 << 19
EM_ROUNDS, TRAIN_ROUNDS, DECAY = 60, 300, 1e-4
#: What is known of labellers before any count: chances of a bad vote on good and on bad documents.
FLOOR, CEILING = (1e-4, 0.01), (0.02, 0.99)
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 88, 120, 57, 120
_UPPER, _LETTER, _SYMBOL = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_SYMBOL[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126]] = True

_ODD = np.zeros(256, bool)
_ODD[33:128] = True
_ODD[48:58] = _ODD[65:91] = _ODD[97:123] = _ODD[[33, 34, 39, 41, 44, 46, 58, 59, 63]] = False

#: Name, measure, bad from, good up to, fewest words for a vote.
LABELLERS = [
    ("shouting", "upper", 0.5, 0.2, 3),
    ("symbols", "symbols", 0.05, 0.01, 3),
    ("separators", "lone", 0.15, 0.03, 3),
    ("odd ends", "ends", 0.15, 0.03, 3),
    ("stutter", "repeats", 0.2, 0.05, 3),
    ("monotony", "sameness", 0.8, 0.6, 20),
    ("exclaiming", "bangs", 0.4, 0.1, 3),
    ("runs", "runs", 0.08, 0.02, 3),
]


class Chunk:
    """Words of a chunk with what labellers and scorer read from them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n = len(offsets) - 1
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.doc = wd.word_spans(data, offsets)
        self.hashes = wd.span_hashes(wd.prefix_hashes(wd.LOWER[data]), self.starts, self.ends) if len(data) else np.zeros(0, np.uint64)
        self.count = np.bincount(self.doc, minlength=self.n).astype(float)
        self.repeat = np.zeros(len(self.doc), bool)
        self.repeat[1:] = (self.hashes[1:] == self.hashes[:-1]) & (self.doc[1:] == self.doc[:-1])

    def _bytes(self, kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind[self.data])])
        return (sums[self.offsets[1:]] - sums[self.offsets[:-1]]).astype(float)

    def _bytes_same(self) -> np.ndarray:
        """Symbols that repeat the byte before, in each text."""
        same = np.zeros(len(self.data) + 1, np.int64)
        mark = _ODD | (np.arange(256) == 33)
        again = (self.data[1:] == self.data[:-1]) & mark[self.data[1:]]
        again[self.offsets[(self.offsets > 0) & (self.offsets < len(self.data))] - 1] = False
        same[2:] = np.cumsum(again)
        return (same[self.offsets[1:]] - same[self.offsets[:-1]]).astype(float)

    def _words(self, flag: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc[flag], minlength=self.n).astype(float)

    def measures(self) -> dict[str, np.ndarray]:
        words, solid = np.maximum(self.count, 1), np.maximum(self._bytes(~wd._BLANK), 1)
        last = self.data[self.ends - 1] if len(self.ends) else np.zeros(0, np.uint8)
        lone = (self.ends - self.starts == 1) & ~_LETTER[last] & (last < 128) & ~((last >= 48) & (last < 58))
        order = np.lexsort((self.hashes, self.doc))
        h, d = self.hashes[order], self.doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        bang = np.zeros(256, bool)
        bang[33] = True
        return {
            "upper": self._bytes(_UPPER) / np.maximum(self._bytes(_LETTER), 1),
            "symbols": self._bytes(_SYMBOL) / solid,
            "lone": self._words(lone) / words,
            "repeats": self._words(self.repeat) / words,
            "bangs": self._bytes(bang) / words,
            # Long texts repeat words more; the root leaves room for that.
            "sameness": 1 - np.bincount(d[new], minlength=self.n) / np.sqrt(words * np.minimum(words, 400)),
            "ends": self._words(_ODD[last]) / words,
            "runs": self._bytes_same() / solid,
        }

    def votes(self) -> np.ndarray:
        """One row per document: 2 bad, 1 good, 0 no vote."""
        found = self.measures()
        out = np.zeros((self.n, len(LABELLERS)), np.int64)
        for i, (_, measure, bad, good, least) in enumerate(LABELLERS):
            out[:, i] = np.where(self.count < least, 0, np.where(found[measure] >= bad, 2, np.where(found[measure] <= good, 1, 0)))
        return out

    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, slot, weight) of all words: weights of a document's words sum to one per kind."""
        shape = _CLASS[self.data]
        keep = np.ones(len(shape), bool)
        keep[1:] = shape[1:] != shape[:-1]
        keep[self.starts] = True
        at = np.concatenate([[0], np.cumsum(keep)])
        shapes = wd.span_hashes(wd.prefix_hashes(shape[keep]), at[self.starts], at[self.ends]) if len(self.starts) else self.hashes
        share = 1 / np.maximum(self.count, 1)[self.doc]
        slot = [(shapes % np.uint64(SHAPES)).astype(np.int64), SHAPES + (self.hashes % np.uint64(WORDS)).astype(np.int64), np.where(self.repeat, SLOTS - 2, SLOTS - 1)]
        return np.tile(self.doc, 3), np.concatenate(slot), np.tile(share, 3)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Chunk]]:
    for batch in batches:
        for first, last, data, offsets in chunks(batch, "__text", CHUNK_BYTES):
            yield batch.slice(first, last - first), Chunk(data, offsets)


def _pattern(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, chunk in _chunked(batches):
        found, counts = np.unique(_pattern(chunk.votes()), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], ["pattern", "docs"])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, chunk in _chunked(batches):
        doc, slot, weight = chunk.slots()
        keys, at = np.unique(doc * SLOTS + slot, return_inverse=True)
        sums = np.bincount(at, weights=weight, minlength=len(keys))
        ends = np.searchsorted(keys, np.arange(1, chunk.n) * SLOTS)
        slots = [x.astype(np.int32).tobytes() for x in np.split(keys % SLOTS, ends)]
        sums = [x.astype(np.float32).tobytes() for x in np.split(sums, ends)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_pattern(chunk.votes())), pa.array(slots, pa.binary()), pa.array(sums, pa.binary())], ["hash", "pattern", "slots", "weights"])


def estimate(patterns: dict[int, int], rounds: int = EM_ROUNDS) -> tuple[dict[int, float], np.ndarray, np.ndarray]:
    """Posterior of "bad" for each vote pattern; chance of a bad vote (labeller, class); class shares.

    Class 0 is good; each labeller begins a class of its own for the kind of bad document that it
    is made for, so that one kind's labellers need not agree with another's. Votes that are not
    given say nothing: short texts get few votes, and that is no class.
    """
    n = len(LABELLERS)
    tables = np.full((n, 1 + n), 0.1)
    tables[:, 0] = CEILING[0]
    tables[np.arange(n), 1 + np.arange(n)] = 0.9
    shares = np.append(0.8, np.full(n, 0.2 / n))
    if not patterns:
        return {}, tables, shares
    codes = np.array(sorted(patterns))
    docs = np.array([patterns[c] for c in codes.tolist()], float)
    votes = codes[:, None] // 3 ** np.arange(n) % 3
    bad_vote, voted = (votes == 2).astype(float), (votes > 0).astype(float)
    low, high = (np.append(x[0], np.full(n, x[1])) for x in (FLOOR, CEILING))
    for _ in range(rounds):
        logs = bad_vote @ np.log(tables) + (voted - bad_vote) @ np.log(1 - tables) + np.log(shares)
        each = np.exp(logs - logs.max(axis=1, keepdims=True))
        each /= each.sum(axis=1, keepdims=True)
        weight = docs[:, None] * each
        tables = np.clip((bad_vote.T @ weight + 0.02) / (voted.T @ weight + 1), low, high)
        shares = (weight.sum(axis=0) + 0.1) / (docs.sum() + 0.1 * (1 + n))
    return dict(zip(codes.tolist(), (1 - each[:, 0]).tolist())), tables, shares


def train(documents: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, rounds: int = TRAIN_ROUNDS) -> np.ndarray:
    """Logistic scorer on soft labels; the last weight is the bias. Steps follow Adam's rule."""
    weights = np.zeros(SLOTS + 1)
    if not documents:
        return weights
    row = np.repeat(np.arange(len(documents)), [len(s) for s, _ in documents])
    slot = np.concatenate([s for s, _ in documents]).astype(np.int64)
    value = np.concatenate([v for _, v in documents]).astype(float) * 10
    # Both classes weigh the same, whatever their shares.
    balance = np.where(good > 0.5, 0.5 / max((good > 0.5).mean(), 1e-3), 0.5 / max((good <= 0.5).mean(), 1e-3)) / len(good)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        score = np.bincount(row, weights=weights[slot] * value, minlength=len(good)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(score, -60, 60))) - good) * balance
        slope = np.append(np.bincount(slot, weights=error[row] * value, minlength=SLOTS), error.sum()) + DECAY * np.append(weights[:-1], 0)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        weights -= 0.05 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return weights


def _scored(weights: np.ndarray, posterior: dict[int, float], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in _chunked(batches):
            doc, slot, share = chunk.slots()
            raw = np.bincount(doc, weights=weights[slot] * share * 10, minlength=chunk.n) + weights[-1]
            score = np.where(chunk.count > 0, 1 / (1 + np.exp(-np.clip(raw, -60, 60))), 0.0)
            votes = chunk.votes()
            bad = np.array([posterior.get(p, 0.5) for p in _pattern(votes).tolist()])
            said = ["".join("-+!"[v] for v in row) for row in votes.tolist()]
            columns = [c for c, n in zip(batch.columns, batch.schema.names) if n != "__text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(said, pa.string()), pa.array(bad, pa.float64()), pa.array(score, pa.float64()), pa.array(score >= THRESHOLD, pa.bool_())], [*names, "votes", "p_bad", "score", "keep"])

    return run


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, dict[int, float], np.ndarray]:
    """Weights of the scorer, posteriors of vote patterns, the labellers' vote tables."""
    texts = docs.select(F.xxhash64(text_bytes()).alias("hash"), text_bytes().alias("__text"))
    counted = texts.select("__text").mapInArrow(_patterns, "pattern long, docs long").groupBy("pattern").agg(F.sum("docs").alias("docs"))
    patterns = {r.pattern: r.docs for r in counted.collect()}
    posterior, tables, _ = estimate(patterns)
    total = sum(patterns.values())
    sample = texts
    if total > train_docs:  # a hash range that holds about so many of all rows
        sample = texts.where(F.shiftrightunsigned("hash", 1) < int(2.0**63 * train_docs / total))
    rows = sample.mapInArrow(_featured, "hash long, pattern long, slots binary, weights binary")
    rows = rows.dropDuplicates(["hash"]).sort("hash").limit(2 * train_docs).collect()
    documents = [(np.frombuffer(r.slots, np.int32), np.frombuffer(r.weights, np.float32)) for r in rows]
    good = np.array([1 - posterior[r.pattern] for r in rows])
    return train(documents, good), posterior, tables


def classify(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Add votes, p_bad (posterior of the votes), score (of the linear scorer) and keep."""
    clash = {"votes", "p_bad", "score", "keep", "__text"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    weights, posterior, _ = fit(docs, train_docs)
    added = [("votes", T.StringType()), ("p_bad", T.DoubleType()), ("score", T.DoubleType()), ("keep", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in added]])
    return docs.withColumn("__text", text_bytes()).mapInArrow(_scored(weights, posterior, docs.columns), schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs).select("doc_id", "votes", "p_bad", "score", "keep")
