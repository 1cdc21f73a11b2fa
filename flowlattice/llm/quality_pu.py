"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text give an unbiased estimate of the
classification risk, ``pi R_P(+) + R_U(-) - pi R_P(-)``; its negative part is
kept from falling below zero (non-negative risk), by stepping against the
gradient of that part where it does.  The class prior ``pi`` is estimated first,
as the least ratio of unlabelled to positive mass above a score.

The model is logistic over hashed n-grams (words, pairs of words and triples of
characters of the whole text, lower-cased, as roots of counts of unit length)
beside a few counts per document, cut into quantile bins.  It is fitted on
bounded samples, about ``max_positive`` and ``max_unlabelled`` rows that a keyed
hash picks; scoring reads every whole text in one pass without a shuffle.

A null text is the empty text and gets a score.  Repeated rows are scored each;
in training, rows that share an id count as one, their greatest text.  Without
positives or unlabelled rows every score is the prior given (0.5).  An empty table
gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlattice.llm.quality_rules import n_alpha_words, n_dup_lines, n_lines, n_repeat_words, n_shouted_words, n_symbols, word_chars
from flowlattice.llm.rows import drawn, one_per_id
from flowlattice.llm.storage import small_batches
from flowlattice.llm.textkernel import TextBlock, mix, text_blocks

_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_DIGIT = np.array([48 <= c <= 57 for c in range(256)])
_PUNCTUATION = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
COUNTS = ["log_words", "mean_chars", "symbols", "shouted", "repeats", "dup_lines", "alpha", "distinct", "adjacent", "upper", "line_words", "digits", "punctuation"]
#: Number of buckets of each kind of hashed n-gram.
HASHED = {"word": 1024, "pair": 512, "chars": 512}
WIDTH = sum(HASHED.values())
_DOCS_AT_ONCE = 2048


def counts_of(block: TextBlock) -> np.ndarray:
    """One row of :data:`COUNTS` per document."""
    n = np.maximum(block.n_words, 1).astype(np.float64)
    chars = word_chars(block)
    lines = np.maximum(n_lines(block), 1)
    doc, ids = block.doc_of_word, block.word_ids
    seen = np.unique(doc * max(1, len(block.vocabulary)) + ids)
    distinct = np.bincount(seen // max(1, len(block.vocabulary)), minlength=block.n)
    same = np.zeros(len(doc), bool)
    same[1:] = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
    columns = [
        np.log1p(block.n_words),
        chars / n,
        n_symbols(block) / n,
        n_shouted_words(block) / n,
        n_repeat_words(block) / n,
        n_dup_lines(block) / lines,
        n_alpha_words(block) / n,
        distinct / n,
        block.per_doc_words(same) / n,
        block.per_doc(_UPPER[block.buf]) / np.maximum(chars, 1),
        n / lines,
        block.per_doc(_DIGIT[block.buf]) / np.maximum(chars, 1),
        block.per_doc(_PUNCTUATION[block.buf]) / np.maximum(chars, 1),
    ]
    return np.stack(columns, axis=1)


def ngrams_of(block: TextBlock) -> list[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of every n-gram of the lower-cased words, one pair of arrays per kind."""
    kept = ~block._space
    data = block.buf[kept]
    data = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    lengths = block.ends - block.starts
    # a word's number is the sum of its mixed bytes and places: cheap, and it only picks a bucket
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(first, lengths).astype(np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(data.astype(np.uint64) + (place << np.uint64(8))))])
    word = mix(total[first + lengths] - total[first])
    doc = block.doc_of_word
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    code = data.astype(np.uint64)
    end = np.repeat(first + lengths, lengths)
    three = np.flatnonzero(np.arange(len(data)) + 2 < end)
    chars = mix(code[three] << np.uint64(16) | code[three + 1] << np.uint64(8) | code[three + 2])
    found = [(doc, word), (pair, mix(word[pair] * np.uint64(3) + word[pair + 1])), (np.repeat(doc, lengths)[three], chars)]
    found[1] = (doc[pair], found[1][1])
    return [(d, (h & np.uint64(size - 1)).astype(np.int64)) for (d, h), size in zip(found, HASHED.values(), strict=True)]


def hashed_of(block: TextBlock) -> Iterator[tuple[int, np.ndarray]]:
    """(first document, matrix of hashed n-grams) for runs of documents of a block."""
    grams = ngrams_of(block)
    for start in range(0, block.n, _DOCS_AT_ONCE):
        n = min(_DOCS_AT_ONCE, block.n - start)
        parts = []
        for (doc, bucket), size in zip(grams, HASHED.values(), strict=True):
            a, b = np.searchsorted(doc, [start, start + n])
            root = np.sqrt(np.bincount((doc[a:b] - start) * size + bucket[a:b], minlength=n * size).reshape(n, size))
            parts.append(root / np.maximum(np.sqrt((root * root).sum(axis=1, keepdims=True)), 1.0))
        yield start, np.concatenate(parts, axis=1).astype(np.float32)


@dataclass
class Model:
    """Bin edges per count, weights per bin and per hashed n-gram, and the class prior."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Cumulative bin indicators: count j is above its edge k."""
        return (x[:, :, None] > self.edges[None]).reshape(len(x), -1).astype(np.float32)

    def logits(self, counts: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        n = self.edges.size
        return self.expand(counts) @ self.weights[:n] + hashed @ self.weights[n:] + self.bias

    def scores(self, block: TextBlock) -> np.ndarray:
        counts = counts_of(block)
        out = [self.logits(counts[at : at + len(hashed)], hashed) for at, hashed in hashed_of(block)]
        return _sigmoid(np.concatenate(out) if out else np.zeros(0))


def _adam(size: int, gradient, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least_mass: float = 0.7) -> float:
    """Least ratio of unlabelled to positive mass at or above a score, where positive mass is at least ``least_mass``.

    Above any score the ratio is at least the prior in expectation, so its least value
    bounds the prior from above; below ``least_mass`` the shares are too noisy for a
    minimum of 60.  Half a standard error is taken off, since a prior that is too high
    leaves negatives undecided.  The scores must come from a fit on other rows.
    """
    cuts = np.quantile(positive, np.linspace(0, 1 - least_mass, 60))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    spread = 1.0 / np.sqrt(len(positive)) + 1.0 / np.sqrt(len(unlabelled))
    return float(np.clip(np.min(u / p) - 0.5 * spread, 0.02, 0.98))


def negative_risk(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> float:
    """Estimate of the risk on negatives, which can fall below zero on samples."""
    return float(np.logaddexp(0, xu @ w).mean() - prior * np.logaddexp(0, xp @ w).mean())


def nn_risk(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> float:
    """Non-negative unbiased risk with logistic loss."""
    return float(prior * np.logaddexp(0, -(xp @ w)).mean() + max(0.0, negative_risk(w, xp, xu, prior)))


def nn_step(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> np.ndarray:
    """Gradient of the risk; where its negative part is below zero, the way back up that part alone."""
    zp, zu = xp @ w, xu @ w
    sp, su = _sigmoid(zp), _sigmoid(zu)
    back = xu.T @ (su / len(xu)) - xp.T @ (prior * sp / len(xp))
    if np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() < 0:
        return -back
    return xp.T @ (prior * (sp - 1) / len(xp)) + back


def fit(
    positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray], bins: int = 12, steps: int = 200, rate: float = 0.05, l2: float = 1e-3, prior: float | None = None
) -> Model:
    """Non-negative PU fit on (counts, hashed) matrices; the prior is estimated unless given."""
    both = np.concatenate([positive[0], unlabelled[0]])
    edges = np.quantile(both, np.concatenate([[0.001, 0.01], np.linspace(0, 1, bins + 2)[1:-1], [0.99, 0.999]]), axis=0).T
    model = Model(edges, np.zeros(0), 0.0, 0.5)

    def design(x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.hstack([model.expand(x[0]), x[1].astype(np.float32), np.ones((len(x[0]), 1), np.float32)])

    xp, xu = design(positive), design(unlabelled)
    if prior is None:  # a plain positive-against-unlabelled fit orders the rows by density ratio
        sp, su = np.zeros(len(xp)), np.zeros(len(xu))
        for half in (0, 1):  # each half is scored by a fit on the other one
            hp, hu = xp[1 - half :: 2], xu[1 - half :: 2]

            def ordinary(w: np.ndarray, hp: np.ndarray = hp, hu: np.ndarray = hu) -> np.ndarray:
                w = w.astype(np.float32)
                return l2 * w + hp.T @ ((_sigmoid(hp @ w) - 1) / max(1, len(hp))) + hu.T @ (_sigmoid(hu @ w) / max(1, len(hu)))

            w = _adam(xp.shape[1], ordinary, steps // 4, rate)
            sp[half::2], su[half::2] = xp[half::2] @ w, xu[half::2] @ w
        prior = estimate_prior(sp, su)
    w = _adam(xp.shape[1], lambda w: l2 * w + nn_step(w.astype(np.float32), xp, xu, prior), steps, rate)
    return Model(edges, w[:-1], float(w[-1]), prior)


def bucket(column: Column, modulus: int) -> Column:
    """crc32 of a number as text, modulo ``modulus``; null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def _feature_rows(docs: DataFrame, kind: str) -> DataFrame:
    """(kind, counts, hashed): the features as packed floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, block in text_blocks(batch, "text"):
                counts = counts_of(block).astype("<f8")
                for at, hashed in hashed_of(block):
                    part = counts[at : at + len(hashed)]
                    half = hashed.astype("<f2")
                    yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(part)), "counts": pa.array([r.tobytes() for r in part], pa.binary()), "hashed": pa.array([r.tobytes() for r in half], pa.binary())})

    return docs.select("text").mapInArrow(run, "kind string, counts binary, hashed binary")


def train(docs: DataFrame, positives: DataFrame, max_positive: int = 4000, max_unlabelled: int = 6000, seed: int = 5) -> Model:
    """Fit on the texts of sampled positive ids against sampled unlabelled documents (both bounded)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    ids = drawn(positives.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct(), max_positive, seed)
    p = one_per_id(texts.join(F.broadcast(ids), "doc_id", "left_semi"))  # about max_positive ids
    u = one_per_id(drawn(texts, max_unlabelled, seed + 1))
    rows = _feature_rows(p, "p").unionAll(_feature_rows(u, "u")).collect()  # about max_positive + max_unlabelled rows

    def matrices(kind: str) -> tuple[np.ndarray, np.ndarray]:
        own = [r for r in rows if r.kind == kind]
        counts = np.frombuffer(b"".join(r.counts for r in own), "<f8").reshape(-1, len(COUNTS))
        return counts, np.frombuffer(b"".join(r.hashed for r in own), "<f2").reshape(-1, WIDTH)

    positive, unlabelled = matrices("p"), matrices("u")
    if not len(positive[0]) or not len(unlabelled[0]):
        return Model(np.zeros((len(COUNTS), 1)), np.zeros(len(COUNTS) + WIDTH), 0.0, 0.5)
    return fit(positive, unlabelled)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every document's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in text_blocks(batch, "text"):
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "score": pa.array(model.scores(block).astype(np.float64))})

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
