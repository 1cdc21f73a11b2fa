"""Language identification by word-first backoff.

A document's words are scored one by one.  A word known from training gets its
log frequency in each language.  An unseen word falls back to its character
n-grams of the highest order, then the next shorter, until an order has a known
n-gram; its score is their mean log frequency.  The sum over all words decides.

Training reads the whole texts of about ``docs_per_language`` documents of each
language (all, if there are fewer), those whose keyed hash lies below the share
asked for, so nothing is ranked; words and n-grams seen fewer than ``min_count``
times are left out, so the model is bounded by the sample and not by the corpus.  Scoring is one pass without a shuffle and scores each distinct
word of a block once.

A text that is null or has no letter is ``und`` with score 0.  Without training
rows every text is ``und``.  Rows that share an id and a language count as one training
document, their greatest text.  Ties go to the language that sorts first.  Repeated
rows are scored each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlattice.llm.rows import drawn, one_per_id
from flowlattice.llm.storage import small_batches
from flowlattice.llm.textkernel import TextBlock, text_blocks
from flowlattice.llm.workers import kept

UNKNOWN = "und"
ORDERS = (5, 4, 3, 2, 1)
_LETTERS = regex.compile(r"\p{L}+")
_CACHE = 150_000


def letter_runs(word: str) -> list[str]:
    """Lower-cased runs of letters in a word."""
    return [word.lower()] if word.isalpha() else [r.lower() for r in _LETTERS.findall(word)]


def ngrams(run: str, order: int) -> list[str]:
    """Character n-grams of a run; orders above 1 see its borders."""
    if order == 1:
        return list(run)
    marked = f"^{run}$"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


@dataclass
class Model:
    """Log frequencies per language of known words and of the n-grams of each order."""

    languages: list[str]
    words: dict[str, np.ndarray]
    grams: dict[int, dict[str, np.ndarray]]
    token: str = field(default_factory=lambda: uuid.uuid4().hex)  # tells fitted models apart

    def run_score(self, run: str) -> np.ndarray | None:
        """Score of a run of letters, None if nothing of it is known."""
        known = self.words.get(run)
        if known is not None:
            return known
        for order in ORDERS:
            table = self.grams[order]
            found = [table[g] for g in ngrams(run, order) if g in table]
            if found:
                return sum(found) / len(found)
        return None


def _log_table(counts: dict[str, dict[str, int]], languages: list[str], alpha: float = 0.5) -> dict[str, np.ndarray]:
    at = {lang: i for i, lang in enumerate(languages)}
    totals = np.zeros(len(languages))
    for per_language in counts.values():
        for lang, n in per_language.items():
            totals[at[lang]] += n
    out = {}
    for key, per_language in counts.items():
        row = np.full(len(languages), alpha)
        for lang, n in per_language.items():
            row[at[lang]] += n
        out[key] = np.log(row / (totals + alpha * (len(counts) + 1)))
    return out


def train(docs: DataFrame, lang_col: str = "lang", docs_per_language: int = 1500, min_count: int = 3, seed: int = 8) -> Model:
    """Fit on (doc_id, text, lang) rows; rows with a null language are not used."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("lang IS NOT NULL AND doc_id IS NOT NULL")
    chosen = one_per_id(drawn(labelled, docs_per_language, seed, ["lang"]), ["lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 200) for whole in batches for at in range(0, whole.num_rows, 200)):  # bounds the counters
            words: Counter = Counter()
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                for word, n in Counter((text or "").split()).items():
                    for run in letter_runs(word):
                        words[lang, 0, run] += n
            found = Counter(words)
            for (lang, _, run), n in words.items():
                for k in ORDERS:
                    for gram in ngrams(run, k):
                        found[lang, k, gram] += n
            rows = list(found.items())
            for at in range(0, len(rows), 50_000):
                part = rows[at : at + 50_000]
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([k[0] for k, _ in part], pa.string()), "ord": pa.array([k[1] for k, _ in part], pa.int32()),
                    "key": pa.array([k[2] for k, _ in part], pa.string()), "n": pa.array([n for _, n in part], pa.int64()),
                })

    counted = chosen.select("text", "lang").mapInArrow(count, "lang string, ord int, key string, n long")
    rows = counted.groupBy("lang", "ord", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).collect()
    languages = sorted({r.lang for r in rows})
    tables: dict[int, dict[str, dict[str, int]]] = {k: {} for k in (0, *ORDERS)}
    for r in rows:
        tables[r.ord].setdefault(r.key, {})[r.lang] = r.n
    return Model(languages, _log_table(tables[0], languages), {k: _log_table(tables[k], languages) for k in ORDERS})


class Scorer:
    """Scores blocks; remembers the scores of words it has seen, by the words themselves."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[bytes, tuple[np.ndarray, bool]] = {}

    def _word(self, word: bytes) -> tuple[np.ndarray, bool]:
        runs = letter_runs(word.decode())
        total = np.zeros(len(self.model.languages))
        for run in runs:
            score = self.model.run_score(run)
            if score is not None:
                total += score
        return total, bool(runs)

    def scores(self, block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
        """(sum of word scores per document and language, whether it has a letter)."""
        words, n = block.vocabulary.to_pylist(), len(self.model.languages)
        if not words:
            return np.zeros((block.n, n)), np.zeros(block.n, bool)
        if len(self.known) + len(words) > _CACHE:
            self.known = {}
        found = []
        for word in words:
            row = self.known.get(word)
            if row is None:
                row = self.known[word] = self._word(word)
            found.append(row)
        table = np.array([r for r, _ in found]).reshape(len(words), n)
        letters = np.array([x for _, x in found], bool)
        doc, inverse = block.doc_of_word, block.word_ids
        total = np.stack([np.bincount(doc, weights=table[inverse, j], minlength=block.n) for j in range(n)], axis=1) if n else np.zeros((block.n, 0))
        return total, np.bincount(doc, weights=letters[inverse], minlength=block.n) > 0


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every document's whole text.

    The score is the softmax of the mean word score times the square root of the
    number of words, a damped posterior between 0 and 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept("langid", model.token, lambda: Scorer(model))
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for rows, block in text_blocks(batch, "text"):
                total, letters = scorer.scores(block)
                n = len(model.languages)
                known = letters & (n > 0)
                z = total / np.sqrt(np.maximum(block.n_words, 1))[:, None]
                best = np.where(known, z.argmax(axis=1) if n else n, n)
                p = np.exp(z - z.max(axis=1, keepdims=True)) if n else z
                score = np.where(known, p.max(axis=1) / p.sum(axis=1), 0.0) if n else np.zeros(block.n)
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "lang_pred": pa.array(names[best].tolist(), pa.string()), "score": pa.array(score)})

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
