"""Quality rules as a short-circuit cascade.

Each rule is a vectorised predicate over a :class:`TextBlock`.  On a bounded
sample every rule's cost (seconds per byte) and rejection rate are measured;
rules then run in decreasing order of rejection per cost, and a document that
one rule rejects is not shown to the next.  A verdict is a conjunction and the
reason reported is the first in the rules' given order, so neither depends on the
measured order; only the work does.  Counts that several rules or the report use
are computed once a block.

Nulls, empty texts and empty tables: a null text is the empty text, which has no
words and is rejected by ``min_words``; an empty table gives an empty table.
Repeated rows each get their own verdict.  Extra columns are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlattice.llm.storage import small_batches
from flowlattice.llm.textkernel import TextBlock, text_blocks

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


def measured_once(measure: Callable[[TextBlock], np.ndarray]) -> Callable[[TextBlock], np.ndarray]:
    """A count per document that a block remembers, so rules and reports that share it compute it once."""

    def get(block: TextBlock) -> np.ndarray:
        held = block.__dict__.setdefault("_measured", {})
        if measure.__name__ not in held:
            held[measure.__name__] = measure(block)
        return held[measure.__name__]

    get.__name__, get.__doc__ = measure.__name__, measure.__doc__
    return get


def _repeats(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry (in document order): is its key found again in its document; is it a later occurrence."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[order[1:]] == keys[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    grouped = same.copy()
    grouped[:-1] |= same[1:]
    again[order], later[order] = grouped, same
    return again, later


@measured_once
def word_chars(block: TextBlock) -> np.ndarray:
    """Code points in words."""
    return block.per_doc(block.lead & ~block._space)


@measured_once
def n_symbols(block: TextBlock) -> np.ndarray:
    """Characters of ``[#*$%&|<>]``."""
    return block.per_doc(_IS_SYMBOL[block.buf])


@measured_once
def n_lines(block: TextBlock) -> np.ndarray:
    """Lines with a word."""
    return np.bincount(block.lines[0], minlength=block.n)


@measured_once
def n_dup_lines(block: TextBlock) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same document."""
    doc, ids = block.lines
    return np.bincount(doc[_repeats(ids, doc)[1]], minlength=block.n).astype(np.int64)


@measured_once
def n_repeat_words(block: TextBlock) -> np.ndarray:
    """Words covered by a 3-word window found twice or more in the document."""
    first, ids = block.trigrams()
    again, _ = _repeats(ids, block.doc_of_word[first])
    covered = np.zeros(len(block.starts) + 2, bool)
    for shift in range(3):
        covered[first[again] + shift] = True
    return block.per_doc_words(covered[: len(block.starts)])


@measured_once
def n_shouted_words(block: TextBlock) -> np.ndarray:
    """Words of two or more ASCII letters, all of them capitals."""
    upper = np.concatenate([[0], np.cumsum(_UPPER[block.buf])])
    lower = np.concatenate([[0], np.cumsum(_LOWER[block.buf])])
    ups = upper[block.ends] - upper[block.starts]
    return block.per_doc_words((ups >= 2) & (lower[block.ends] == lower[block.starts]))


@measured_once
def n_alpha_words(block: TextBlock) -> np.ndarray:
    """Words with an ASCII letter or a character beyond ASCII."""
    letter = np.concatenate([[0], np.cumsum(_UPPER[block.buf] | _LOWER[block.buf] | (block.buf >= 128))])
    return block.per_doc_words(letter[block.ends] > letter[block.starts])


@dataclass(frozen=True)
class Rule:
    """``rejects(block)`` marks the documents of a block that the rule rejects."""

    name: str
    rejects: Callable[[TextBlock], np.ndarray]


def default_rules(
    min_words: int = 50,
    max_repeat_share: float = 0.5,
    max_symbols_per_word: float = 0.1,
    max_shouted_share: float = 0.2,
    max_dup_line_share: float = 0.5,
    min_alpha_share: float = 0.6,
    mean_word_chars: tuple[float, float] = (2.0, 20.0),
) -> list[Rule]:
    """The production rules; every threshold is a parameter."""
    low, high = mean_word_chars

    def word_length(block: TextBlock) -> np.ndarray:
        chars = word_chars(block)
        return (chars < low * block.n_words) | (chars > high * block.n_words)

    def dup_lines(block: TextBlock) -> np.ndarray:
        return n_dup_lines(block) > max_dup_line_share * n_lines(block)

    return [
        Rule("min_words", lambda b: b.n_words < min_words),
        Rule("symbols", lambda b: n_symbols(b) > max_symbols_per_word * b.n_words),
        Rule("shouting", lambda b: n_shouted_words(b) > max_shouted_share * b.n_words),
        Rule("word_length", word_length),
        Rule("alphabetic", lambda b: n_alpha_words(b) < min_alpha_share * b.n_words),
        Rule("dup_lines", dup_lines),
        Rule("repetition", lambda b: n_repeat_words(b) > max_repeat_share * b.n_words),
    ]


def measure(rules: Sequence[Rule], texts: Sequence[str | None], repeats: int = 3) -> list[tuple[str, float, float]]:
    """(name, seconds per byte, share rejected) of each rule alone on sample texts; the least time of a few."""
    array = pa.array(list(texts), pa.large_string())
    size = max(1, sum(len(t.encode()) for t in texts if t))
    found = []
    for rule in rules:
        took = []
        for _ in range(repeats):
            block = TextBlock(array)
            began = time.process_time()
            rejected = rule.rejects(block)
            took.append(time.process_time() - began)
        found.append((rule.name, max(min(took), 1e-6) / size, float(rejected.mean()) if len(texts) else 0.0))
    return found


def order_rules(rules: Sequence[Rule], measured: Sequence[tuple[str, float, float]]) -> list[Rule]:
    """Rules by rejection per cost, best first; ties keep the given order."""
    gain = {name: share / cost for name, cost, share in measured}
    return sorted(rules, key=lambda r: -gain[r.name])


def plan_cascade(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", sample_rows: int = 256, sample_chars: int = 20_000, one_in: int = 16) -> list[Rule]:
    """Order rules by a bounded sample: ``sample_rows`` texts, cut to ``sample_chars``, of the one text in ``one_in`` that a hash picks.

    The sample only sets the order of evaluation; verdicts use whole texts of all rows.
    """
    text = F.col(f"`{text_col}`")
    picked = docs.where(F.pmod(F.xxhash64(text, F.lit(17)), F.lit(one_in)) == 0).select(F.substring(text, 1, sample_chars)).limit(sample_rows).collect()
    return order_rules(rules, measure(rules, [r[0] for r in picked]))


def run_cascade(block: TextBlock, rules: Sequence[Rule]) -> np.ndarray:
    """Which documents pass all rules; a document that one rule rejects is not shown to the next."""
    alive, current = np.arange(block.n), block
    for rule in rules:
        if not len(alive):
            break
        rejected = rule.rejects(current)
        if rejected.any():
            alive = alive[~rejected]
            current = _Subset(current, ~rejected)
    kept = np.zeros(block.n, bool)
    kept[alive] = True
    return kept


def first_rejection(block: TextBlock, kept: np.ndarray, rules: Sequence[Rule]) -> list[str | None]:
    """Name of the first rule, in the given order, that rejects each document; only rejected ones are looked at."""
    out: list[str | None] = [None] * block.n
    left = np.flatnonzero(~kept)
    current = _Subset(block, ~kept)
    for rule in rules:
        if not len(left):
            break
        rejected = rule.rejects(current)
        for k in left[rejected].tolist():
            out[k] = rule.name
        left, current = left[~rejected], _Subset(current, ~rejected)
    return out


class _Subset(TextBlock):
    """The kept documents of a block, with the word index and the counts already found."""

    def __init__(self, parent: TextBlock, keep: np.ndarray):
        lengths = np.diff(parent.offsets)
        self.buf = parent.buf[np.repeat(keep, lengths)]
        self.n = int(keep.sum())
        self.offsets = np.concatenate([[0], np.cumsum(lengths[keep])]).astype(np.int64)
        if "_spans" in parent.__dict__:
            words = np.repeat(keep, parent.n_words)
            shift = np.repeat((parent.offsets[:-1][keep] - self.offsets[:-1]), parent.n_words[keep])
            self.__dict__["_spans"] = (parent.starts[words] - shift, parent.ends[words] - shift)
            if "_words" in parent.__dict__:
                self.__dict__["_words"] = (parent.vocabulary, parent.word_ids[words])
        self._measured = {k: v[keep] for k, v in parent.__dict__.get("_measured", {}).items()}


STATS = {"word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", reasons: bool = True) -> DataFrame:
    """(doc_id, kept, rejected_by): the cascade's verdict and, with ``reasons``, the first rule in the given order that rejects.

    Neither depends on the measured order, which only changes the work.
    """
    return _judge(docs, rules, id_col, text_col, reasons, with_stats=False)


def judge_with_stats(docs: DataFrame, rules: Sequence[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", reasons: bool = True) -> DataFrame:
    """The cascade's verdict beside the five base counts of every document; rules reuse those counts."""
    return _judge(docs, rules, id_col, text_col, reasons, with_stats=True)


def _judge(docs: DataFrame, rules: Sequence[Rule] | None, id_col: str, text_col: str, reasons: bool, with_stats: bool) -> DataFrame:
    given = rules or default_rules()
    ordered = plan_cascade(docs, given, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in text_blocks(batch, "text"):
                out = {"doc_id": rows.column(0)}
                if with_stats:
                    out["n_words"] = pa.array(block.n_words, pa.int64())
                    out |= {k: pa.array(f(block), pa.int64()) for k, f in STATS.items()}
                kept = run_cascade(block, ordered)
                out["kept"] = pa.array(kept)
                if reasons:
                    out["rejected_by"] = pa.array(first_rejection(block, kept, given), pa.string())
                yield pa.RecordBatch.from_pydict(out)

    stats = "n_words long, " + "".join(f"{k} long, " for k in STATS) if with_stats else ""
    schema = f"doc_id long, {stats}kept boolean" + (", rejected_by string" if reasons else "")
    return small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)


def filter_documents(docs: DataFrame, rules: Sequence[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The rows (all columns) that no rule rejects, in one pass and without a shuffle."""
    ordered = plan_cascade(docs, rules or default_rules(), text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.rename_columns([str(i) for i in range(batch.num_columns)])
            for rows, block in text_blocks(named, str(at)):
                yield rows.filter(pa.array(run_cascade(block, ordered))).rename_columns(batch.schema.names)

    return small_batches(docs).mapInArrow(run, docs.schema)
