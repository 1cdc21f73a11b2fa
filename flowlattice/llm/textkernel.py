"""Vectorised text primitives over Arrow string columns.

A :class:`TextBlock` is a bounded slice of documents as one UTF-8 byte buffer.
Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; in UTF-8 these
ASCII bytes never occur inside another character, so byte spans are exact.

Inside a block words and lines are told apart by their whole content: Arrow's
dictionary encoding gives each distinct value a number.  Across blocks and tasks
a word is its keyed 128-bit BLAKE2b digest, taken once per distinct word of a
block, and a window is joined from shorter ones by a non-linear mixer on both
64-bit lanes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_KEY = b"flowlattice word"
_LEFT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_RIGHT = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (shift, xor, multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated index ranges start..start+length-1."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - first, lengths)


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]]; empty segments give 0."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype == np.uint64 else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def intern(data: np.ndarray, lengths: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(distinct values, number of each value) of byte strings that stand one after another in ``data``.

    The encoder compares whole values, so two strings share a number only if they are equal.
    """
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = values.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def digests(values: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two 64-bit halves of each value's keyed 128-bit digest."""
    raw = b"".join([hashlib.blake2b(v, digest_size=16, key=_KEY).digest() for v in values])
    both = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


#: One or two 64-bit hashes of each window.
Lanes = tuple[np.ndarray, ...]


def joined(left: Lanes, right: Lanes) -> Lanes:
    """Hashes of two neighbouring (or overlapping) windows taken together, lane by lane."""
    return tuple(mix(mix(a ^ _LEFT[i]) + b * _RIGHT[i]) for i, (a, b) in enumerate(zip(left, right, strict=True)))


def window_lanes(word_lanes: Lanes, sizes: Sequence[int]) -> list[Lanes]:
    """For each size (ascending), the hash of every run of so many words (across documents too), 64 bits a lane.

    A window of 2n words is two windows of n; other sizes are two that overlap.
    """

    def shifted(lanes: Lanes, by: int) -> Lanes:
        n = max(0, len(lanes[0]) - by)
        return joined(tuple(x[:n] for x in lanes), tuple(x[len(x) - n :] for x in lanes))

    out, whole, width = [], word_lanes, 1
    for size in sizes:
        while 2 * width <= size:
            whole, width = shifted(whole, width), 2 * width
        out.append(shifted(whole, size - width) if size > width else whole)
    return out


class TextBlock:
    """Documents of one slice: bytes, document offsets and, lazily, words and lines."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        self.texts = texts
        _, offsets, data = texts.buffers()
        raw = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        self.n = len(texts)
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        self.buf = whole[raw[0] : raw[-1]]
        self.offsets = raw - raw[0]

    @cached_property
    def _space(self) -> np.ndarray:
        return _SPACE[self.buf]

    @cached_property
    def _spans(self) -> tuple[np.ndarray, np.ndarray]:
        word = ~self._space
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        # a document border also separates words
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(word))]
        begin[cut] = word[cut]
        end[cut - 1] = word[cut - 1]
        return np.flatnonzero(begin), np.flatnonzero(end) + 1

    @property
    def starts(self) -> np.ndarray:
        return self._spans[0]

    @property
    def ends(self) -> np.ndarray:
        return self._spans[1]

    @cached_property
    def word_offsets(self) -> np.ndarray:
        """Index of each document's first word, and the number of words at the end."""
        return np.searchsorted(self.starts, self.offsets).astype(np.int64)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_offsets)

    @cached_property
    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    @cached_property
    def _words(self) -> tuple[pa.Array, np.ndarray]:
        return intern(self.buf[~self._space], self.ends - self.starts)

    @property
    def vocabulary(self) -> pa.Array:
        """The block's distinct words as bytes."""
        return self._words[0]

    @property
    def word_ids(self) -> np.ndarray:
        """Each word's place in the vocabulary: equal numbers mean equal words."""
        return self._words[1]

    @cached_property
    def word_lanes(self) -> Lanes:
        """The keyed 128-bit digest of each word as two arrays."""
        high, low = digests(self.vocabulary.to_pylist())
        return high[self.word_ids], low[self.word_ids]

    @cached_property
    def lead(self) -> np.ndarray:
        """True at the first byte of each code point."""
        return (self.buf & 0xC0) != 0x80

    def per_doc(self, byte_mask: np.ndarray) -> np.ndarray:
        """Number of marked bytes in each document."""
        return segment_sum(byte_mask.astype(np.int64), self.offsets)

    def per_doc_words(self, word_values: np.ndarray) -> np.ndarray:
        """Sum of a value per word over each document."""
        return segment_sum(word_values.astype(np.int64), self.word_offsets)

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, number) of the 3-word windows inside one document; equal numbers mean equal words."""
        ids, size = self.word_ids, len(self.vocabulary)
        if len(ids) < 3:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        first = np.flatnonzero(self.doc_of_word[:-2] == self.doc_of_word[2:])
        pair = ids[first] * size + ids[first + 1]
        if size >= 1 << 20:  # three numbers would not fit 63 bits
            pair = np.unique(pair, return_inverse=True)[1]
        return first, pair * size + ids[first + 2]

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, number) of the \\n-split lines that hold a word; equal numbers mean equal lines."""
        newline = np.flatnonzero(self.buf == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], newline + 1]), kind="stable")
        ends = np.sort(np.concatenate([newline, self.offsets[1:]]), kind="stable")
        has_word = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        ids = intern(self.buf[self.buf != 10], ends - starts)[1]
        # a document's first line follows the borders of all empty documents before it
        doc = np.searchsorted(self.offsets, starts[has_word], side="right") - 1
        return doc, ids[has_word]


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) row ranges whose text is about ``limit`` bytes; one row at least."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(lengths)
    start, n = 0, len(lengths)
    while start < n:
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield start, min(stop, n)
        start = min(stop, n)


def text_blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, TextBlock]]:
    """Slices of a record batch with their text block."""
    texts = batch.column(batch.schema.get_field_index(column))
    for start, stop in blocks(texts, limit):
        yield batch.slice(start, stop - start), TextBlock(texts.slice(start, stop - start))
