"""Sequence packing by minimum bin slack.

Every document becomes token ids plus an end id.  Whole windows are cut off its
front; the remainder, shorter than a window, is packed.  A window starts from
the longest waiting remainder; a subset-sum dynamic program over the multiset of
waiting lengths, one Python integer as bitset per length, finds the fill closest
to the capacity, and the layers are walked back to get a count per length.  A
fill whose counts allow it is repeated at once.  Where no fill reaches the
capacity, the longest waiting remainder is cut to close the gap, so only the
last window of an input partition is short.

Packing works inside an input partition in bounded groups: nothing is shuffled,
memory is bounded by ``group_tokens`` plus one document, and a lost task redoes
its own partition only.  Sequence ids hold the partition id in their high bits.

Nulls count as empty text, which is one piece holding the end id.  Repeated rows
are packed separately.  An empty table gives no pieces.  Extra columns are not
read.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlattice.llm.storage import small_batches
from flowlattice.llm.textkernel import TextBlock, blocks, intern, ranges
from flowlattice.llm.workers import kept

CAPACITY = 2048
GROUP_TOKENS = 4 << 20
END_ID = 1
BLOCK_BYTES = 4 << 20

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int64()), ("ids", pa.binary()),
])
PIECES_SQL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, ids binary"


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths (with counts) whose sum is closest to ``capacity`` from below.

    It holds the longest length at least once.  Bit s of a layer says that sum s
    can be made of the lengths so far; the walk back takes, from the last length
    to the first, the fewest items that lead to a sum of the layer before.
    """
    lengths = sorted((n for n in counts if counts[n] > 0 and n <= capacity), reverse=True)
    if not lengths:
        return {}
    seed = lengths[0]
    room = capacity - seed
    mask = (1 << (room + 1)) - 1
    reach, layers, used = 1, [], []
    for n in lengths:
        most = min(counts[n] - (n == seed), room // n)
        if most <= 0:
            continue
        layers.append(reach)
        used.append((n, most))
        step = 1
        while most > 0:
            take = min(step, most)
            reach |= (reach << (take * n)) & mask
            most -= take
            step *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    fill = defaultdict(int, {seed: 1})
    for (n, most), before in zip(reversed(used), reversed(layers), strict=True):
        k = 0
        while not before >> total & 1:
            total -= n
            k += 1
        assert k <= most and total >= 0
        if k:
            fill[n] += k
    return dict(fill)


class Packer:
    """Waiting remainders by length; yields windows as lists of (item, start, length)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.waiting: dict[int, deque] = {}
        self.tokens = 0

    def add(self, item: int, start: int, length: int) -> None:
        self.waiting.setdefault(length, deque()).append((item, start))
        self.tokens += length

    def _take(self, length: int) -> tuple[int, int, int]:
        queue = self.waiting[length]
        item, start = queue.popleft()
        if not queue:
            del self.waiting[length]
        self.tokens -= length
        return item, start, length

    def windows(self, finish: bool) -> Iterator[list[tuple[int, int, int]]]:
        """Full windows while a whole window waits; with ``finish`` also the last, short one."""
        while self.tokens >= self.capacity:
            fill = best_fill({n: len(q) for n, q in self.waiting.items()}, self.capacity)
            gap = self.capacity - sum(n * k for n, k in fill.items())
            if gap:
                window = [self._take(n) for n, k in fill.items() for _ in range(k)]
                while gap:  # cut the longest one that waits
                    item, start, length = self._take(max(self.waiting))
                    part = min(gap, length)
                    window.append((item, start, part))
                    if part < length:
                        self.add(item, start + part, length - part)
                    gap -= part
                yield window
                continue
            for _ in range(min(len(self.waiting[n]) // k for n, k in fill.items())):
                yield [self._take(n) for n, k in fill.items() for _ in range(k)]
        if finish and self.tokens:
            yield [self._take(n) for n in sorted(self.waiting, reverse=True) for _ in range(len(self.waiting[n]))]


_TAIL = np.zeros(256, bool)
_TAIL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
_ALNUM = np.array([c < 128 and chr(c).isalnum() for c in range(256)])
_CAPITAL = np.array([65 <= c <= 90 for c in range(256)])


def runs_of(block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, length of each run, runs per word): each word lower-cased, its closing punctuation apart.

    The bytes are those of the words, one after another.
    A run of ASCII punctuation after an ASCII letter or digit at the end of a word
    is always a token boundary of the file's splitter (apostrophes stay inside).
    A block that may hold a special token's string is left as it is.
    """
    buf, starts, ends = block.buf, block.starts, block.ends
    if np.any((buf[:-1] == 60) & (buf[1:] == 124)):
        return buf[~block._space], ends - starts, np.ones(len(starts), np.int64)
    buf = buf + (_CAPITAL[buf] * np.uint8(32))
    core = ends.copy()
    for _ in range(8):
        more = _TAIL[buf[core - 1]] & (core - 1 > starts)
        if not more.any():
            break
        core[more] -= 1
    split = (core < ends) & _ALNUM[buf[core - 1]] if len(starts) else np.empty(0, bool)
    count = 1 + split
    at = np.cumsum(count) - count
    lengths = np.empty(int(count.sum()), np.int64)
    lengths[at] = np.where(split, core, ends) - starts
    lengths[at[split] + 1] = (ends - core)[split]
    return buf[~block._space], lengths, count


Tokenise = Callable[[TextBlock], tuple[np.ndarray, np.ndarray]]


#: Lower-case Latin letters, each one letter under NFC; such a run is one word for the file's splitter.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
_JOINED = 500  # runs in one text

Encoded = tuple[np.ndarray, np.ndarray, np.ndarray]


def joined_encoder(encoder) -> Callable[[list[bytes]], Encoded]:
    """(ids, where each run's begin, how many); runs of letters are encoded many in one text.

    A model with an end-of-word suffix ends each word in the one token that bears it,
    so the ids of words with spaces between them fall apart after those tokens.  If
    their number is not that of the words, each is encoded by itself.
    """
    suffix = json.loads(encoder.to_str())["model"].get("end_of_word_suffix")
    vocabulary = encoder.get_vocab()
    last = np.zeros(max(vocabulary.values()) + 1, bool)
    if suffix:
        last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def encode(runs: list[bytes]) -> Encoded:
        letters = [i for i, match in enumerate(map(_LETTERS, runs)) if match] if suffix else []
        chunks = [letters[a : a + _JOINED] for a in range(0, len(letters), _JOINED)]
        texts = [b" ".join([runs[i] for i in chunk]).decode() for chunk in chunks]
        parts, sizes, order = [], [], []
        for chunk, e in zip(chunks, encoder.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(last[ids]) + 1
            if len(ends) == len(chunk) and ends[-1] == len(ids):
                parts.append(ids)
                sizes.append(np.diff(ends, prepend=0))
                order.extend(chunk)
        alone = np.ones(len(runs), bool)
        alone[order] = False
        rest = np.flatnonzero(alone).tolist()
        each = [e.ids for e in encoder.encode_batch_fast([runs[i].decode() for i in rest], add_special_tokens=False)]
        parts.append(np.fromiter(chain.from_iterable(each), np.uint32))
        sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        size, begin = np.empty(len(runs), np.int64), np.empty(len(runs), np.int64)
        own = np.concatenate(sizes)
        size[order + rest] = own
        begin[order + rest] = np.cumsum(own) - own
        return np.concatenate(parts), begin, size

    return encode


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


class RunIds:
    """Ids of the runs met lately; past ``limit`` runs, those met in the fewest blocks go."""

    def __init__(self, encode: Callable[[list[bytes]], Encoded], limit: int):
        self.encode, self.limit = encode, limit
        self.numbers = _Numbers()
        self.ids = np.empty(0, np.uint32)
        self.begin, self.size, self.met = (np.empty(0, np.int64) for _ in range(3))

    def find(self, runs: list[bytes]) -> np.ndarray:
        """The number of each of a block's distinct runs, for ``begin`` and ``size``; numbers hold until the next call."""
        if len(self.numbers) > self.limit:
            self._forget()
        before = len(self.numbers)
        found = np.fromiter(map(self.numbers.__getitem__, runs), np.int64, len(runs))
        fresh = np.flatnonzero(found >= before)  # distinct, so they stand in the order of their numbers
        if len(fresh):
            ids, begin, size = self.encode([runs[i] for i in fresh.tolist()])
            self.begin = np.concatenate([self.begin, begin + len(self.ids)])
            self.size = np.concatenate([self.size, size])
            self.met = np.concatenate([self.met, np.zeros(len(fresh), np.int64)])
            self.ids = np.concatenate([self.ids, ids])
        self.met[found] += 1
        return found

    def _forget(self) -> None:
        stay = np.sort(np.argsort(-self.met, kind="stable")[: self.limit // 2])
        stay = stay[self.met[stay] > 1]
        runs = list(self.numbers)
        self.numbers = _Numbers((runs[old], new) for new, old in enumerate(stay.tolist()))
        self.ids = self.ids[ranges(self.begin[stay], self.size[stay])]
        self.size, self.met = self.size[stay], self.met[stay] // 2
        self.begin = np.cumsum(self.size) - self.size


def word_cached_tokeniser(path: str | None = None, name: str = "word_bpe_49k.json", cache_words: int = 200_000) -> Callable[[], Tokenise]:
    """Tokeniser that encodes each distinct word, without its closing punctuation, once.

    The file's normaliser and splitter never look across a space, tab, line feed
    or carriage return, so the ids of a text are those of its runs in order.
    """

    def make() -> Tokenise:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        where = path
        if where is None:
            import public_tokenizers

            where = public_tokenizers.path(name)
        known = kept("runs", (where, cache_words), lambda: RunIds(joined_encoder(Tokenizer.from_file(where)), cache_words))

        def run(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
            data, lengths, per_word = runs_of(block)
            distinct, inverse = intern(data, lengths)
            number = known.find(distinct.to_pylist())[inverse]
            per_run = known.size[number]
            ids = known.ids[ranges(known.begin[number], per_run)]
            upto = np.concatenate([[0], np.cumsum(per_run)])
            runs = np.concatenate([[0], np.cumsum(per_word)])[block.word_offsets]
            return ids, np.diff(upto[runs])

        return run

    return make


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS, tokeniser: Callable[[], Tokenise] | None = None) -> DataFrame:
    """One row per piece: where it starts in its document, its sequence and offset, and its ids.

    ``ids`` are little-endian unsigned 32-bit integers; ``sequence_tokens`` is the
    filled length of the sequence, the rest up to ``capacity`` is padding.
    """
    make = tokeniser or word_cached_tokeniser()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenise = make()
        packer = Packer(capacity)
        held: dict[int, list] = {}  # item -> [doc_id, doc_tokens, first id kept here, ids, tokens not yet placed]
        sequence = (TaskContext.get().partitionId() << 40) - 1
        item = 0
        out: list[tuple] = []

        def place(window: list[tuple[int, int, int]]) -> None:
            nonlocal sequence
            sequence += 1
            offset, filled = 0, sum(n for _, _, n in window)
            for key, start, n in window:
                doc_id, total, base, ids, _ = held[key]
                out.append((doc_id, start, n, total, sequence, offset, filled, ids[start - base : start - base + n].tobytes()))
                offset += n
                held[key][4] -= n
                if not held[key][4]:
                    del held[key]

        def flush() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(out), 10_000):
                part = zip(*out[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, PIECES, strict=True)], schema=PIECES)
            out.clear()

        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b in blocks(batch.column(1), BLOCK_BYTES):
                ids, counts = tokenise(TextBlock(batch.column(1).slice(a, b - a)))
                ends = np.cumsum(counts)
                for doc_id, lo, hi in zip(names[a:b], (ends - counts).tolist(), ends.tolist(), strict=True):
                    own = np.append(ids[lo:hi], np.uint32(end_id)).astype("<u4")
                    total = len(own)
                    whole = total - total % capacity
                    held[item] = [doc_id, total, 0, own, total]
                    for start in range(0, whole, capacity):
                        place([(item, start, capacity)])
                    if whole < total:
                        held[item][2:4] = whole, own[whole:].copy()
                        packer.add(item, whole, total - whole)
                    item += 1
                    if packer.tokens >= group_tokens:
                        for window in packer.windows(finish=False):
                            place(window)
                    if len(out) >= 10_000:
                        yield from flush()
        for window in packer.windows(finish=True):
            place(window)
        yield from flush()

    return small_batches(docs).selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, PIECES_SQL)


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: its ids and the documents' bounds (a sequence is at most one window)."""
    part = F.struct("offset", "doc_id", "start", "length", "ids")
    return (
        pieces.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(part)).alias("parts"))
        .select(
            "sequence_id",
            F.aggregate("parts", F.expr("X''"), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
            F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("bounds"),
        )
    )
