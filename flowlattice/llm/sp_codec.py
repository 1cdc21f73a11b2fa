"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

The agenda holds the candidate merges of a text's symbols; the best score goes
first, the leftmost of equals.  Merge-dropout skips a candidate if a hash keyed
by seed, document, the chunk's place in it and the candidate's borders falls
below ``dropout``, so segmentations vary with the seed and from occurrence to
occurrence and are the same on every run.  Dropout 0 gives the model's own
segmentation.

No piece of the model has a space mark after another character, so a text falls
into chunks at such borders, and equal chunks of a block are segmented once
without dropout, all of them side by side: each round merges every chunk's best
candidate.  An occurrence that skips none of the candidates met there has that
segmentation; the others are segmented one each.  Long chunks go through a heap,
one by one.

Decoding joins pieces and bytes and drops the one space put in front.  A literal
space mark (U+2581) is written as bytes, so every text comes back unchanged.

A model whose own normaliser would change texts is refused.

A null text has null ids and decodes to null; an empty text has no ids.
Repeated rows are encoded each, with equal ids.  A null id counts as id 0 in the
hash.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowlattice.llm.storage import small_batches
from flowlattice.llm.textkernel import TextBlock, intern, mix, ranges, text_blocks
from flowlattice.llm.workers import kept

MARK = 0x2581
_LITERAL = 0x110000
_NEVER = np.int64(1 << 62)
_LONG = 48


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def read_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = read_varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = read_varint(data, at)
        else:
            size, at = read_varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Codec:
    """Piece tables of a BPE model file."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        scores, kinds = [], []
        for number, value in read_fields(model):
            if number == 3:
                self._check_normaliser(dict(read_fields(value)))
            if number != 1:
                continue
            piece = {1: b"", 2: b"\0\0\0\0", 3: 1} | dict(read_fields(value))
            self.pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0])
            kinds.append(piece[3])
        # fixed values of the format: kinds 1 normal, 2 unknown, 3 control, 6 byte
        index = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == 1}
        if any("▁" in p.lstrip("▁") for p in index):
            raise ValueError("a piece crosses a space mark")
        self.byte_ids = np.array([self.pieces.index(f"<0x{b:02X}>") for b in range(256)], np.uint32)
        rank_of = {i: r for r, i in enumerate(sorted(index.values(), key=lambda i: (-scores[i], i)))}
        self.chars = {ord(p): i for p, i in index.items() if len(p) == 1}
        self.char_table = np.full(_LITERAL + 1, -1, np.int32)
        self.char_table[list(self.chars)] = list(self.chars.values())
        pairs = {}
        for p, i in index.items():
            for cut in range(1, len(p)):
                a, b = index.get(p[:cut]), index.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = (rank_of[i], i)
        self.pairs = pairs
        size = 1 << (4 * len(pairs)).bit_length()
        self.table_key, self.table_rank, self.table_id = np.full(size, -1, np.int64), np.full(size, _NEVER), np.zeros(size, np.int32)
        for key, (rank, i) in pairs.items():
            at = self._slot(key)
            while self.table_key[at] >= 0:
                at = (at + 1) & (size - 1)
            self.table_key[at], self.table_rank[at], self.table_id[at] = key, rank, i
        data = [bytes([int(p[3:5], 16)]) if k == 6 else p.replace("▁", " ").encode() if k == 1 else b"" for p, k in zip(self.pieces, kinds, strict=True)]
        self.piece_size = np.array([len(d) for d in data], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(data), np.uint8)

    @staticmethod
    def _check_normaliser(spec: dict[int, int | bytes]) -> None:
        """Raise unless texts go in unchanged behind one dummy space, the only setting that is lossless."""
        # fixed numbers of the format: 2 character map, 3 dummy prefix, 4 drop extra spaces, 5 spaces as marks
        if spec.get(2) or not spec.get(3, 1) or spec.get(4, 1) or not spec.get(5, 1):
            raise ValueError("the model's normaliser changes texts")

    def _slot(self, key: int) -> int:
        return (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 40 & (len(self.table_key) - 1)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of symbol pairs; rank is huge where no piece is made."""
        key = left.astype(np.int64) << 20 | right.astype(np.int64)
        mask = len(self.table_key) - 1
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & mask
        rank, merged = np.full(len(key), _NEVER), np.zeros(len(key), np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            seen = self.table_key[at[open_]]
            hit = seen == key[open_]
            found = open_[hit]
            rank[found], merged[found] = self.table_rank[at[found]], self.table_id[at[found]]
            open_ = open_[~hit & (seen >= 0)]
            at[open_] = (at[open_] + 1) & mask
        return rank, merged

    def segment_heap(self, symbols: list[int], key: int, bar: int) -> list[int]:
        """Agenda over one chunk: symbol ids to piece ids."""
        n = len(symbols)
        symbol = list(symbols)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        agenda: list[tuple[int, int, int, int, int, int]] = []
        stamp = [0] * n

        def push(a: int) -> None:
            b = after[a]
            if b >= n:
                return
            found = self.pairs.get(symbol[a] << 20 | symbol[b])
            if found is None:
                return
            heapq.heappush(agenda, (found[0], a, b, stamp[a], stamp[b], found[1]))

        for a in range(n):
            push(a)
        while agenda:
            _, a, b, sa, sb, merged = heapq.heappop(agenda)
            if not (alive[a] and alive[b]) or after[a] != b or stamp[a] != sa or stamp[b] != sb:
                continue
            end = after[b]
            if bar and int(_candidate_hash(np.array([key], np.uint64), np.array([a]), np.array([b]), np.array([end]))[0]) < bar:
                continue  # skipped for good: no other candidate has these borders
            symbol[a], alive[b], after[a] = merged, False, after[b]
            stamp[a] += 1
            if after[b] < n:
                before[after[b]] = a
            push(a)
            if before[a] >= 0:
                push(before[a])
        return [s for s, ok in zip(symbol, alive, strict=True) if ok]

    def segment_rounds(self, symbols: np.ndarray, keys: np.ndarray, bar: int, met: list[tuple[np.ndarray, ...]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Agenda over chunks of one length side by side: (piece ids, pieces per chunk), row by row.

        ``met`` collects the candidates that came up: (row, start, middle, end).
        """
        rows, n = symbols.shape
        sym = symbols.astype(np.int32).copy()
        bound = np.tile(np.arange(n + 1, dtype=np.int32), (rows, 1))
        rank, merged = (x.reshape(rows, n - 1) for x in self.lookup(sym[:, :-1].ravel(), sym[:, 1:].ravel()))
        if bar:
            place = np.arange(n - 1)
            hashed = _candidate_hash(keys[:, None], place[None], place[None] + 1, place[None] + 2)
            rank = np.where(hashed < np.uint64(bar), _NEVER, rank)
        if met is not None:
            r, c = np.nonzero(rank < _NEVER)
            met.append((r, c, c + 1, c + 2))
        out, size = np.zeros((rows, n), np.uint32), np.zeros(rows, np.int64)
        live = np.arange(rows)
        left = n
        while len(live):
            best = rank.argmin(axis=1) if left > 1 else np.zeros(len(live), np.int64)
            done = rank[np.arange(len(live)), best] >= _NEVER if left > 1 else np.ones(len(live), bool)
            if done.any():
                out[live[done], :left], size[live[done]] = sym[done], left
                go = ~done
                live, sym, bound, rank, merged, best, keys = live[go], sym[go], bound[go], rank[go], merged[go], best[go], keys[go]
                if not len(live):
                    break
            i = np.arange(len(live))
            sym[i, best] = merged[i, best]
            # the right symbol, the border before it and the merge itself go
            keep = np.ones((len(live), left + 1), bool)
            keep[i, best + 1] = False
            sym, bound = sym[keep[:, :left]].reshape(-1, left - 1), bound[keep].reshape(-1, left)
            left -= 1
            if left == 1:
                rank, merged = np.empty((len(live), 0), np.int64), np.empty((len(live), 0), np.int32)
                continue
            keep = np.ones((len(live), left), bool)
            keep[i, best] = False
            rank, merged = rank[keep].reshape(-1, left - 1), merged[keep].reshape(-1, left - 1)
            for at, ok in ((best, best < left - 1), (best - 1, best > 0)):
                r, c = i[ok], at[ok]
                fresh, made = self.lookup(sym[r, c], sym[r, c + 1])
                if bar:
                    hashed = _candidate_hash(keys[r], bound[r, c], bound[r, c + 1], bound[r, c + 2])
                    fresh = np.where(hashed < np.uint64(bar), _NEVER, fresh)
                if met is not None:
                    hit = fresh < _NEVER
                    x, y = r[hit], c[hit]
                    met.append((live[x], bound[x, y], bound[x, y + 1], bound[x, y + 2]))
                rank[r, c], merged[r, c] = fresh, made
        keep = np.arange(n)[None] < size[:, None]
        return out[keep], size

    def encode_block(self, block: TextBlock, doc_keys: np.ndarray, seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, number of ids of each)."""
        bar = min(int(dropout * 2.0**64), (1 << 64) - 1)
        points = np.frombuffer(block.buf.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = block.per_doc(block.lead)
        points[points == MARK] = _LITERAL
        points[points == 32] = MARK
        full = sizes > 0
        # one mark in front of every document that is not empty
        begin = np.cumsum(sizes + full) - (sizes + full)
        whole = np.full(len(points) + int(full.sum()), MARK, np.int64)
        whole[ranges(begin + full, sizes)] = points
        doc = np.repeat(np.arange(block.n), sizes + full)
        symbol = self.char_table[whole]
        if not len(symbol):
            return np.empty(0, np.uint32), np.zeros(block.n, np.int64)
        cut = np.ones(len(symbol), bool)
        cut[1:] = ((whole[1:] == MARK) & (whole[:-1] != MARK)) | (symbol[1:] < 0) | (symbol[:-1] < 0) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(cut)
        length = np.diff(np.append(start, len(symbol)))
        ordinal = np.arange(len(start)) - np.searchsorted(start, begin)[doc[start]]
        place = mix(mix(doc_keys[doc[start]] + np.uint64(seed)) + ordinal.astype(np.uint64))
        inverse = intern(whole.astype(np.int32).view(np.uint8), 4 * length)[1]
        first = np.unique(inverse, return_index=True)[1]
        if not bar:
            ids, counts = self._segment(whole, symbol, start[first], length[first], place[first], 0)
        else:
            met: list[tuple[np.ndarray, ...]] = []
            plain = length[first] <= _LONG
            base = np.cumsum(plain) - 1
            ids, counts = self._segment(whole, symbol, start[first[plain]], length[first[plain]], place[first[plain]], 0, met)
            own = self._skips(inverse, np.flatnonzero(plain), len(first), place, met, bar) | ~plain[inverse]
            more, n_more = self._segment(whole, symbol, start[own], length[own], place[own], bar)
            inverse = np.where(own, int(plain.sum()) + np.cumsum(own) - 1, base[inverse])
            ids, counts = np.concatenate([ids, more]), np.concatenate([counts, n_more])
        at = np.cumsum(counts) - counts
        per_chunk = counts[inverse]
        return ids[ranges(at[inverse], per_chunk)], np.bincount(doc[start], weights=per_chunk, minlength=block.n).astype(np.int64)

    @staticmethod
    def _skips(chunk: np.ndarray, numbers: np.ndarray, n: int, place: np.ndarray, met: list[tuple[np.ndarray, ...]], bar: int) -> np.ndarray:
        """Which occurrences skip a candidate that came up without dropout; ``numbers`` are the chunks of the rows met."""
        out = np.zeros(len(chunk), bool)
        if not met:
            return out
        row, left, middle, right = (np.concatenate(x) for x in zip(*met, strict=True))
        row = numbers[row]
        order = np.argsort(row, kind="stable")
        left, middle, right = left[order], middle[order], right[order]
        size = np.bincount(row, minlength=n)
        begin = np.cumsum(size) - size
        for a in range(0, len(chunk), 1 << 16):
            c = chunk[a : a + (1 << 16)]
            at, who = ranges(begin[c], size[c]), np.repeat(np.arange(a, a + len(c)), size[c])
            out[who[_candidate_hash(place[who], left[at], middle[at], right[at]) < np.uint64(bar)]] = True
        return out

    def _segment(
        self, whole: np.ndarray, symbol: np.ndarray, start: np.ndarray, length: np.ndarray, keys: np.ndarray, bar: int, met: list[tuple[np.ndarray, ...]] | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(start), np.int64)
        made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        unknown = symbol[start] < 0
        for k in np.flatnonzero(unknown).tolist():
            point = int(whole[start[k]])
            raw = chr(MARK if point == _LITERAL else point).encode()
            made.append((np.array([k]), self.byte_ids[list(raw)], np.array([len(raw)])))
        for n in np.unique(length[~unknown]).tolist():
            rows = np.flatnonzero(~unknown & (length == n))
            if n == 1:
                made.append((rows, symbol[start[rows]].astype(np.uint32), np.ones(len(rows), np.int64)))
            elif n <= _LONG:
                for a in range(0, len(rows), 40_000):
                    part = rows[a : a + 40_000]
                    own: list[tuple[np.ndarray, ...]] | None = None if met is None else []
                    made.append((part, *self.segment_rounds(symbol[start[part][:, None] + np.arange(n)], keys[part], bar, own)))
                    if met is not None:
                        met.extend((part[x[0]], *x[1:]) for x in own)
            else:
                for k in rows.tolist():
                    ids = self.segment_heap(symbol[start[k] : start[k] + n].tolist(), int(keys[k]), bar)
                    made.append((np.array([k]), np.array(ids, np.uint32), np.array([len(ids)])))
        for rows, _, size in made:
            counts[rows] = size
        ids = np.empty(int(counts.sum()), np.uint32)
        at = np.cumsum(counts) - counts
        for rows, own, size in made:
            ids[ranges(at[rows], size)] = own
        return ids, counts

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of one document's ids."""
        raw = self.piece_bytes[ranges(self.piece_start[ids], self.piece_size[ids])].tobytes()
        return raw[1:]


def _candidate_hash(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Keyed hash of a candidate merge: its chunk's key and the three borders."""
    place = np.asarray(start).astype(np.uint64) << np.uint64(42) | np.asarray(middle).astype(np.uint64) << np.uint64(21) | np.asarray(end).astype(np.uint64)
    return mix(key + mix(place))


def model_path(path: str | None) -> str:
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _loader(path: str | None) -> Callable[[], Codec]:
    def load() -> Codec:
        where = model_path(path)

        def read() -> Codec:
            with open(where, "rb") as f:
                return Codec(f.read())

        return kept("codec", where, read)

    return load


_BLOCK = 1 << 20  # arrays of several words per character stand beside each block


def _packed(codec: Codec, rows: pa.RecordBatch, block: TextBlock, seed: int, dropout: float) -> list[bytes | None]:
    """The packed ids of each row of a block, None for a null text."""
    keys = mix(np.array([i or 0 for i in rows.column(0).to_pylist()], np.int64).view(np.uint64))
    ids, counts = codec.encode_block(block, keys, seed, dropout)
    stop = np.cumsum(counts)
    raw = ids.astype("<u4")
    null = rows.column(1).is_null().to_pylist()
    return [None if z else raw[b - c : b].tobytes() for b, c, z in zip(stop.tolist(), counts.tolist(), null, strict=True)]


def _text(codec: Codec, packed: bytes | None) -> str | None:
    return None if packed is None else codec.decode_bytes(np.frombuffer(packed, "<u4")).decode()


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(docs).selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, dropout: float = 0.1, path: str | None = None) -> DataFrame:
    """(doc_id, ids): little-endian unsigned 32-bit piece ids of each whole text."""
    load = _loader(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load()
        for batch in batches:
            for rows, block in text_blocks(batch, "text", _BLOCK):
                packed = _packed(codec, rows, block, seed, dropout)
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "ids": pa.array(packed, pa.binary())})

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text): the text of each row of piece ids."""
    load = _loader(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                texts = [_text(codec, p) for p in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "ids": rows.column(1), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, dropout: float = 0.1, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text): what :func:`encode` and then :func:`decode` give, in one Python worker a task."""
    load = _loader(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load()
        for batch in batches:
            for rows, block in text_blocks(batch, "text", _BLOCK):
                packed = _packed(codec, rows, block, seed, dropout)
                texts = [_text(codec, p) for p in packed]
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "ids": pa.array(packed, pa.binary()), "text": pa.array(texts, pa.string())})

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, text string")
