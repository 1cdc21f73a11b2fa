"""Substring deduplication by level-wise doubling.

A window is ``min_words`` consecutive words of one document; it is a repeat if
its word sequence also starts in a document with a smaller id.  Levels double a
window length up to ``min_words`` (13, 25 and 50 words for 50; halves are rounded
up, so the last doubling overlaps).  At each level only windows of that length
that stand in two documents survive, and the next level looks at the windows of
twice the length around survivors alone; the loop ends when none survive.

Of the shorter windows inside a ``min_words`` window the one with the least hash
is its seed at that level.  Equal windows have equal seeds, so a level exchanges
seeds, not positions, and loses no repeat.  At the target length the survivors
themselves go to an aggregation that keeps the smallest document of each word
sequence (partial aggregates first, so a passage that a third of all documents
share costs a row per task).  A document is told which survivors it owns; its
others are the repeats.

Documents with the same word sequence are collapsed before the first exchange:
the smallest id stands for them, the others repeat it wholly.  Words and word
sequences are told apart by keyed 128-bit digests, windows by 128-bit hashes
joined from them; seeds of 64 bits only propose.

Nulls and empty texts have no words.  Rows with a null id are never owners and
keep their words.  Rows that share a doc_id are judged each by its own text,
against documents with a smaller id.  An empty table gives no rows.  Extra
columns are not read and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlattice.llm import rows as row_keys
from flowlattice.llm.storage import materialise
from flowlattice.llm.textkernel import Lanes, TextBlock, mix, ranges, text_blocks, window_lanes

MIN_WORDS = 50
FIRST_WORDS = 12


def level_sizes(min_words: int, first_words: int = FIRST_WORDS) -> list[int]:
    """Window lengths of the levels before the target: halves, rounded up, of at least ``first_words``."""
    sizes = [-(-min_words // 2)]
    while -(-sizes[0] // 2) >= first_words:
        sizes.insert(0, -(-sizes[0] // 2))
    return sizes


def seed_positions(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` consecutive hashes, the position of the least (leftmost of equals)."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best = np.arange(len(hashes), dtype=np.int64)
    width = 1
    while 2 * width <= span:  # minima over power-of-two widths, by doubling
        left, right = best[: len(best) - width], best[width:]
        best = np.where(hashes[right] < hashes[left], right, left)
        width *= 2
    left, right = best[:n], best[span - width : span - width + n]
    return np.where(hashes[right] < hashes[left], right, left)


def target_windows(block: TextBlock, min_words: int) -> np.ndarray:
    """First words of the target windows that lie inside one document."""
    n = len(block.starts) - min_words + 1
    if n <= 0:
        return np.empty(0, np.int64)
    return np.flatnonzero(block.doc_of_word[:n] == block.doc_of_word[min_words - 1 :])


def seeds_of(hashes: np.ndarray, first: np.ndarray, size: int, min_words: int) -> np.ndarray:
    """The seed's first word of each target window, from the hashes of all windows of ``size`` words."""
    return seed_positions(hashes, min_words - size + 1)[first] if len(first) else first


def sketch(docs: DataFrame, min_words: int) -> DataFrame:
    """(key, doc_id, row, content, seeds): per row with a window, a digest of its words and its runs of seeds.

    ``seeds`` packs one 64-bit seed per level for each run of windows that share them.
    """
    sizes = level_sizes(min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for rows, block in text_blocks(batch, "text"):
                first = target_windows(block, min_words)
                lanes = window_lanes(block.word_lanes[:1], sizes)
                chosen = [seeds_of(high, first, size, min_words) for (high,), size in zip(lanes, sizes, strict=True)]
                doc = block.doc_of_word[first]
                turn = np.ones(len(first), bool)
                if len(first):
                    turn[1:] = np.any([c[1:] != c[:-1] for c in [doc, *chosen]], axis=0)
                runs = np.stack([high[c[turn]] for (high,), c in zip(lanes, chosen, strict=True)], axis=1)
                cut = np.searchsorted(doc[turn], np.arange(block.n + 1))
                packed = runs.astype("<u8").tobytes()
                width = 8 * len(sizes)
                words = np.stack(block.word_lanes, axis=1).astype("<u8").tobytes()
                at = (block.word_offsets * 16).tolist()
                some = np.flatnonzero(block.n_words >= min_words)
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(key + some),
                    "doc_id": rows.column(0).take(pa.array(some)),
                    "row": rows.column(1).take(pa.array(some)),
                    "content": pa.array([hashlib.blake2b(words[at[k] : at[k + 1]], digest_size=16).digest() for k in some.tolist()], pa.binary()),
                    "seeds": pa.array([packed[cut[k] * width : cut[k + 1] * width] for k in some.tolist()], pa.binary()),
                })
                key += block.n

    return docs.mapInArrow(run, "key long, doc_id long, row binary, content binary, seeds binary")


def _unpack(df: DataFrame, n_levels: int, levels: list[int]) -> DataFrame:
    """(key, doc_id, s<level>...) for each run of packed seeds."""
    names = [f"s{k}" for k in levels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packs = batch.column(2).to_pylist()
            sizes = np.array([len(p) // (8 * n_levels) for p in packs], np.int64)
            values = np.frombuffer(b"".join(packs), np.int64).reshape(-1, n_levels)
            at = np.repeat(np.arange(len(packs)), sizes)
            for a in range(0, len(at), 200_000):
                part = pa.array(at[a : a + 200_000])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(part), batch.column(1).take(part), *(pa.array(np.ascontiguousarray(values[a : a + 200_000, k])) for k in levels)], names=["key", "doc_id", *names]
                )

    return df.select("key", "doc_id", "seeds").mapInArrow(run, "key long, doc_id long, " + ", ".join(f"{n} long" for n in names))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all values, number of values per row) of a list column; null lists are empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), sizes


def _survivors(block: TextBlock, alive: pa.Array, min_words: int) -> tuple[np.ndarray, Lanes]:
    """(first words, 128-bit hashes) of the target windows whose last seed is among their document's live seeds."""
    size = level_sizes(min_words)[-1]
    first = target_windows(block, min_words)
    values, sizes = _lists(alive)
    if not len(first) or not len(values):
        return first[:0], (np.empty(0, np.uint64), np.empty(0, np.uint64))
    (half, _), (high, low) = window_lanes(block.word_lanes, [size, min_words])
    seed = half[seeds_of(half, first, size, min_words)]
    owner = np.repeat(np.arange(block.n), sizes).astype(np.uint64)
    salt = np.uint64(0x8CB92BA72F3D8DD7)  # proposes only: a clash lets one more window through
    doc = block.doc_of_word[first].astype(np.uint64)
    first = first[np.isin(mix(seed + mix(doc + salt)), mix(values + mix(owner + salt)))]
    return first, (high[first], low[first])


def _owned(doc: np.ndarray, lanes: Lanes, owned: pa.Array, n: int) -> np.ndarray:
    """Which windows are among the (high, low) pairs that their document owns."""
    values, sizes = _lists(owned)
    out = np.zeros(len(doc), bool)
    if not len(values) or not len(doc):
        return out
    who = np.repeat(np.arange(n), sizes // 2)
    keys = [np.concatenate([doc, who]), np.concatenate([lanes[0], values[0::2]]), np.concatenate([lanes[1], values[1::2]])]
    order = np.lexsort(keys[::-1])
    ranked = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in ranked], axis=0)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new)
    return np.isin(group[: len(doc)], group[len(doc) :])


def removed_words(block: TextBlock, alive: pa.Array, owned: pa.Array, whole: pa.Array, min_words: int) -> np.ndarray:
    """Mask of the words to remove: those under windows that survive and are not owned, and all of whole copies."""
    entire = pc.fill_null(whole, False).to_numpy(zero_copy_only=False).astype(bool)
    gone = entire[block.doc_of_word]
    some = np.flatnonzero(pc.fill_null(pc.list_value_length(alive), 0).to_numpy(zero_copy_only=False))
    if not len(some):
        return gone
    at = pa.array(some)
    part = TextBlock(block.texts.take(at))  # only documents with live seeds are looked at again
    first, lanes = _survivors(part, alive.take(at), min_words)
    drop = first[~_owned(part.doc_of_word[first], lanes, owned.take(at), part.n)]
    change = np.zeros(len(part.starts) + 1, np.int64)
    np.add.at(change, drop, 1)
    np.add.at(change, drop + min_words, -1)
    gone[ranges(block.word_offsets[some], part.n_words)] |= np.cumsum(change[:-1]) > 0
    return gone


def _shared(seeds: DataFrame, name: str) -> DataFrame:
    """The seeds that stand in documents of two ids."""
    return seeds.groupBy(name).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select(name)


def marks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, row, alive, owned, whole): what a row of (doc_id, row, text) needs to find its repeats again.

    ``alive`` are its last seeds found under two ids, ``owned`` the target windows
    that start under no smaller id, ``whole`` marks a row whose word sequence a
    smaller id has entirely.  Rows without any are absent.
    """
    sizes = level_sizes(min_words)
    sketched = materialise(sketch(docs.where("doc_id IS NOT NULL"), min_words), "substring-sketch")
    # written first, so that the join below may split a content that very many rows have
    first_of = materialise(sketched.groupBy("content").agg(F.min(F.struct("doc_id", "key")).alias("least")), "substring-contents")
    ranked = sketched.join(first_of, "content")
    rows = materialise(ranked.select("doc_id", "row", F.col("least.doc_id").alias("least_id"), F.col("least.key").alias("key")).distinct(), "substring-rows")
    reps = materialise(ranked.where("key = least.key").select("key", "doc_id", "row", "seeds"), "substring-reps")
    seeds = _unpack(reps, len(sizes), list(range(len(sizes))))
    counted = _unpack(reps, len(sizes), [0])
    for level in range(len(sizes)):
        later = [f"s{k}" for k in range(level + 1, len(sizes))]
        # written first, so that the join may split a seed that very many documents have
        shared = materialise(_shared(counted, f"s{level}"), "substring-shared")
        left = seeds.join(shared, f"s{level}", "left_semi")
        seeds = materialise(left.select("key", "doc_id", *(later or [f"s{level}"])).distinct(), f"substring-level{sizes[level]}")
        counted = seeds
        if seeds.isEmpty():
            break
    alive = materialise(seeds.groupBy("key").agg(F.collect_list(seeds.columns[-1]).alias("alive")), "substring-alive")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in text_blocks(batch, "text"):
                first, (high, low) = _survivors(block, part.column(2), min_words)
                ids = part.column(0).take(pa.array(block.doc_of_word[first]))
                for at in range(0, len(first), 100_000):
                    s = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_pydict({"high": pa.array(high[s].view(np.int64)), "low": pa.array(low[s].view(np.int64)), "doc_id": ids[s]})

    asked = reps.select("key", "doc_id", "row").join(alive, "key").drop("key")
    windows = docs.join(asked.hint("merge"), ["doc_id", "row"]).select("doc_id", "text", "alive").mapInArrow(extend, "high long, low long, doc_id long")
    owners = windows.groupBy("high", "low").agg(F.min("doc_id").alias("doc_id"))
    owned = materialise(owners.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array("high", "low"))).alias("owned")), "substring-owned")
    found = rows.where("doc_id = least_id").join(alive, "key").join(owned, "doc_id", "left").select("doc_id", "row", "alive", "owned", F.lit(False).alias("whole"))
    none = F.lit(None).cast("array<long>")
    return found.unionByName(rows.where("doc_id > least_id").select("doc_id", "row", none.alias("alive"), none.alias("owned"), F.lit(True).alias("whole")))


def _cut(block: TextBlock, gone: np.ndarray, keep_layout: bool) -> list[bytes]:
    """Each document's kept text: its words joined by one space, or its own layout without the removed spans."""
    out = []
    at = block.word_offsets
    if keep_layout:
        # a removed word goes with the white space after it
        drop = np.zeros(len(block.buf) + 1, np.int64)
        nxt = np.append(block.starts[1:], len(block.buf)) if len(block.starts) else block.starts
        last_of_doc = np.zeros(len(block.starts), bool)
        last_of_doc[at[1:][block.n_words > 0] - 1] = True
        stop = np.where(last_of_doc, block.offsets[1:][block.doc_of_word] if len(block.starts) else nxt, nxt)
        drop[block.starts[gone]] += 1
        drop[stop[gone]] -= 1
        kept = block.buf[np.cumsum(drop[:-1]) == 0]
        bounds = np.concatenate([[0], np.cumsum(block.per_doc(np.cumsum(drop[:-1]) == 0))])
        raw = kept.tobytes()
        return [raw[bounds[k] : bounds[k + 1]] for k in range(block.n)]
    starts, ends = block.starts[~gone], block.ends[~gone]
    lengths = ends - starts
    stop = np.cumsum(lengths + 1)
    joined = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
    joined[ranges(stop - lengths - 1, lengths)] = block.buf[ranges(starts, lengths)]
    raw = joined.tobytes()
    kept = np.concatenate([[0], np.cumsum(block.per_doc_words(~gone))])
    stop = np.concatenate([[0], stop])
    for k in range(block.n):
        a, b = int(stop[kept[k]]), int(stop[kept[k + 1]])
        out.append(raw[a : max(a, b - 1)])
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the kept words of every row joined by one space."""
    source = row_keys.keyed(docs, id_col, text_col)
    found = marks(source, min_words).hint("merge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in text_blocks(batch, "text"):
                gone = removed_words(block, *rows.columns[2:], min_words)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column(0),
                    "n_words": pa.array(block.n_words),
                    "n_removed": pa.array(block.per_doc_words(gone)),
                    "kept": pa.array(_cut(block, gone, False), pa.binary()).cast(pa.string()),
                })

    joined = source.join(found, ["doc_id", "row"], "left").select("doc_id", "text", "alive", "owned", "whole")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents (all columns) with repeated passages cut out of their text.

    The layout of what stays is kept; ``size_col``, if present, is the new length
    in characters.  Documents that lose all their words stay, with an empty text.
    """
    found = marks(row_keys.keyed(docs, id_col, text_col), min_words)
    names = docs.columns
    text_at = names.index(text_col)
    own_row, *hidden = (row_keys.fresh(c, names) for c in ("row", "mark_id", "mark_row", "mark_alive", "mark_owned", "mark_whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = batch.rename_columns([str(i) for i in range(batch.num_columns)])
            for rows, block in text_blocks(numbered, str(text_at)):
                gone = removed_words(block, *rows.columns[-3:], min_words)
                out = rows.columns[: len(names)]
                touched = block.per_doc_words(gone) > 0
                if touched.any():
                    cut = _cut(block, gone, True)
                    texts = [c.decode() if t else o for t, c, o in zip(touched, cut, out[text_at].to_pylist(), strict=True)]
                    out[text_at] = pa.array(texts, out[text_at].type)
                    if size_col in names:
                        at = names.index(size_col)
                        sizes = [len(c) if t else s for t, c, s in zip(touched, texts, out[at].to_pylist(), strict=True)]
                        out[at] = pa.array(sizes, out[at].type)
                yield pa.RecordBatch.from_arrays(out, names=names)

    own = docs.withColumn(own_row, row_keys.text_key(F.col(f"`{text_col}`")))
    same = (F.col(f"`{id_col}`").cast("long") == F.col(hidden[0])) & (F.col(own_row) == F.col(hidden[1]))
    joined = own.join(found.toDF(*hidden).hint("merge"), same, "left").select(*[F.col(f"`{c}`") for c in names], *hidden[2:])
    return joined.mapInArrow(run, docs.schema)
