"""SimHash near-duplicates by a binary-trie self-join.

A document's fingerprint has a bit set where over half of its shingle hashes
have it.  Equal fingerprints collapse to one representative, the smallest id.
Representatives that differ in at most ``budget`` bits must agree on all but
``budget`` of ``n_blocks`` bit blocks, so each goes to one bucket per choice of
agreeing blocks; the remaining bits bound a bucket (22 bits, hence 2**22
fingerprints, for 64 bits, 6 blocks and 2 differences).  In a bucket the trie of
the free bits is joined with itself: node pairs descend together, collect
differing bits and are pruned beyond the budget.  Per bucket a spanning forest
of the links leaves the task, so edges stay linear in the documents, and
components come from star contractions.

Two documents whose shingle sets have a similarity well below 1 differ in many
bits of 64: for them :func:`similar_components` takes fingerprints of several
64-bit lanes and joins the tries of many short views of the bits with a budget
of their own.  A pair needs to pass in one view only.  Fingerprints only propose
pairs: a pair is linked if the sets of distinct shingle hashes have the
similarity asked for.  :func:`deduplicate` drops rows, not ids: where the smallest
id of a component stands on several of its rows, the smallest text key stays.

Nulls and empty texts have no words: fingerprint zero, linked like any other.
Rows with a null id carry the component of their fingerprint's smallest id.
Ties and repeated rows share a component.  An empty table gives no rows.  Extra
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlattice.llm import rows as row_keys
from flowlattice.llm.components import connected_components
from flowlattice.llm.storage import materialise, small_batches
from flowlattice.llm.textkernel import TextBlock, digests, mix, ranges, text_blocks

BITS = 64
WORDS = 3
BUDGET = 2
BLOCKS = 6
SEED = 42
_CHUNK = 1 << 16
_PIECE = 255
#: For each byte, its eight bits as the eight bytes of a 64-bit number.
_SPREAD = ((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64) & np.uint64(1)) << np.arange(0, 64, 8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def shingles(block: TextBlock, words: int) -> tuple[memoryview, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, ends, document) of the lower-cased, space-joined shingles."""
    buf = block.buf.copy()
    capital = (buf >= 65) & (buf <= 90)
    buf[capital] += 32
    lengths = block.ends - block.starts
    ends = np.cumsum(lengths + 1)  # a space stands after each word
    begin = ends - lengths - 1
    joined = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    joined[ranges(begin, lengths)] = buf[ranges(block.starts, lengths)]
    n, first = block.n_words, block.word_offsets[:-1]
    per_doc = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    at = ranges(first, per_doc)
    doc = np.repeat(np.arange(block.n), per_doc)
    last = np.minimum(at + words, np.repeat(first + n, per_doc)) - 1
    return memoryview(joined.tobytes()), begin[at], ends[last] - 1, doc


def shingle_hashes(block: TextBlock, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every shingle of a block."""
    raw, starts, ends, doc = shingles(block, words)
    hash_of = xxhash.xxh64_intdigest
    return np.fromiter((hash_of(raw[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)), doc


def distinct_shingles(block: TextBlock, words: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(hash, document) of the distinct shingles of each document, their number and a 128-bit digest of their set."""
    hashes, doc = shingle_hashes(block, words, seed)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[fresh], doc[fresh]
    size = np.bincount(doc, minlength=block.n)
    ends = np.append(0, np.cumsum(size)).tolist()
    raw = hashes.astype("<u8").tobytes()
    return hashes, doc, size, digests([raw[8 * a : 8 * b] for a, b in zip(ends, ends[1:], strict=False)])


def fingerprints_of(block: TextBlock, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """64-bit SimHash per document of a block, one column."""
    return lanes_of(*shingle_hashes(block, words, seed), block.n)


def lanes_of(hashes: np.ndarray, doc: np.ndarray, n: int, lanes: int = 1) -> np.ndarray:
    """64-bit SimHash per document and lane; lane 0 has the plain hashes, which are ordered by document.

    Eight bits are counted at a time, a byte each of a 64-bit sum, over pieces of at
    most 255 hashes of one document.
    """
    total = np.bincount(doc, minlength=n)
    present = np.flatnonzero(total)
    pieces = -(-total[present] // _PIECE)
    first = np.cumsum(pieces) - pieces
    start = (np.cumsum(total) - total)[present]
    cut = np.repeat(start, pieces) + (np.arange(int(pieces.sum())) - np.repeat(first, pieces)) * _PIECE
    ends = np.append(cut, len(hashes))
    counts = np.zeros((lanes, n, BITS), np.int32)
    parts = np.searchsorted(cut, np.arange(0, len(hashes), _CHUNK)).tolist()
    for lane in range(lanes):
        sums = []
        for a, b in zip(parts, [*parts[1:], len(cut)], strict=True):
            own = hashes[ends[a] : ends[b]]
            own = mix(own + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if lane else own
            if len(own):
                spread = _SPREAD[own.astype("<u8").view(np.uint8).reshape(-1, 8)]
                sums.append(np.add.reduceat(spread, cut[a:b] - cut[a], axis=0).astype("<u8").view(np.uint8).reshape(-1, BITS))
        if sums:
            counts[lane, present] = np.add.reduceat(np.concatenate(sums), first, axis=0, dtype=np.int32)
    packed = np.packbits(2 * counts > total[None, :, None], axis=2, bitorder="little").view("<u8")[:, :, 0]
    return packed.T.astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in text_blocks(batch, "text"):
                fp = fingerprints_of(block, words, seed)[:, 0].view(np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "fp": pa.array(fp)})

    return small_batches(docs).selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, "doc_id long, fp long")


def block_masks(bits: int = BITS, n_blocks: int = BLOCKS, budget: int = BUDGET) -> list[int]:
    """Masks of the bits that must agree: all choices of ``n_blocks - budget`` blocks."""
    edges = [bits * i // n_blocks for i in range(n_blocks + 1)]
    each = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n_blocks)]
    return [sum(c) for c in combinations(each, n_blocks - budget)]


def free_bits(values: np.ndarray, mask: int, n_bits: int = BITS) -> tuple[np.ndarray, int]:
    """The bits outside ``mask`` moved together, and how many there are."""
    out = np.zeros(len(values), np.uint64)
    depth = 0
    for bit in range(n_bits):
        if not mask >> bit & 1:
            out |= (values >> np.uint64(bit) & np.uint64(1)) << np.uint64(depth)
            depth += 1
    return out, depth


def trie_self_join(bucket: np.ndarray, suffix: np.ndarray, depth: int, budget: int, limit: int = 1 << 16, within_leaf: bool = True, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of entries in one bucket whose suffixes differ in at most ``budget`` bits.

    Entries are sorted by (bucket, suffix), so a trie node is a range; a node's
    children are split by a running count of ones.  Pairs of nodes descend a bit
    at a time; stacks of more than ``limit`` node pairs are worked off in parts.
    Without ``within_leaf``, entries with equal suffixes are not paired.  With
    ``group``, two nodes that hold nothing but one group are left at once.
    """
    n = len(suffix)
    turns = None if group is None else np.append(False, group[1:] != group[:-1]).cumsum()
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = np.append(cut[1:], n)
    big = ends - cut > 1
    ones: dict[int, np.ndarray] = {}
    lo, hi = cut[big], ends[big]
    stack = [(depth - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        if turns is not None and len(alo):
            other = (group[alo] != group[blo]) | (turns[ahi - 1] != turns[alo]) | (turns[bhi - 1] != turns[blo])
            alo, ahi, blo, bhi, err = (x[other] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        if len(alo) > limit:
            for part in range(0, len(alo), limit):
                s = slice(part, part + limit)
                stack.append((bit, alo[s], ahi[s], blo[s], bhi[s], err[s]))
            continue
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():  # two leaves: compare the rest at once
            a, b, e = alo[single], blo[single], err[single]
            rest = (suffix[a] ^ suffix[b]) & np.uint64((1 << (bit + 1)) - 1)
            ok = (e + np.bitwise_count(rest) <= budget) & (a != b)
            if ok.any():
                yield a[ok], b[ok]
            alo, ahi, blo, bhi, err = (x[~single] for x in (alo, ahi, blo, bhi, err))
        if bit < 0 or not len(alo):
            if len(alo):  # equal suffixes below both nodes
                sizes = (ahi - alo) * (bhi - blo)
                pair = np.repeat(np.arange(len(alo)), sizes)
                k = ranges(np.zeros(len(alo), np.int64), sizes)
                a, b = alo[pair] + k // (bhi - blo)[pair], blo[pair] + k % (bhi - blo)[pair]
                keep = (a < b) if within_leaf else suffix[a] != suffix[b]
                if keep.any():
                    yield a[keep], b[keep]
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum(suffix >> np.uint64(bit) & np.uint64(1))]).astype(np.int64)
        c = ones[bit]
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        own = (alo == blo) & (ahi == bhi)
        near = np.ones(len(alo), bool)
        parts = [
            (near, alo, amid, blo, bmid, err),
            (near, amid, ahi, bmid, bhi, err),
            (err < budget, alo, amid, bmid, bhi, err + 1),
            ((err < budget) & ~own, amid, ahi, blo, bmid, err + 1),
        ]
        child = []
        for ok, p, q, r, s, e in parts:
            ok = ok & (q > p) & (s > r) & ~((p == r) & (q - p == 1))
            child.append([x[ok] for x in (p, q, r, s, e.astype(np.int8))])
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*child, strict=True))))


def pairs_between_groups(bucket: np.ndarray, suffix: np.ndarray, group: np.ndarray, depth: int, budget: int, limit: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs of one bucket, at most ``budget`` bits apart, whose groups differ.

    Entries are sorted by (bucket, suffix, group).  Those equal in all three are
    joined as one, so a large group costs no comparison of its members.
    """
    start = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (suffix[1:] != suffix[:-1]) | (group[1:] != group[:-1])))
    size = np.diff(np.append(start, len(suffix)))
    for a, b in trie_self_join(bucket[start], suffix[start], depth, budget, group=group[start]):
        other = group[start[a]] != group[start[b]]
        a, b = a[other], b[other]
        # a row of one entry's partners at a time, so that no part is larger than limit and one row
        row, b = np.repeat(start[a], size[a]) + ranges(np.zeros(len(a), np.int64), size[a]), np.repeat(b, size[a])
        total = np.cumsum(size[b])
        at = 0
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
            yield np.repeat(row[at:to], size[b[at:to]]), ranges(start[b[at:to]], size[b[at:to]])
            at = to


def absorb(bucket: np.ndarray, suffix: np.ndarray, close) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Work off equal suffixes: (entries left, links made).

    Each leaf's first entry is compared with the others; those that are close are
    linked to it and stand back behind it, the rest go on with a leader of their
    own.  A leaf with thousands of near copies thus costs a comparison each.
    """
    pending, kept, made = np.arange(len(suffix)), [], []
    while len(pending):
        b, s = bucket[pending], suffix[pending]
        change = np.append(True, (b[1:] != b[:-1]) | (s[1:] != s[:-1]))
        kept.append(pending[change])
        leader, other = pending[change][np.cumsum(change) - 1][~change], pending[~change]
        ok = close(leader, other)
        made.append((leader[ok], other[ok]))
        pending = other[~ok]
    return np.sort(np.concatenate(kept)) if kept else pending, made


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Label of each of n entries: the smallest entry it is linked to, directly or not."""
    label = np.arange(n)
    for a, b in links:
        while True:
            x, y = label[a], label[b]
            low = np.minimum(x, y)
            if np.array_equal(x, y):
                break
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
    return label


def links(reps: DataFrame, budget: int = BUDGET, n_blocks: int = BLOCKS) -> DataFrame:
    """Edges (u, v) between representatives (rep, fp), a spanning forest per bucket."""
    spark = reps.sparkSession
    masks = block_masks(BITS, n_blocks, budget)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(signed)]))
    dealt = (
        reps.select("rep", "fp", table.alias("x"))
        .select(F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), "fp", "rep")
        .repartition(n, "t", "key")
        .sortWithinPartitions("t", "key")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, key, fp, rep in whole_buckets(batches):
            for table_no in np.unique(t).tolist():
                at = np.flatnonzero(t == table_no)
                suffix, depth = free_bits(fp[at].view(np.uint64), masks[table_no])
                bucket = np.cumsum(np.append(False, key[at][1:] != key[at][:-1]))
                order = np.lexsort((suffix, bucket))
                yield from forest_edges(rep[at][order], trie_self_join(bucket[order], suffix[order], depth, budget))

    return dealt.mapInArrow(join, "u long, v long")


def whole_buckets(batches: Iterator[pa.RecordBatch], least_rows: int = 200_000) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by their first two, cut only where a bucket ends."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows += batch.num_rows
        if rows >= least_rows:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            t, key = columns[:2]
            change = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1]))
            end = int(change[-1]) + 1 if len(change) else 0
            if end:
                yield [c[:end] for c in columns]
            held = [[c[end:] for c in columns]]
            rows = len(held[0][0])
    if rows:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def forest_edges(ids: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of a spanning forest of the pairs."""
    label = forest(len(ids), pairs)
    moved = np.flatnonzero(label != np.arange(len(ids)))
    if len(moved):
        yield pa.RecordBatch.from_pydict({"u": pa.array(ids[moved]), "v": pa.array(ids[label[moved]])})


#: 16 views of 32 bits; two of a view's four blocks agree, the 16 other bits may differ in 6.
VIEW_BITS, VIEW_BLOCKS, VIEW_AGREE, VIEW_BUDGET, LANES = 32, 4, 2, 6, 16
VIEW_LANES = 8
#: A first look at the distance takes 4 lanes and leaves 4 standard deviations, the second all 16 and 3.
LOOK_LANES, LOOK_SLACK, SLACK = 4, 4.0, 3.0


def bits_for_similarity(similarity: float, bits: int, slack: float = 1.0) -> int:
    """Differing bits expected at a set similarity (equal sizes), plus ``slack`` standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + slack * math.sqrt(bits * share * (1 - share)))


def view_masks() -> list[int]:
    return block_masks(VIEW_BITS, VIEW_BLOCKS, VIEW_BLOCKS - VIEW_AGREE)


def recall(similarity: float, draws: int = 20_000, seed: int = 0) -> float:
    """Share of pairs at a similarity that are proposed, by drawing differing bits independently."""
    rng = np.random.default_rng(seed)
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    differ = rng.random((draws, LANES * BITS)) < share
    near = differ[:, : LOOK_LANES * BITS].sum(axis=1) <= bits_for_similarity(0.8, LOOK_LANES * BITS, LOOK_SLACK)
    near &= differ.sum(axis=1) <= bits_for_similarity(0.8, LANES * BITS, SLACK)
    views = differ[:, : VIEW_LANES * BITS].reshape(draws, -1, VIEW_BITS)
    seen = np.zeros(draws, bool)
    for mask in view_masks():
        held = np.array([mask >> b & 1 for b in range(VIEW_BITS)], bool)
        seen |= (~views[:, :, held].any(axis=2) & (views[:, :, ~held].sum(axis=2) <= VIEW_BUDGET)).any(axis=1)
    return float((near & seen).mean())


def canonical(pairs: DataFrame, label: str) -> DataFrame:
    """Each unordered pair (u, v) once, written."""
    return materialise(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), label)


def shingle_sets(pairs: DataFrame, reps: DataFrame, source: DataFrame, words: int, seed: int) -> DataFrame:
    """(node, shingles) of the nodes of pairs: the distinct shingle hashes of the row that stands for a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in text_blocks(batch, "text"):
                hashes, _, size, _ = distinct_shingles(block, words, seed)
                ends = np.append(0, np.cumsum(size)).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"node": rows.column(1), "shingles": pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))})

    nodes = pairs.select(F.col("u").alias("node")).unionAll(pairs.select("v")).distinct()
    asked = reps.join(nodes, "node", "left_semi").select("node", "doc_id", "row")
    found = source.join(asked.hint("merge"), ["doc_id", "row"]).select("text", "node").mapInArrow(run, "node long, shingles array<long>")
    return materialise(found.dropDuplicates(["node"]), "simhash-sets")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes whose shingle sets have a Jaccard similarity of at least ``similarity``."""
    common = F.size(F.array_intersect("a", "b"))
    return (
        pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
        .join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
        .select("u", "v", common.alias("common"), (F.size("a") + F.size("b")).alias("both"))
        .where(F.col("common") / (F.col("both") - F.col("common")) >= F.lit(float(similarity)))
        .select("u", "v")
    )


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, seed: int = SEED) -> DataFrame:
    """(doc_id, row, class, component_id): documents linked where their shingle sets have ``similarity`` or more.

    1024-bit fingerprints propose the pairs (:func:`recall` gives the share found),
    the shingle sets decide.  Documents with one set, told by a 128-bit digest, are
    one node.  Links are looked for in three rounds, each between nodes that are
    still apart: stars among equal views, then each node's nearest proposed partner,
    then every proposed pair.  The last round makes the result whole; the rounds
    before it keep a group of near copies from being verified pair by pair.
    """
    spark = docs.sparkSession
    lanes = [f"f{k}" for k in range(LANES)]
    masks = view_masks()
    first_look = bits_for_similarity(similarity, LOOK_LANES * BITS, LOOK_SLACK)
    full_look = bits_for_similarity(similarity, LANES * BITS, SLACK)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in text_blocks(batch, "text"):
                hashes, doc, size, (high, low) = distinct_shingles(block, words, seed)
                fp = lanes_of(hashes, doc, block.n, LANES).view(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": rows.column(0), "row": rows.column(1), "high": pa.array(high.view(np.int64)), "low": pa.array(low.view(np.int64)), "n": pa.array(size.astype(np.int64))}
                    | {c: pa.array(np.ascontiguousarray(fp[:, k])) for k, c in enumerate(lanes)}
                )

    source = row_keys.keyed(docs, id_col, text_col)
    marked = materialise(source.mapInArrow(mark, "doc_id long, row binary, high long, low long, n long, " + ", ".join(f"{c} long" for c in lanes)), "simhash-lanes")
    least = F.min(F.struct(F.col("doc_id"), F.col("row")))
    grouped = marked.where("doc_id IS NOT NULL").groupBy("high", "low", "n", *lanes).agg(least.alias("x"))
    # written once, so a node's number stays what it is
    reps = materialise(grouped.select(F.monotonically_increasing_id().alias("node"), "high", "low", "n", *lanes, "x.doc_id", "x.row"), "simhash-reps")
    views = [F.shiftrightunsigned(c, 32 * half).bitwiseAND(F.lit((1 << 32) - 1)) for c in lanes[:VIEW_LANES] for half in (0, 1)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: DataFrame, held: list[str], keep: list[int]) -> DataFrame:
        """(t, key, w, node, n, part, lanes) with each table's buckets together; ``keep`` are the masks of a view's tables."""
        tables = [F.struct(F.lit(i * len(keep) + j).alias("t"), v.alias("w"), F.lit(m).cast("long").alias("m")) for i, v in enumerate(views) for j, m in enumerate(keep)]
        return (
            rows.select("node", "n", "part", *lanes, F.explode(F.array(*tables)).alias("x"))
            .select(F.col("x.t").alias("t"), F.col("x.w").bitwiseAND(F.col("x.m")).alias("key"), F.col("x.w").alias("w"), "node", "n", "part", *held)
            .repartition(parts, "t", "key")
            .sortWithinPartitions("t", "key", "node")
        )

    def distance(fps: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum((np.bitwise_count(f[a] ^ f[b]).astype(np.int64) for f in fps), np.zeros(len(a), np.int64))

    def alike(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b])

    def unsigned(columns: list[np.ndarray]) -> list[np.ndarray]:
        return [c.view(np.uint64) for c in columns]

    def edges(node: np.ndarray, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for a, b in pairs:
            if len(a):
                yield pa.RecordBatch.from_pydict({"u": pa.array(node[a]), "v": pa.array(node[b])})

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, key, _, node, n, _, *fps in whole_buckets(batches):
            leaf, fps = np.append(False, (t[1:] != t[:-1]) | (key[1:] != key[:-1])).cumsum(), unsigned(fps)
            yield from edges(node, absorb(leaf, key, lambda a, b, n=n, fps=fps: (distance(fps, a, b) <= first_look) & alike(n, a, b))[1])

    def tables_of(columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]]:
        """(table, columns in trie order, pairs of different parts) of each table met."""
        t, key, view, node, n, part, *fps = columns
        for table_no in np.unique(t).tolist():
            at = np.flatnonzero(t == table_no)
            suffix, depth = free_bits(view[at].view(np.uint64), masks[table_no % len(masks)], VIEW_BITS)
            bucket = np.cumsum(np.append(False, key[at][1:] != key[at][:-1]))
            order = np.lexsort((node[at], part[at], suffix, bucket))
            own = [c[at][order] for c in (node, n, part, *fps)]
            yield table_no, own, pairs_between_groups(bucket[order], suffix[order], own[2], depth, VIEW_BUDGET)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each node's closest partner of another part, by the first look."""
        for columns in whole_buckets(batches):
            for _, (node, n, _, *fps), pairs in tables_of(columns):
                fps, best, partner = unsigned(fps), np.full(len(node), first_look + 1), np.full(len(node), -1)
                for a, b in pairs:
                    ok = alike(n, a, b)
                    a, b = a[ok], b[ok]
                    apart = distance(fps, a, b)
                    for x, y in ((a, b), (b, a)):
                        order = np.lexsort((node[y], apart, x))  # ties by node, not by place
                        lead = order[np.append(True, x[order[1:]] != x[order[:-1]])] if len(order) else order
                        lead = lead[apart[lead] < best[x[lead]]]
                        best[x[lead]], partner[x[lead]] = apart[lead], y[lead]
                some = np.flatnonzero(partner >= 0)
                if len(some):
                    yield pa.RecordBatch.from_pydict({"u": pa.array(node[some]), "v": pa.array(node[partner[some]]), "apart": pa.array(best[some])})

    def seen_before(fps: list[np.ndarray], a: np.ndarray, b: np.ndarray, table_no: int) -> np.ndarray:
        """Which pairs an earlier table proposes too."""
        out = np.zeros(len(a), bool)
        for t in range(table_no):
            view, mask = t // len(masks), masks[t % len(masks)]
            lane = fps[view // 2]
            differ = (lane[a] ^ lane[b]) >> np.uint64(32 * (view % 2)) & np.uint64((1 << 32) - 1)
            out |= (differ & np.uint64(mask) == 0) & (np.bitwise_count(differ) <= VIEW_BUDGET)
        return out

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each pair of different parts that passes the full look, from the first table that proposes it."""
        for columns in whole_buckets(batches):
            for table_no, (node, n, _, *fps), pairs in tables_of(columns):
                fps = unsigned(fps)

                def kept(a: np.ndarray, b: np.ndarray, n=n, fps=fps, table_no=table_no) -> tuple[np.ndarray, np.ndarray]:
                    for test in (lambda a, b: alike(n, a, b), lambda a, b: distance(fps[:LOOK_LANES], a, b) <= first_look, lambda a, b: distance(fps, a, b) <= full_look, lambda a, b: ~seen_before(fps, a, b, table_no)):
                        ok = test(a, b)
                        a, b = a[ok], b[ok]
                    return a, b

                yield from edges(node, (kept(a, b) for a, b in pairs))

    def with_parts(links: DataFrame) -> DataFrame:
        return reps.join(connected_components(links), "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")

    look = lanes[:LOOK_LANES]
    whole = [(1 << VIEW_BITS) - 1]
    starred = canonical(dealt(reps.withColumn("part", F.lit(0).cast("long")), look, whole).mapInArrow(stars, "u long, v long"), "simhash-stars")
    made = materialise(verified(starred, shingle_sets(starred, reps, source, words, seed), similarity), "simhash-starred")
    apart = materialise(with_parts(made), "simhash-parts")
    proposed = dealt(apart, look, masks).mapInArrow(nearest, "u long, v long, apart long")
    partner = materialise(proposed.groupBy("u").agg(F.min(F.struct("apart", "v")).alias("x")).select("u", F.col("x.v").alias("v")), "simhash-nearest")
    # a node without a proposed partner in another part has none in the last round either
    sets = shingle_sets(partner, reps, source, words, seed)
    made = materialise(made.unionAll(verified(canonical(partner, "simhash-pairs"), sets, similarity)), "simhash-near")
    open_ = materialise(with_parts(made).join(partner.select(F.col("u").alias("node")), "node", "left_semi"), "simhash-open")
    last = canonical(dealt(open_, lanes, masks).mapInArrow(every, "u long, v long"), "simhash-last")
    roots = connected_components(made.unionAll(verified(last, sets, similarity)))
    rooted = reps.join(roots, "node", "left").select("high", "low", "n", F.coalesce("root", "node").alias("class"), "doc_id")
    # written first, so that the join may split a class that very many nodes are in
    ids = materialise(rooted.groupBy("class").agg(F.min("doc_id").alias("component_id")), "simhash-classes")
    by_set = rooted.join(ids, "class").select("high", "low", "n", "class", "component_id")
    return marked.select("doc_id", "row", "high", "low", "n").join(by_set, ["high", "low", "n"], "left").select("doc_id", "row", "class", "component_id")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, budget: int = BUDGET, n_blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest id reachable."""
    marked = materialise(fingerprints(docs, id_col, text_col, words, seed), "simhash")
    reps = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    roots = connected_components(links(reps.where("rep IS NOT NULL"), budget, n_blocks))
    by_fp = reps.join(roots, reps["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row (all columns) of each component of similar documents: the smallest id, then the smallest text key."""
    classes = similar_components(docs, id_col, text_col, **options).withColumnRenamed("component_id", "keep_id")
    return row_keys.keep_least(docs, classes, id_col, text_col)
