"""Exact deduplication by Grace hashing.

Records are partitioned by a hash of their content, first inside each input
partition and then, for one representative of each content and partition,
across the cluster.  Inside a task a bucket larger than the memory budget is
split to spill files on further hash bits, recursively, until it fits an
open-addressing table that compares complete content; equal hashes alone never
merge two records.  Copies meet in their own input partition first, so a group
that holds a third of all rows reaches the exchange as one row per partition.

Members are passed on as soon as they are read, so a table holds contents and a
count each, however many rows share one; the merge holds one entry for each
input partition that has a content.

Nulls count as empty text.  :func:`classes` returns every row; where the smallest
doc_id of a class stands on several rows, all of them are marked as kept.
:func:`deduplicate` keeps one row of a class: the smallest id (a null id sorts
last), then the smallest SHA-256 of its text; of rows equal in both, any one.
An empty table gives no rows.  Extra columns are not read and may have any name.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import re
import tempfile
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlattice.llm import rows as row_keys
from flowlattice.llm.storage import materialise

MEMORY_BYTES = 48 << 20
FANOUT = 16
_BLANK = re.compile(rb"[\x20\x09-\x0D]+")


def normalise(text: str | None) -> bytes:
    """UTF-8 with each run of ASCII white space replaced by one space."""
    return _BLANK.sub(b" ", (text or "").encode())


class OpenAddressingTable:
    """Linear probing over a power-of-two slot array; keys compare by full content."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 64
        self.hashes: list[int] = []
        self.keys: list[bytes] = []
        self.values: list = []
        self.bytes = 0

    def find(self, digest: int, key: bytes) -> tuple[int, bool]:
        """(entry, whether it was there); adds the key if it was not."""
        mask = len(self.slots) - 1
        at = digest & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == digest and self.keys[entry] == key:
                return entry, True
            at = (at + 1) & mask
        entry = self.slots[at] = len(self.keys)
        self.hashes.append(digest)
        self.keys.append(key)
        self.values.append(None)
        self.bytes += len(key) + 200
        if 3 * len(self.keys) > 2 * len(self.slots):
            self._grow()
        return entry, False

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, digest in enumerate(self.hashes):
            at = digest & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


Fold = Callable[[object, object], object]


class GraceGroups:
    """Groups (hash, content, payload) records by complete content.

    ``fold(state, payload)`` takes a record into its group's state, which is None at
    first; a state folds into another one as well.  The table holds each content
    once.  When it outgrows ``budget``, its entries and the records still to come go
    to ``FANOUT`` spill files by the next hash bits; each file is grouped in turn.
    """

    def __init__(self, fold: Fold, budget: int = MEMORY_BYTES, level: int = 0, digest_bits: int = 64):
        self.fold, self.budget, self.level, self.digest_bits = fold, budget, level, digest_bits
        self.table = OpenAddressingTable()
        self.folder: tempfile.TemporaryDirectory | None = None
        self.files: list = []

    def add(self, digest: int, content: bytes, payload: object) -> None:
        if self.files:
            self._spill(digest, content, payload)
            return
        entry, _ = self.table.find(digest, content)
        self.table.values[entry] = self.fold(self.table.values[entry], payload)
        if self.table.bytes > self.budget and len(self.table.keys) > 1 and (self.level + 1) * 4 <= self.digest_bits:
            self.folder = tempfile.TemporaryDirectory(prefix="grace-")
            self.files = [open(os.path.join(self.folder.name, str(i)), "w+b") for i in range(FANOUT)]  # noqa: SIM115
            for record in zip(self.table.hashes, self.table.keys, self.table.values, strict=True):
                self._spill(*record)
            self.table = OpenAddressingTable()

    def _spill(self, digest: int, content: bytes, payload: object) -> None:
        file = self.files[(digest >> (self.digest_bits - 4 * (self.level + 1))) & (FANOUT - 1)]
        pickle.dump((digest, content, payload), file, pickle.HIGHEST_PROTOCOL)

    def groups(self) -> Iterator[tuple[bytes, object]]:
        """(content, state) of every group, once all records are in."""
        if not self.files:
            yield from zip(self.table.keys, self.table.values, strict=True)
            return
        try:
            for file in self.files:
                file.seek(0)
                part = GraceGroups(self.fold, self.budget, self.level + 1, self.digest_bits)
                while True:
                    try:
                        part.add(*pickle.load(file))
                    except EOFError:
                        break
                file.truncate(0)
                yield from part.groups()
        finally:
            for file in self.files:
                file.close()
            self.folder.cleanup()


def _batches(rows: Iterator[tuple], schema: pa.Schema, text_at: int | None = None, limit_bytes: int = 8 << 20, limit_rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[text_at]) if text_at is not None and row[text_at] is not None else 0
        if len(held) >= limit_rows or size >= limit_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_MEMBER = pa.schema([("doc_id", pa.int64()), ("row", pa.binary()), ("digest", pa.binary()), ("part", pa.int64()), ("n", pa.int64()), ("content", pa.binary())])
_MEMBER_SQL = "doc_id long, row binary, digest binary, part long, n long, content binary"
_CLASS = pa.schema([("part", pa.int64()), ("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
_CLASS_SQL = "part long, digest binary, keep_id long, group_size long"
_NO_ID = 1 << 63  # after every id


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normaliser: Callable[[str | None], bytes] = normalise, budget: int = MEMORY_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest (SHA-256 of the content), row (of the text).

    ``kept`` marks the rows with the smallest id of their class; a null id sorts last.
    """
    return _classes(row_keys.keyed(docs, id_col, text_col), normaliser, budget)


def _classes(source: DataFrame, normaliser: Callable[[str | None], bytes], budget: int) -> DataFrame:
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        table = GraceGroups(_least_and_count, budget)
        for batch in batches:
            members = []
            for i, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                content = normaliser(text.as_py())
                sha = hashlib.sha256(content).digest()
                members.append((i, row, sha, part, None, None))
                table.add(int.from_bytes(sha[8:16], "little"), content, (_NO_ID if i is None else i, 1))
            yield from _batches(iter(members), _MEMBER)
        found = table.groups()
        yield from _batches(((_id(least), None, hashlib.sha256(content).digest(), part, n, content) for content, (least, n) in found), _MEMBER, 5)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = GraceGroups(_least_count_parts, budget)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:4]]
            for part, i, n, sha, content in zip(*columns, batch.column(4), strict=True):
                table.add(int.from_bytes(sha[8:16], "little"), content.as_py(), (_NO_ID if i is None else i, n, array("q", [part])))

        def rows() -> Iterator[tuple]:
            for content, (least, n, parts) in table.groups():
                sha = hashlib.sha256(content).digest()
                for part in parts:
                    yield part, sha, _id(least), n

        yield from _batches(rows(), _CLASS)

    held = materialise(source.mapInArrow(local, _MEMBER_SQL), "exact-local")
    n = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (
        held.where("content IS NOT NULL")
        .select("part", F.col("doc_id").alias("least"), "n", "digest", "content")
        .repartition(n, "digest")
        .mapInArrow(merge, _CLASS_SQL)
    )
    # an input partition names its contents by their digest; the contents themselves were compared
    return (
        held.where("content IS NULL").select("doc_id", "row", "part", "digest")
        .join(found, ["part", "digest"])
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", "row")
    )


def _id(least: int) -> int | None:
    return None if least == _NO_ID else least


def _least_and_count(state: tuple | None, payload: tuple) -> tuple:
    return payload if state is None else (min(state[0], payload[0]), state[1] + payload[1])


def _least_count_parts(state: tuple | None, payload: tuple) -> tuple:
    if state is None:
        return payload
    state[2].extend(payload[2])
    return min(state[0], payload[0]), state[1] + payload[1], state[2]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (all columns) of each class of equal texts: the smallest id, then the smallest text key."""
    return row_keys.keep_least(docs, classes(docs, id_col, text_col).withColumnRenamed("digest", "class"), id_col, text_col)
