"""Rows told apart without a key of their own: by id and whole text.

An id may stand on several rows.  Operators that drop rows name a row by its id
and the SHA-256 of its text, so a row never goes because another one of the same
id does; whole copies of a kept row (same id, same text) are reduced to one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlattice.llm.storage import materialise, small_batches


def fresh(name: str, taken: Sequence[str]) -> str:
    """``name``, with underscores put before it until no column has it (in any case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def text_key(text: Column) -> Column:
    """SHA-256 of a whole text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, text): the columns that the operators read."""
    text = F.col(f"`{text_col}`").cast("string")
    return small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(text).alias("row"), text.alias("text"))


def keep_least(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` (all columns) that are the least of their class, one each.

    ``classes`` has (doc_id, row, class, keep_id) per input row, keyed as in
    :func:`keyed`; keep_id is the smallest id of the class.  If it stands on several
    rows of the class, the one with the smallest text key stays; of whole copies any
    one.  Rows without a class stay.
    """
    classes = materialise(classes.where("class IS NOT NULL").select("doc_id", "row", "class", "keep_id"), "row-classes")
    least = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    stays = F.lit(False)
    dropped = classes.where(~least).select("doc_id", "row", stays.alias("stays")).distinct()
    kept = classes.where(least).groupBy("class", "doc_id", "row").agg(F.count("*").alias("n"))
    kept = materialise(kept, "row-kept")
    several = kept.groupBy("class").agg(F.min("row").alias("least_row"), F.sum("n").alias("total")).where("total > 1").drop("total")
    repeated = kept.join(several, "class").select("doc_id", "row", (F.col("row") == F.col("least_row")).alias("stays"))
    marks = materialise(dropped.unionAll(repeated), "row-marks").hint("merge")  # one plan at every size
    names = docs.columns
    row_name, id_mark, row_mark, stay_mark = (fresh(n, names) for n in ("row", "doc_id_mark", "row_mark", "stays_mark"))
    marks = marks.select(F.col("doc_id").alias(id_mark), F.col("row").alias(row_mark), F.col("stays").alias(stay_mark))
    own = docs.withColumn(row_name, text_key(F.col(f"`{text_col}`")))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(id_mark)) & (F.col(row_name) == F.col(row_mark))
    columns = [F.col(f"`{c}`") for c in names]
    if marks.where(stay_mark).limit(1).isEmpty():  # no id stands on several rows of a class
        return own.join(marks, same, "left_anti").select(*columns)
    marked = own.join(marks, same, "left")
    copies = marked.where(stay_mark).dropDuplicates([id_mark, row_mark])
    return marked.where(F.col(stay_mark).isNull()).select(*columns).unionAll(copies.select(*columns))


def drawn(rows: DataFrame, size: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """The rows of about ``size`` ids (of each group), or of all if there are fewer.

    A row is taken if a keyed hash of its id lies below the share asked for, so the
    draw is the same on every run and no ranking is needed; the number of ids varies
    by the root of ``size``.
    """
    counts = rows.groupBy(*by).agg(F.approx_count_distinct("doc_id", 0.02).alias("ids_of_group"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    if by:  # a row per group
        share = F.lit(float(size)) / F.greatest(F.col("ids_of_group"), F.lit(1))
        return rows.join(F.broadcast(counts), list(by)).where(draw < share).drop("ids_of_group")
    return rows.where(draw < size / max(1, counts.first()[0]))


def one_per_id(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(doc_id, by..., text): the greatest text of each id, by partial aggregates, so an id on very many rows stays one."""
    return rows.groupBy("doc_id", *by).agg(F.max("text").alias("text"))
