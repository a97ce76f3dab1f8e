"""Labelled rows for fitting: a bounded sample that never holds out-of-fold rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of each class that a classifier is fitted on, and the longest text among them, in characters.
#: Both bound what the driver holds; scoring always covers every row and every whole text.
PER_CLASS, MAX_CHARS = 1500, 20_000
FOLDS = 5


def held_out(doc_id: Column | str) -> Column:
    """Whether a row's labels are kept from fitting: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fitting_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> list[tuple[str, int]]:
    """(text, label) of at most ``per_class`` rows of each class, taken in the order of a hash of their ids."""
    usable = labels.select("doc_id", F.col(label).alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id"))
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y"))
    first = [usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(first[0].unionByName(first[1]))  # at most 2 * per_class ids
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").where(F.length("text").between(1, max_chars))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * per_class).collect()
    return [(r.text, int(r.y)) for r in rows]
