"""Bounded samples of labelled documents, and the split that keeps some labels out of training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int) -> tuple[list[str], list[int], float]:
    """Texts and labels to learn from, and the share of label 1 among all rows that may be learnt from.

    At most ``rows`` of each label, those with the smallest hash of doc_id; texts
    over ``most_bytes`` are left out (never cut).  Both are the documented bounds
    of what comes to the driver.  Only ids outside the held-out fifth count.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out()).select("doc_id", F.col(label).cast("int").alias("y"))
    share = known.agg(F.avg("y")).first()[0]
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).groupBy("doc_id", "y").count().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "y")
        chosen = part if chosen is None else chosen.unionByName(part)
    found = docs.where(F.octet_length("text") <= most_bytes).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    return found.column("text").to_pylist(), found.column("y").to_pylist(), 0.5 if share is None else share
