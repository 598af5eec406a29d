"""A corpus pipeline: documents in, encoded documents out, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
kept; what it returns is written as Parquet and read again for the next.  A stage
needs the columns doc_id and text; others are carried along.  In every stage an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimweave.llm import bpe, decontaminate, linededup, neardedup, quality
from claimweave.llm.store import input_table, made, remove_since, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; the others go.

    Null and empty texts are scored like any other.  Repeated rows have equal
    scores, so all or none of them stay.  Without labels all stay.
    """
    return quality.good(docs, input_table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere; a text that has lost all its words goes.

    A column n_chars, if there is one, follows the new text.  Null and empty
    texts stay as they are.  Repeated rows count as one document and stay.
    """
    kept = linededup.deduplicated(docs).where("n_dropped = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return kept.selectExpr(*(f"case when n_dropped > 0 then cast(length(text) as {docs.schema[c].dataType.simpleString()}) else {c} end as {c}" if c.lower() == "n_chars" else f"`{c}`" for c in docs.columns))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id: SimHash fingerprints at most 2 bits apart, or five-word shingles at Jaccard similarity 0.8.

    Texts without words, null included, are copies of one another.  Of rows that
    share a doc_id one stays; rows without doc_id stay, those of equal texts once.
    """
    return neardedup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none.  Items without id or text are passed over.
    Of rows that share a doc_id only those go whose own text holds an item.
    """
    return decontaminate.clean(docs, input_table(spark, sf_dir, "benchmark"), short=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, their number, and the digests of ids and decoded text.

    Null and empty texts have no ids; repeated rows stay.
    """
    return bpe.round_trip(docs, keep_ids=True)


STAGES = [("quality", keep_good), ("line_dedup", drop_repeated_lines), ("near_dedup", one_of_near_copies), ("decontamination", drop_contaminated), ("bpe", encode)]

#: No stage of these can be expressed in SQL whole; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, in order; a stage's tables go when the next has been written."""
    docs, last = input_table(spark, sf_dir, "documents"), None
    before = made()
    for name, stage in STAGES[:-1]:
        docs, last = written(stage(spark, docs, sf_dir), name, "zstd")
        remove_since(spark, before, last)
    return STAGES[-1][1](spark, docs, sf_dir)
