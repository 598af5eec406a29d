"""Skill taxonomies: exact, alias and fuzzy matching as joins."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.constants import FUZZY_ABOVE
from ..functions.normalize import strip


def load(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of ``paths`` that exists and holds JSON of ``{key: {canonical, aliases, category}}``; else an empty taxonomy."""
    for path in paths:
        try:
            with open(path, encoding="utf-8") as f:
                return from_dict(spark, json.load(f))
        except (OSError, ValueError):
            continue
    return from_dict(spark, {})


def from_dict(spark: SparkSession, taxonomy: dict) -> DataFrame:
    """``tax_ord, term, is_alias, key, canonical``: one row for each key and alias, in the taxonomy's order."""
    rows = [(n, term.lower(), alias, key, entry["canonical"]) for n, (key, entry) in enumerate(taxonomy.items()) for term, alias in [(key, False), *((a, True) for a in entry.get("aliases") or [])]]
    return spark.createDataFrame(rows, "tax_ord int, term string, is_alias boolean, key string, canonical string")


def best_terms(taxonomy: DataFrame) -> DataFrame:
    """For each term the entry that wins: the earliest key, its own name before its aliases."""
    order = F.struct("tax_ord", F.col("is_alias").cast("int").alias("a"))
    return taxonomy.groupBy("term").agg(F.min_by(F.struct("key", "canonical", "is_alias", "tax_ord"), order).alias("e")).select(F.col("term").alias("_t"), "e.*")


def exact_match(rows: DataFrame, taxonomy: DataFrame, term: str) -> DataFrame:
    """``rows`` with ``_canonical`` and ``_is_alias`` by equality of the column ``term`` with a term.

    Spark sends the terms to every task where their size, known by then, allows it.
    """
    terms = best_terms(taxonomy).select("_t", F.col("canonical").alias("_canonical"), F.col("is_alias").alias("_is_alias"))
    return rows.join(terms, F.col(term) == F.col("_t"), "left").drop("_t")


def _indel(a: str, b: str) -> float:
    """100 * 2 * (longest common subsequence) / (both lengths), by bit-parallel rows."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        u = row & masks.get(c, 0)
        row = (row + u | row - u) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity from 0 to 100 by insertions and deletions."""
    return pd.Series([None if x is None or y is None else _indel(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def fuzzy_match(tokens: DataFrame, taxonomy: DataFrame, token: str = "token") -> DataFrame:
    """``token, key, canonical, fuzzy_score`` for each distinct token like a key: the first key above the limit wins.

    Pairs meet by length: a ratio above 85 needs lengths within a factor of
    0.739, so a token meets keys of lengths near its own (an equi-join on
    length), and the edit distance, which never exceeds insertions and
    deletions, filters before the exact ratio.
    """
    keys = taxonomy.where(~F.col("is_alias")).select("key", "canonical", "tax_ord").distinct().withColumn("size", F.length("key"))
    need = 1 - FUZZY_ABOVE / 100
    low, high = F.ceil(F.length(token) * (1 - need) / (1 + need)).cast("int"), F.floor(F.length(token) * (1 + need) / (1 - need)).cast("int")
    spread = tokens.select(token).distinct().where(F.length(token) > 0).withColumn("size", F.explode(F.sequence(low, F.greatest(low, high))))
    near = spread.join(keys, "size").where(F.levenshtein(token, "key") < need * (F.length(token) + F.length("key")))
    scored = near.withColumn("fuzzy_score", indel_ratio(F.col(token), F.col("key"))).where(F.col("fuzzy_score") > FUZZY_ABOVE)
    return scored.groupBy(token).agg(F.min_by(F.struct("key", "canonical", "fuzzy_score"), "tax_ord").alias("m")).select(token, "m.*")


def match_tokens(tokens: DataFrame, taxonomy: DataFrame, fuzzy: bool = True) -> DataFrame:
    """``tokens`` (with a column token) with ``canonical_name, match_type, fuzzy_score``: exact and alias first, then fuzzy, else unverified."""
    rows = exact_match(tokens.withColumn("_term", F.lower(strip("token"))), taxonomy, "_term")
    if fuzzy:
        rest = rows.where(F.col("_canonical").isNull()).select("_term").distinct()
        found = fuzzy_match(rest, taxonomy, "_term").select(F.col("_term").alias("_f"), F.col("canonical").alias("_fc"), F.col("fuzzy_score").alias("_fs"))
        rows = rows.join(found, F.col("_term") == F.col("_f"), "left")
    else:
        rows = rows.withColumns({"_f": F.lit(None).cast("string"), "_fc": F.lit(None).cast("string"), "_fs": F.lit(None).cast("double")})
    kind = F.when(F.col("_canonical").isNotNull(), F.when(F.col("_is_alias"), "alias").otherwise("exact")).when(F.col("_fc").isNotNull(), "fuzzy").otherwise("unverified")
    return rows.withColumns({"canonical_name": F.coalesce("_canonical", "_fc", "token"), "match_type": kind, "fuzzy_score": F.col("_fs")}).drop("_term", "_canonical", "_is_alias", "_f", "_fc", "_fs")
