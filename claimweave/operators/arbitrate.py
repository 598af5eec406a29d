"""Arbitration: corroboration, then one strategy for each field.

Everything is grouped by entity first.  Each strategy ends in one row per entity
and field, so Catalyst can prune those whose columns a projection never reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CONTACT_WEIGHTS, CORROBORATION, MARGIN, URL_FIELDS, WEIGHTS, YEARS_CONFIDENCE
from ..functions.normalize import literal_map, month_index, strip, title_case


def equality_key(field: Column, value: Column) -> Column:
    """Claims of a field are equal if their keys are; null equals nothing."""
    lower = F.lower(strip(value))
    return F.when(field.isin("email", "full_name"), lower).when(field == "phone", strip(value)).when(field.isin(*URL_FIELDS), F.rtrim(lower, F.lit("/"))).otherwise(value)


def union_key(field: Column, value: Column) -> Column:
    lower = F.rtrim(strip(F.lower(value)), F.lit("/"))
    return F.when(field.isin("email", *URL_FIELDS), lower).otherwise(strip(value))


def boosted(confidence: Column, equal: Column) -> Column:
    """A bonus for each other equal claim, added one at a time and capped at 1 each time."""
    return F.when(equal > 1, F.aggregate(F.sequence(F.lit(1), F.greatest(equal - 1, F.lit(1)).cast("int")), confidence, lambda acc, _: F.least(F.lit(1.0), acc + F.lit(CORROBORATION)))).otherwise(confidence)


def corroborate(claims: DataFrame) -> DataFrame:
    """Claims with raised ``confidence`` and ``corroborated_by``, by counting equal claims (no self-join).

    A claim's corroborators are the sources of the other equal claims, its own
    too if it gave the value twice, in sorted order.
    """
    key = equality_key(F.col("field"), F.col("normalized_value"))
    w = Window.partitionBy("entity_id", "field", "_key")
    rows = claims.withColumn("_key", key).withColumns({"_n": F.when(F.col("_key").isNull(), 1).otherwise(F.count("*").over(w)), "_same": F.count("*").over(w.partitionBy("entity_id", "field", "_key", "source")), "_all": F.collect_set("source").over(w)})
    others = F.when((F.col("_key").isNull()) | (F.col("_n") == 1), F.array().cast("array<string>")).when(F.col("_same") > 1, F.col("_all")).otherwise(F.array_except("_all", F.array("source")))
    by = F.array_sort(F.array_union(F.coalesce("corroborated_by", F.array().cast("array<string>")), others))
    return rows.withColumns({"confidence": boosted(F.col("confidence"), F.col("_n")), "corroborated_by": by}).drop("_key", "_n", "_same", "_all")


def union_values(claims: DataFrame) -> DataFrame:
    """One row for each distinct value of an entity's field, best first by ``rank`` (from 1).

    The value is the first seen; confidence, source and method are those of its
    best claim, the earliest among equals.
    """
    rows = claims.where(F.col("normalized_value").isNotNull()).withColumn("_key", union_key(F.col("field"), F.col("normalized_value")))
    best = F.struct("confidence", -F.col("ord"))
    values = rows.groupBy("entity_id", "field", "_key").agg(
        F.min_by("normalized_value", "ord").alias("value"), F.min("ord").alias("first_ord"), F.max("confidence").alias("confidence"),
        F.max_by("source", best).alias("source"), F.max_by("extraction_method", best).alias("method"), F.array_sort(F.collect_set("source")).alias("sources"),
    )
    return values.withColumn("rank", F.row_number().over(Window.partitionBy("entity_id", "field").orderBy(F.desc("confidence"), "first_ord"))).drop("_key")


def union_fields(claims: DataFrame) -> DataFrame:
    """``entity_id, field, values, winning_*`` of union fields: all distinct values, best first."""
    item = F.struct((-F.col("confidence")).alias("c"), "first_ord", "value")
    head = F.struct("confidence", -F.col("first_ord"))
    return union_values(claims).groupBy("entity_id", "field").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["value"]).alias("values"), F.max_by("source", head).alias("winning_source"), F.max_by("method", head).alias("winning_method"), F.max("confidence").alias("winning_confidence"),
    )


def highest_confidence(claims: DataFrame) -> DataFrame:
    """The winner of each entity and field, and whether another value stands within the margin of it.

    Of claims within the margin of the best, a structured source goes first,
    then confidence, then order.
    """
    rows = claims.where(F.col("normalized_value").isNotNull()).withColumn("_max", F.max("confidence").over(Window.partitionBy("entity_id", "field")))
    eligible = F.col("_max") - F.col("confidence") <= F.lit(MARGIN)
    order = F.struct((F.col("source_type") == "structured").cast("int").alias("s"), F.col("confidence").alias("c"), (-F.col("ord")).alias("o"))
    claim = F.struct("normalized_value", "source", F.col("extraction_method").alias("method"), "confidence", "ord")
    groups = rows.groupBy("entity_id", "field").agg(F.max_by(claim, F.when(eligible, order)).alias("w"), F.collect_set(F.struct("normalized_value", "confidence")).alias("_all"))
    conflict = F.exists("_all", lambda x: (x["normalized_value"] != F.col("w.normalized_value")) & (F.abs(F.col("w.confidence") - x["confidence"]) <= F.lit(MARGIN)))
    return groups.select("entity_id", "field", F.col("w.normalized_value").alias("value"), F.col("w.source").alias("winning_source"), F.col("w.method").alias("winning_method"), F.col("w.confidence").alias("winning_confidence"), F.col("w.ord").alias("winning_ord"), conflict.alias("conflict_detected"))


def union_skills(claims: DataFrame) -> DataFrame:
    """``entity_id, name, confidence, sources, rank``: skills pooled by name, with a bonus for more than one source."""
    name = strip(F.when(F.col("match_type") == "unverified", title_case(F.col("raw_value"))).otherwise(F.col("canonical_name")))
    rows = claims.where(F.col("field") == "skills").withColumn("name", name).where("name <> ''")
    groups = rows.groupBy("entity_id", "name").agg(F.max("confidence").alias("c"), F.array_sort(F.collect_set("source")).alias("sources"), F.min("ord").alias("first_ord"))
    confidence = F.bround(F.when(F.size("sources") > 1, F.least(F.lit(1.0), F.col("c") + F.lit(CORROBORATION))).otherwise(F.col("c")), 3)
    groups = groups.withColumn("confidence", confidence)
    return groups.withColumn("rank", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("confidence"), "first_ord"))).select("entity_id", "name", "confidence", "sources", "rank")


def years_of_experience(intervals: DataFrame) -> DataFrame:
    """``entity_id, years, total_months, concurrent_roles`` from inclusive month intervals ``entity_id, s, e, ord``.

    Overlapping intervals are merged by gaps and islands; years are rounded
    half to even at one decimal.
    """
    w = Window.partitionBy("entity_id").orderBy("s", "ord")
    islands = intervals.withColumn("_reach", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_new", (F.col("_reach").isNull() | (F.col("s") > F.col("_reach"))).cast("int"))
    islands = islands.withColumn("_island", F.sum("_new").over(w))
    merged = islands.groupBy("entity_id", "_island").agg((F.max("e") - F.min("s") + 1).cast("long").alias("m"), F.count("*").alias("n"))
    return merged.groupBy("entity_id").agg(F.bround(F.sum("m") / F.lit(12.0), 1).alias("years"), F.sum("m").alias("total_months"), (F.sum("n") > F.count("*")).alias("concurrent_roles"))


def concurrent(intervals: DataFrame) -> DataFrame:
    """``intervals`` (entity_id, s, e, ord) with ``concurrent``: whether another interval of the entity overlaps.

    Intervals are compared as they stand, inverted ones too.  Every interval
    enters an ordered window at its start and asks at its end for the furthest
    end among those that have started, its own left out: for that the two
    furthest of different ``ord`` are carried along.  One sort, whatever the number of intervals.
    """
    kept = F.struct(*intervals.columns).alias("_i")
    marks = intervals.select("entity_id", kept, F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(0).alias("ask")), F.struct(F.col("e").alias("t"), F.lit(1).alias("ask")))).alias("_m"))
    marks = marks.select("entity_id", "_i", "_m.t", "_m.ask", F.when(F.col("_m.ask") == 0, F.struct(F.col("_i.e").alias("e"), F.col("_i.ord").alias("ord"))).alias("_end"))
    w = Window.partitionBy("entity_id").orderBy("t", "ask", "_i.ord")
    furthest, before = F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marks = marks.withColumns({"_first": furthest, "_low": F.when((F.col("ask") == 0) & (before["ord"] != F.col("_end.ord")), F.least("_end", before))})
    marks = marks.withColumn("_second", F.max("_low").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("ask = 1")
    other = F.when(F.col("_first.ord") == F.col("_i.ord"), F.col("_second.e")).otherwise(F.col("_first.e"))
    return marks.select("_i.*", F.coalesce(other >= F.col("_i.s"), F.lit(False)).alias("concurrent"))


def overall_confidence(scores: DataFrame, count_contact_weights: bool = False) -> DataFrame:
    """``entity_id, overall_confidence``: the weighted mean over populated fields (entity_id, field, confidence, populated)."""
    weights = WEIGHTS | (CONTACT_WEIGHTS if count_contact_weights else {})
    w = literal_map(weights)[F.col("field")]
    rows = scores.withColumn("_w", F.when(F.col("populated"), w))
    total = F.sum("_w")
    return rows.groupBy("entity_id").agg(F.bround(F.when(total > 0, F.sum(F.col("_w") * F.col("confidence")) / total).otherwise(F.lit(0.0)), 3).alias("overall_confidence"))


def years_provenance() -> tuple[str, float, str]:
    """Source, confidence and strategy of computed years."""
    return "computed", YEARS_CONFIDENCE, "computed_from_date_ranges"
