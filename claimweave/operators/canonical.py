"""From claims to one profile for each entity, with provenance."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import AS_OF, FIELDS, SINGLE_FIELDS, UNION_FIELDS
from ..functions.normalize import strip
from ..functions.schema import CANONICAL, EDUCATION, ROLE, SKILL
from . import arbitrate as A
from .roles import experience_provenance, merge_roles


def candidate_id(email: Column, name: Column, entity: Column) -> Column:
    """SHA-256 of the first e-mail, else of the name, else of the entity's id."""
    def filled(x: Column) -> Column:
        return F.when(strip(x) != "", F.lower(strip(x)))

    return F.sha2(F.coalesce(filled(email), filled(name), F.concat(F.lit("entity:"), entity)), 256)


def _roles(claims: DataFrame) -> DataFrame:
    lists = claims.where(F.col("field") == "experience").select("entity_id", "ord", F.posexplode(F.from_json("raw_value", f"array<{ROLE}>")).alias("pos", "r"))
    return lists.select("entity_id", (F.col("ord") * 100000 + F.col("pos")).alias("ord"), "r.*")


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` computed once for several readers; they spill to disk, and ``spark.catalog.clearCache()`` or the end of their readers gives them back.

    On one machine the plans above them do not carry theirs along, which takes longer to
    analyse than a small table to read; shuffles below run at once then.  On a
    cluster they keep it, so that lost executors' rows can be computed again.
    """
    alone = re.fullmatch(r"local(\[.*\])?", rows.sparkSession.sparkContext.master)
    return rows.localCheckpoint(eager=False) if alone else rows.persist()


def _corroborated(claims: DataFrame) -> DataFrame:
    """Claims dealt by entity once, for every strategy and grouping to read."""
    return kept(A.corroborate(claims.repartition("entity_id")))


def arbitrated(claims: DataFrame, as_of: str = AS_OF, count_contact_weights: bool = False) -> tuple[DataFrame, DataFrame]:
    """Values by entity, and provenance rows ``entity_id, position, record`` (13 of each entity, in fixed order).

    ``claims`` are normalized.  They are dealt by entity once; every strategy
    groups within that.
    """
    return _arbitrated(_corroborated(claims), as_of, count_contact_weights)


def _arbitrated(rows: DataFrame, as_of: str, count_contact_weights: bool) -> tuple[DataFrame, DataFrame]:
    entities = rows.select("entity_id").distinct()
    union = A.union_fields(rows.where(F.col("field").isin(*UNION_FIELDS)))
    single = A.highest_confidence(rows.where(F.col("field").isin(*SINGLE_FIELDS)))
    skills = A.union_skills(rows).groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct("name", "confidence", "sources").alias("s")))), lambda x: x["s"]).alias("skills"))
    merged = merge_roles(_roles(rows), as_of)
    role = F.struct("company", "title", "start", "end", "summary", "concurrent", "sources", "confidence")
    experience = merged.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", role.alias("r")))), lambda x: x["r"]).alias("experience"))
    spans = merged.select("entity_id", A.month_index(F.col("start"), as_of).alias("s"), A.month_index(F.col("end"), as_of, 12).alias("e"), "ord")
    years = A.years_of_experience(spans)

    pick = {f: F.max(F.when(F.col("field") == f, F.col("values"))).alias(f) for f in UNION_FIELDS}
    values = union.groupBy("entity_id").agg(*pick.values())
    ones = single.groupBy("entity_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in SINGLE_FIELDS))
    joined = entities.join(values, "entity_id", "left").join(ones, "entity_id", "left").join(skills, "entity_id", "left").join(experience, "entity_id", "left").join(years, "entity_id", "left")

    source, confidence, strategy = A.years_provenance()
    nothing = F.array().cast("array<string>")
    parts = [
        union.select("entity_id", "field", F.to_json("values").alias("winning_value"), "winning_source", "winning_method", "winning_confidence", F.lit("union").alias("resolution_strategy"), F.lit(False).alias("conflict_detected"), nothing.alias("transformation_applied")),
        single.select("entity_id", "field", F.col("value").alias("winning_value"), "winning_source", "winning_method", "winning_confidence", F.lit("highest_confidence").alias("resolution_strategy"), "conflict_detected", nothing.alias("transformation_applied")),
        skills.select("entity_id", F.lit("skills").alias("field"), F.to_json("skills").alias("winning_value"), F.lit("multiple").alias("winning_source"), F.lit("union_with_corroboration").alias("winning_method"), F.get("skills", F.lit(0))["confidence"].alias("winning_confidence"), F.lit("union_with_corroboration").alias("resolution_strategy"), F.lit(False).alias("conflict_detected"), nothing.alias("transformation_applied")),
        experience.join(experience_provenance(merged), "entity_id").select("entity_id", F.lit("experience").alias("field"), F.to_json("experience").alias("winning_value"), "winning_source", F.lit("merge_experience").alias("winning_method"), "winning_confidence", F.lit("merge_experience").alias("resolution_strategy"), F.lit(False).alias("conflict_detected"), F.array(F.concat(F.lit("merged_count:"), "merged_count")).alias("transformation_applied")),
        entities.join(years, "entity_id", "left").select("entity_id", F.lit("years_experience").alias("field"), F.coalesce("years", F.lit(0.0)).cast("string").alias("winning_value"), F.lit(source).alias("winning_source"), F.lit("computed").alias("winning_method"), F.lit(confidence).alias("winning_confidence"), F.lit(strategy).alias("resolution_strategy"), F.lit(False).alias("conflict_detected"), F.when(F.col("years").isNotNull(), F.array(F.concat(F.lit("total_months:"), "total_months"), F.concat(F.lit("concurrent_roles:"), F.initcap(F.col("concurrent_roles").cast("string"))))).otherwise(nothing).alias("transformation_applied")),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    claim = F.struct("field", "raw_value", "normalized_value", "source", "source_type", "confidence", "corroborated_by", "ord")
    evidence = rows.groupBy("entity_id", "field").agg(F.to_json(F.array_sort(F.collect_list(F.struct("ord", claim.alias("claim"))))).alias("all_claims"))
    strategies = {f: "union" for f in UNION_FIELDS} | {f: "highest_confidence" for f in SINGLE_FIELDS} | {"skills": "union_with_corroboration", "experience": "merge_experience", "years_experience": strategy}
    every = entities.select("entity_id", F.explode(F.array(*(F.struct(F.lit(i).alias("position"), F.lit(f).alias("field"), F.lit(strategies[f]).alias("s")) for i, f in enumerate(FIELDS)))).alias("x")).select("entity_id", "x.*")
    empty = F.when(F.col("field").isin(*UNION_FIELDS, "skills", "experience"), F.lit("[]"))
    provenance = every.join(found, ["entity_id", "field"], "left").join(evidence, ["entity_id", "field"], "left").select(
        "entity_id", "position",
        F.struct(
            "field", F.coalesce("winning_value", empty).alias("winning_value"), F.coalesce("winning_source", F.when(F.col("field") == "skills", "multiple").otherwise("none")).alias("winning_source"),
            F.coalesce("winning_method", F.when(F.col("field") == "skills", "union_with_corroboration").otherwise("none")).alias("winning_method"), F.coalesce("winning_confidence", F.lit(0.0)).alias("winning_confidence"),
            F.coalesce("resolution_strategy", "s").alias("resolution_strategy"), F.coalesce("conflict_detected", F.lit(False)).alias("conflict_detected"), F.coalesce("transformation_applied", nothing).alias("transformation_applied"), F.coalesce("all_claims", F.lit("[]")).alias("all_claims"),
        ).alias("record"),
    )
    filled = F.when(F.col("record.field").isin("skills", "experience", "education", *UNION_FIELDS), F.coalesce(F.col("record.winning_value"), F.lit("[]")) != "[]").otherwise(F.coalesce(strip("record.winning_value"), F.lit("")) != "")
    scores = provenance.select("entity_id", F.col("record.field").alias("field"), F.col("record.winning_confidence").alias("confidence"), filled.alias("populated"))
    return joined.join(A.overall_confidence(scores, count_contact_weights), "entity_id", "left"), provenance


def canonical(claims: DataFrame, timestamp: str = f"{AS_OF}-20T00:00:00Z", as_of: str = AS_OF, count_contact_weights: bool = False) -> DataFrame:
    """``entity_id`` and the 16 fields of a profile (see ``functions.schema``), one row for each entity.

    ``timestamp`` is a parameter, so a run can be repeated.
    """
    rows = _corroborated(claims)
    values, provenance = _arbitrated(rows, as_of, count_contact_weights)
    trail = provenance.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "record"))), lambda x: x["record"]).alias("provenance"))
    files = rows.groupBy("entity_id").agg(F.array_sort(F.collect_set("source")).alias("source_files"))
    nothing = F.array().cast("array<string>")
    place = F.from_json("location", "city string, region string, country string")
    first = F.get("email", F.lit(0))
    no_mail = F.when(first.isNull(), F.when(F.coalesce(strip("full_name"), F.lit("")) != "", "candidate_id derived from name").otherwise("candidate_id derived from entity id"))
    rows = values.join(trail, "entity_id", "left").join(files, "entity_id", "left").select(
        "entity_id", candidate_id(first, F.col("full_name"), F.col("entity_id")).alias("candidate_id"), "full_name", F.coalesce("email", nothing).alias("emails"), F.coalesce("phone", nothing).alias("phones"),
        F.coalesce(place, F.from_json(F.lit("{}"), "city string, region string, country string")).alias("location"),
        F.struct(F.get("linkedin_url", F.lit(0)).alias("linkedin"), F.get("github_url", F.lit(0)).alias("github"), F.coalesce("portfolio_url", nothing).alias("portfolio"), nothing.alias("other")).alias("links"),
        "headline", F.coalesce("years", F.lit(0.0)).alias("years_experience"), F.coalesce("skills", F.array().cast(f"array<{SKILL}>")).alias("skills"), F.coalesce("experience", F.array().cast(f"array<{ROLE}>")).alias("experience"),
        F.coalesce(F.from_json("education", f"array<{EDUCATION}>"), F.array().cast(f"array<{EDUCATION}>")).alias("education"), "provenance", F.coalesce("overall_confidence", F.lit(0.0)).alias("overall_confidence"),
        F.lit(timestamp).alias("timestamp"), "source_files", F.array_compact(F.array(no_mail)).alias("warnings"),
    )
    return rows


def as_json(profiles: DataFrame) -> DataFrame:
    """``entity_id, json``: profiles with all their fields, nulls too."""
    return profiles.select("entity_id", F.to_json(F.struct(*(c for c in profiles.columns if c != "entity_id")), {"ignoreNullFields": "false"}).alias("json"))


__all__ = ["CANONICAL", "arbitrated", "as_json", "candidate_id", "canonical"]
