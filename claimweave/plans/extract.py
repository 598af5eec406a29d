"""From documents to claims: one pass of text functions, then one row for each claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import CONTACT, LOCATION, MATCH_WEIGHT, NAME, PROSE, SECTION_BODY
from ..functions.normalize import literal_map
from ..operators.canonical import kept
from ..operators.taxonomy import match_tokens
from ..sources.files import as_claims


def parsed(documents: DataFrame, compose: bool = True) -> DataFrame:
    """``documents`` (source, text) cleaned, with their sections and the two flags that lower confidence."""
    rows = documents.withColumn("near_empty", T.near_empty(F.col("text"))).withColumn("text", T.clean_text(F.coalesce("text", F.lit("")), compose))
    rows = rows.withColumn("sections", T.sections(F.col("text")))
    return rows.withColumn("no_sections", T.section(F.col("sections"), T.FULL_DOCUMENT).isNotNull())


def document_claims(documents: DataFrame, taxonomy: DataFrame, entity: Column | None = None, compose: bool = True) -> DataFrame:
    """All claims of documents (source, text), in extraction order.

    The entity defaults to the document's first e-mail, else its source.
    Bands of ``ord``: contact, skills, prose skills, experience, education.
    """
    rows = parsed(documents, compose)
    sec = F.col("sections")
    whole = F.col("no_sections")
    lowered = T.adjusted(F.lit(SECTION_BODY), whole, F.col("near_empty"))
    rows = rows.withColumns({"_contact": T.section(sec, T.CONTACT_BLOCK), "_experience": F.when(whole, F.col("text")).otherwise(F.coalesce(T.section(sec, "EXPERIENCE"), F.lit(""))), "_education": F.when(whole, F.col("text")).otherwise(F.coalesce(T.section(sec, "EDUCATION"), F.lit("")))})
    rows = T.with_education(T.with_roles(rows, "_experience", "_roles", lowered), "_education", "_schools_found", lowered)
    rows = rows.withColumns({"_name": T.name(F.col("_contact")), "_place": T.location(F.col("_contact")), "_phones": T.phones(F.col("_contact")), "_skills": T.section_skills(T.section(sec, "SKILLS"))})
    block = F.col("_contact")
    mail = F.lower(F.get(T.emails(block), F.lit(0)))
    who = F.coalesce(mail, F.col("source")) if entity is None else entity

    def adjusted(c: float) -> Column:
        return T.adjusted(F.lit(c), whole, F.col("near_empty"))

    def items(name: str, values: Column, c: float, position: str, method: str) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(name).alias("field"), v.alias("raw_value"), adjusted(c).alias("confidence"), F.lit(method).alias("method"), F.lit(position).alias("position")))

    def one(value: Column) -> Column:
        return F.array_compact(F.array(value))

    contact = ("contact_block", "regex_contact_block")
    name, place = F.col("_name"), F.col("_place")
    prose = F.concat_ws("\n", T.section(sec, "EXPERIENCE"), T.section(sec, "PROJECTS"))
    roles, schools = F.col("_roles"), F.col("_schools_found")
    body = ("named_section", "regex_section_body")
    parts = [
        items("email", T.emails(block), CONTACT, *contact), items("phone", F.col("_phones"), CONTACT, *contact), items("full_name", one(name), NAME, "contact_block", "heuristic"),
        items("linkedin_url", T.linkedin(block), CONTACT, *contact), items("github_url", T.github(block), CONTACT, *contact), items("portfolio_url", T.portfolio(block), CONTACT, *contact),
        items("location", one(F.when(place.isNotNull(), F.to_json(place, {"ignoreNullFields": "false"}))), LOCATION, *contact),
        items("skills", F.col("_skills"), SECTION_BODY, *body),
        items("skills", F.when(T.section(sec, "SKILLS").isNull() & whole, T.document_skills(F.col("text"))), PROSE, "full_document", "full_doc_scan"),
        items("skills", T.prose_skills(prose), PROSE, "prose_body", "full_doc_scan"),
        items("experience", one(F.when(F.size(roles) > 0, F.to_json(roles, {"ignoreNullFields": "false"}))), SECTION_BODY, *body),
        items("education", one(F.when(F.size(schools) > 0, F.to_json(schools, {"ignoreNullFields": "false"}))), SECTION_BODY, *body),
    ]
    flat = rows.select(who.alias("entity_id"), "source", F.posexplode(F.concat(*parts)).alias("ord", "c")).select("entity_id", "source", (F.col("ord") + 1_000_000_000).cast("bigint").alias("ord"), "c.*")
    flat = kept(flat)  # read for skills, for their distinct tokens and for the rest; documents are parsed once
    skills = match_tokens(flat.where("field = 'skills'").withColumn("token", F.col("raw_value")), taxonomy)
    # Running text counts only what the taxonomy has, by name or alias.
    skills = skills.where("position <> 'prose_body' or match_type in ('exact', 'alias')")
    skills = skills.withColumn("confidence", F.col("confidence") * literal_map(MATCH_WEIGHT)[F.col("match_type")]).drop("token")
    other = flat.where("field <> 'skills'").withColumns({"canonical_name": F.lit(None).cast("string"), "match_type": F.lit(None).cast("string"), "fuzzy_score": F.lit(None).cast("double")})
    return as_claims(other.unionByName(skills), "unstructured", F.col("method"), F.col("position"))
