"""Validation of profiles and projections: errors, warnings and a verdict as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType, StringType, StructType

from ..functions.constants import E164
from .projection import ProjectionConfig

_ERROR = "struct<field:string,error:string,value:string>"
#: Containers of a profile and the keys that their structs need.
KEYS = {
    "location": ("city", "region", "country"), "links": ("linkedin", "github", "portfolio", "other"), "skills": ("name", "confidence", "sources"),
    "experience": ("company", "title", "start", "end", "summary"), "education": ("institution", "degree", "field", "end_year"),
}


def _error(when: Column, field: str, text: str, value: Column) -> Column:
    return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(text).alias("error"), value.cast("string").alias("value")))


def _null_at(name: str):
    def error(x: Column, i: Column) -> Column:
        return F.when(x.isNull(), F.struct(F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]")).alias("field"), F.lit("Must be an object").alias("error"), F.lit(None).cast("string").alias("value")))

    return error


def profile_errors(df: DataFrame, config: ProjectionConfig) -> list[Column]:
    """Errors of an identity projection: what must be there, types, and keys of containers."""
    out = []
    types = {f.name: f.dataType for f in df.schema}
    always = F.lit(True)

    def missing(name: str, text: str) -> None:
        out.append(_error(always, name, text, F.lit(None)))

    if isinstance(types.get("candidate_id"), StringType):
        out.append(_error(F.col("candidate_id").isNull(), "candidate_id", "Must be a non-null string", F.col("candidate_id")))
    else:
        missing("candidate_id", "Must be a non-null string")
    for name in ("emails", "phones", "skills", "experience", "education"):
        if isinstance(types.get(name), ArrayType):
            out.append(_error(F.col(name).isNull(), name, "Must be a list", F.lit(None)))
        else:
            missing(name, "Must be a list")
    if config.include_provenance and not isinstance(types.get("provenance"), ArrayType):
        missing("provenance", "Must be a list")
    if config.include_confidence:
        if isinstance(types.get("overall_confidence"), NumericType):
            c = F.col("overall_confidence")
            out.append(_error(c.isNull() | (c < 0) | (c > 1), "overall_confidence", "Must be a number from 0 to 1", c))
        else:
            missing("overall_confidence", "Must be a number from 0 to 1")
    for name in ("full_name", "headline", "timestamp"):
        if name in types and not isinstance(types[name], StringType):
            missing(name, "Must be a string or null")
    if isinstance(types.get("years_experience"), NumericType):
        out.append(_error(F.col("years_experience") < 0, "years_experience", "Must not be negative", F.col("years_experience")))
    for name, keys in KEYS.items():
        kind = types.get(name)
        listed = isinstance(kind, ArrayType)
        inner = kind.elementType if listed else kind
        lacking = [k for k in keys if isinstance(inner, StructType) and k not in inner.names and not (k == "confidence" and not config.include_confidence)]
        for k in lacking:
            missing(f"{name}[].{k}" if listed else f"{name}.{k}", "Key is missing")
        if listed and name in ("skills", "experience", "education"):
            found = F.filter(F.transform(F.col(name), _null_at(name)), lambda e: e.isNotNull())
            out.append(F.get(found, F.lit(0)))
    return out


def config_errors(df: DataFrame, config: ProjectionConfig) -> list[Column]:
    """Errors of a custom projection: required fields that are missing or null."""
    out = []
    for f in config.fields:
        if f.get("required") and f.get("path"):
            c = F.col(f"`{f['path']}`") if f["path"] in df.columns else F.lit(None)
            out.append(_error(c.isNull(), f["path"], "Required mapped field is missing or resolved to null.", F.lit(None)))
    return out


def warnings_of(df: DataFrame) -> Column:
    """Warnings of a row, in order."""
    types = {f.name: f.dataType for f in df.schema}
    out: list[Column] = []
    if "overall_confidence" in types:
        c = F.col("overall_confidence").try_cast("double")
        out.append(F.when(c < 0.5, F.concat(F.lit("Low overall confidence: "), F.col("overall_confidence").cast("string"), F.lit(". Profile may be incomplete."))))
    if "years_experience" in types:
        y = F.col("years_experience").try_cast("double")
        out.append(F.when(y > 50, F.concat(F.lit("Unusually high years_experience: "), F.col("years_experience").cast("string"), F.lit(". Verify date ranges."))))
    if isinstance(types.get("emails"), ArrayType):
        out.append(F.when(F.size("emails") == 0, F.lit("No email found. candidate_id may be unreliable.")))
    if isinstance(types.get("skills"), ArrayType):
        out.append(F.when(F.size("skills") == 0, F.lit("No skills extracted.")))
    found = F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")
    if isinstance(types.get("phones"), ArrayType):
        bad = F.filter(F.col("phones"), lambda p: ~F.coalesce(p.rlike(E164), F.lit(False)))
        found = F.concat(found, F.coalesce(F.transform(bad, lambda p: F.concat(F.lit("Phone not in E.164 format: "), F.coalesce(p, F.lit("null")))), F.array().cast("array<string>")))
    return found


def validate(projected: DataFrame, config: ProjectionConfig | None = None) -> DataFrame:
    """``projected`` with ``valid``, ``errors`` and ``warnings``."""
    config = config or ProjectionConfig()
    errors = config_errors(projected, config) if config.fields else profile_errors(projected, config)
    found = F.array_compact(F.array(*errors)) if errors else F.array()
    found = found.cast(f"array<{_ERROR}>")
    return projected.withColumns({"validation_errors": found, "validation_warnings": warnings_of(projected)}).withColumn("valid", F.size("validation_errors") == 0)
