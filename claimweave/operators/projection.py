"""The projection language: a JSON config compiled to Column expressions at plan time."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StringType, StructType

from ..functions.normalize import country_normalized, phone_normalized, strip, title_case

TYPES = ("string", "string[]", "number", "boolean", "object", "object[]")
NORMALIZERS = ("lowercase", "E164", "canonical", "iso3166")
MISSING = ("null", "omit", "error")


class ProjectionError(Exception):
    """A required field is missing, or a config cannot be compiled."""


@dataclass
class ProjectionConfig:
    """Fields are dicts with path and perhaps from, type, normalize, required."""

    fields: list[dict] = field(default_factory=list)
    include_confidence: bool = True
    include_provenance: bool = True
    on_missing: str = "null"


def load_config(path: str | None) -> ProjectionConfig:
    """A config from a JSON file; what cannot be read is the identity projection."""
    try:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        return ProjectionConfig(**{k: d[k] for k in ("fields", "include_confidence", "include_provenance", "on_missing") if k in d})
    except (OSError, TypeError, ValueError):
        return ProjectionConfig()


def validate_config(d: dict) -> list[str]:
    """What is wrong with a config: every field needs a path and a known type."""
    errors = []
    if not isinstance(d.get("fields", []), list):
        return ["fields must be a list"]
    for i, f in enumerate(d.get("fields", [])):
        if not f.get("path"):
            errors.append(f"fields[{i}]: path is missing")
        if f.get("type") not in TYPES:
            errors.append(f"fields[{i}]: type must be one of {', '.join(TYPES)}")
        if f.get("normalize") not in (None, *NORMALIZERS):
            errors.append(f"fields[{i}]: unknown normalizer {f['normalize']}")
    if d.get("on_missing", "null") not in MISSING:
        errors.append(f"on_missing must be one of {', '.join(MISSING)}")
    return errors


def resolve(value: Column, kind: DataType, parts: list[str]) -> tuple[Column, DataType]:
    """The value at a path, and its type; a typed null where the path leads nowhere."""
    if not parts:
        return value, kind
    head, rest = parts[0], parts[1:]
    name, _, index = head.partition("[")
    if name:
        if not isinstance(kind, StructType) or name not in kind.names:
            return F.lit(None).cast("string"), StringType()
        value, kind = value[name], kind[name].dataType
    if not index:
        return resolve(value, kind, rest)
    index = index.rstrip("]")
    if not isinstance(kind, ArrayType):
        return F.lit(None).cast("string"), StringType()
    if index == "":
        inner: list = []
        out = F.transform(value, lambda x: inner.append(resolve(x, kind.elementType, rest)) or inner[-1][0])
        return out, ArrayType(inner[-1][1])
    if not index.isdigit():
        return F.lit(None).cast("string"), StringType()
    return resolve(F.get(value, F.lit(int(index))), kind.elementType, rest)


def _normalized(value: Column, kind: DataType, how: str, taxonomy: dict | None) -> Column:
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _normalized(x, kind.elementType, how, taxonomy))
    if isinstance(kind, StructType | MapType):
        return value
    text = value.cast("string")
    if how == "lowercase":
        return F.lower(text)
    if how == "E164":
        return F.coalesce(phone_normalized(text)["value"], text)
    if how == "iso3166":
        return F.coalesce(country_normalized(text)["value"], text)
    if how == "canonical":
        terms: dict[str, str] = {}
        for key, entry in (taxonomy or {}).items():
            for term in (key, *(a.lower() for a in entry.get("aliases") or [])):
                terms.setdefault(term, entry["canonical"])
        known = F.create_map(*(F.lit(x) for kv in terms.items() for x in kv))[F.lower(strip(text))] if terms else F.lit(None).cast("string")
        return F.coalesce(known, title_case(text))
    return value


def _text(value: Column, kind: DataType) -> Column:
    return F.to_json(value) if isinstance(kind, ArrayType | StructType | MapType) else value.cast("string")


def coerce(value: Column, kind: DataType, to: str) -> Column:
    """A value as string, string[], number or boolean (empty and zero are false); other types leave it as it is.

    Lists and structs become JSON where a string is asked for.
    """
    if to == "string":
        return _text(value, kind)
    if to == "string[]":
        if isinstance(kind, ArrayType):
            return F.transform(F.filter(value, lambda x: x.isNotNull()), lambda x: _text(x, kind.elementType))
        return F.when(value.isNotNull(), F.array(_text(value, kind)))
    if to == "number":
        return F.lit(None).cast("double") if isinstance(kind, ArrayType | StructType | MapType) else value.try_cast("double")
    if to == "boolean":
        if isinstance(kind, ArrayType):
            return F.when(value.isNotNull(), F.size(value) > 0)
        if isinstance(kind, NumericType):
            return value != 0
        if isinstance(kind, BooleanType):
            return value
        return F.when(value.isNotNull(), F.lit(True)) if isinstance(kind, StructType) else value != ""
    return value


#: (part of a path in lower case, fields that it refers to)
_REFERS = (
    ("email", ["email"]), ("phone", ["phone"]), ("linkedin", ["linkedin_url"]), ("github", ["github_url"]), ("portfolio", ["portfolio_url"]), ("full_name", ["full_name"]), ("headline", ["headline"]),
    ("location", ["location"]), ("current_company", ["current_company"]), ("skills", ["skills"]), ("education", ["education"]), ("years_experience", ["years_experience"]),
)


def referenced_fields(fields: list[dict]) -> set[str]:
    """The fields whose provenance a projection should keep."""
    out: set[str] = set()
    for f in fields:
        at = (f.get("from") or f.get("path") or "").lower()
        for part, names in _REFERS:
            if part in at:
                out.update(names)
        if "experience" in at:
            out.update(["current_company"] if "company" in at else ["experience", "years_experience"])
        if "links" in at and not any(x in at for x in ("linkedin", "github", "portfolio")):
            out.update(["linkedin_url", "github_url", "portfolio_url"])
    return out


#: What a service or a command line may offer as a start.
SAMPLES = {
    "default": ProjectionConfig(),
    "custom": ProjectionConfig([
        {"path": "full_name", "type": "string", "required": True}, {"path": "primary_email", "from": "emails[0]", "type": "string", "required": True}, {"path": "phone", "from": "phones[0]", "type": "string", "normalize": "E164"},
        {"path": "skills", "from": "skills[].name", "type": "string[]", "normalize": "canonical"}, {"path": "years_experience", "type": "number", "required": False},
        {"path": "current_company", "from": "experience[0].company", "type": "string", "required": False}, {"path": "linkedin", "from": "links.linkedin", "type": "string", "required": False},
    ], True, False),
}


def _found(schema: StructType, f: dict) -> tuple[Column, DataType]:
    """The value that a field of a config refers to, and its type."""
    head, *rest = (f.get("from") or f["path"]).split(".")
    root, bracket, tail = head.partition("[")
    if root not in schema.names:
        return F.lit(None).cast("string"), StringType()
    return resolve(F.col(root), schema[root].dataType, ([bracket + tail] if bracket else []) + rest)


def _gap(f: dict) -> str:
    return f"{'Required field' if f.get('required') else 'Field'} is missing: {f['path']}"


def missing(profiles: DataFrame, config: ProjectionConfig) -> Column:
    """The first thing that keeps a row from being projected, or null: a required value that is missing, or with ``on_missing`` error any value."""
    asked = [f for f in config.fields if f.get("path") and (f.get("required") or config.on_missing == "error")]
    return F.coalesce(F.lit(None).cast("string"), *(F.when(_found(profiles.schema, f)[0].isNull(), F.lit(_gap(f))) for f in asked))


def require(profiles: DataFrame, config: ProjectionConfig) -> None:
    """Raise ``ProjectionError`` if a row cannot be projected."""
    if bad := profiles.select("entity_id", missing(profiles, config).alias("why")).where("why is not null").first():
        raise ProjectionError(f"{bad.why} ({bad.entity_id})")


def project(profiles: DataFrame, config: ProjectionConfig, taxonomy: dict | None = None, strict: bool = True) -> DataFrame:
    """``profiles`` (with entity_id) in the shape that a config asks for.

    A missing value follows ``on_missing``: null, ``error`` (as for required
    fields) raises when the row is computed, ``omit`` drops the key from that
    row's JSON (see ``project_json``).  Without ``strict`` nothing raises; see
    ``missing`` for the rows that would have.
    """
    if config.on_missing not in MISSING:
        raise ProjectionError(f"on_missing must be one of {', '.join(MISSING)}")
    schema = profiles.schema
    columns: dict[str, Column] = {}
    if not config.fields:
        columns = {c: F.col(c) for c in profiles.columns if c != "entity_id"}
    for f in config.fields:
        path = f.get("path")
        if not path:
            continue
        value, kind = _found(schema, f)
        if strict and (f.get("required") or config.on_missing == "error"):
            value = F.when(value.isNull(), F.raise_error(F.lit(_gap(f))).cast(kind)).otherwise(value)
        if f.get("normalize"):
            value = _normalized(value, kind, f["normalize"], taxonomy)
        columns[path] = coerce(value, kind, f.get("type") or "string")
    if not config.include_confidence:
        columns.pop("overall_confidence", None)
        kind = schema["skills"].dataType if "skills" in schema.names else None
        if "skills" in columns and (not config.fields or any(f.get("path") == "skills" and f.get("type") in ("object[]", "object") for f in config.fields)) and isinstance(kind, ArrayType):
            columns["skills"] = F.transform(columns["skills"], lambda s: s.dropFields("confidence"))
    elif "overall_confidence" in schema.names:
        columns.setdefault("overall_confidence", F.col("overall_confidence"))
    if not config.include_provenance:
        columns.pop("provenance", None)
    elif "provenance" in schema.names and "provenance" not in columns:
        names = sorted(referenced_fields(config.fields))
        columns["provenance"] = F.filter("provenance", lambda p: p["field"].isin(*names)) if names else F.filter("provenance", lambda p: F.lit(False))
    return profiles.select("entity_id", *(c.alias(n) for n, c in columns.items()))


def project_json(profiles: DataFrame, config: ProjectionConfig, taxonomy: dict | None = None) -> DataFrame:
    """``entity_id, output``: the projection as JSON; with ``on_missing`` omit, null keys are left out row by row."""
    out = project(profiles, config, taxonomy)
    return out.select("entity_id", row_json([c for c in out.columns if c != "entity_id"], config.on_missing == "omit").alias("output"))


def row_json(columns: list[str], omit: bool = False) -> Column:
    """The columns of a row as a JSON object, null ones too unless ``omit``."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)), {"ignoreNullFields": "true" if omit else "false"})


