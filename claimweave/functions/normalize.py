"""Normalizers: pure Column functions, and the router that applies them to claims.

Each ``x_normalized`` gives ``struct<value, status, applied, note>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import AS_OF, COUNTRIES, EMAIL, MONTH_NAMES, MONTHS, PRESENT, WHITE

SUCCESS, PARTIAL, FAILED, NOT_APPLICABLE = "success", "partial", "failed", "not_applicable"


def _result(value: Column, status: str, applied: list[str] = (), note: Column | str | None = None) -> Column:
    note = F.lit(note) if note is None or isinstance(note, str) else note
    return F.struct(value.cast("string").alias("value"), F.lit(status).alias("status"), F.array(*map(F.lit, applied)).cast("array<string>").alias("applied"), note.cast("string").alias("note"))


def strip(value: Column | str) -> Column:
    """A text without white space of any kind at its ends."""
    return F.btrim(value, F.lit(WHITE))


def literal_map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def month_number(name: Column) -> Column:
    """``01`` to ``12`` from a month's name or its first letters; ``01`` for anything else."""
    return F.coalesce(literal_map({m: f"{i:02d}" for i, m in enumerate(MONTHS, 1)})[F.lower(F.substring(strip(name), 1, 3))], F.lit("01"))


def _months(as_of: str) -> int:
    return int(as_of[:4]) * 12 + int(as_of[5:7])


def month_index(date: Column, as_of: str = AS_OF, bare_year_month: int = 1) -> Column:
    """``year * 12 + month`` of ``YYYY-MM`` or ``YYYY``; the present and what cannot be read are ``as_of``."""
    year, month = F.substring_index(date, "-", 1).try_cast("int"), F.get(F.split(date, "-"), F.lit(1))
    m = F.when(month.isNull(), F.lit(bare_year_month)).otherwise(month.try_cast("int"))
    return F.when(F.coalesce(date, F.lit("")).eqNullSafe("") | F.lower(date).isin(*PRESENT), F.lit(_months(as_of))).otherwise(F.coalesce(year * 12 + m, F.lit(_months(as_of))))


def email_normalized(raw: Column) -> Column:
    """Lower-case, trimmed; of several in one value the first valid one."""
    whole = f"^{EMAIL}$"
    clean = strip(raw)
    first = F.get(F.filter(F.transform(F.split(clean, "[,;]+"), lambda p: F.lower(strip(p))), lambda p: p.rlike(whole)), F.lit(0))
    one = F.lower(clean)
    return (
        F.when(clean.rlike("[,;]") & first.isNotNull(), _result(first, SUCCESS, ["split_multiple_emails"], F.concat(F.lit("Multiple emails detected. Selected first valid email: "), first)))
        .when(clean.rlike("[,;]"), _result(F.lit(None), FAILED, [], F.concat(F.lit("Multiple emails detected but none were valid: "), raw)))
        .when(one.rlike(whole), _result(one, SUCCESS, ["lowercased", "stripped"]))
        .otherwise(_result(F.lit(None), FAILED))
    )


def phone_normalized(raw: Column) -> Column:
    """E.164 by rules: a plus and 7 to 15 digits, an Indian mobile number, or a North American one.

    Values shaped like ``415 555 0100`` are tried as North American first.
    Number plans beyond these shapes are not checked.
    """
    digits = F.regexp_replace(raw, r"[\s\-\.\(\)]", "")
    ten = F.when(digits.rlike(r"^0?\d{10}$"), F.substring(digits, -10, 10))
    plain = F.when(raw.rlike(r"^[\s\d\-\.\(\)\+]+$"), digits)
    indian = F.when(plain.isNotNull() & ten.rlike("^[6-9]"), F.concat(F.lit("+91"), ten))
    american = F.when(plain.isNotNull() & digits.rlike(r"^1?[2-9]\d{2}[2-9]\d{6}$"), F.concat(F.lit("+1"), F.substring(digits, -10, 10)))
    shaped = raw.rlike(r"^\s*\(?\d{3}\)?[\s\-\.]\d{3}[\s\-\.]\d{4}")
    found = F.coalesce(F.when(plain.rlike(r"^\+\d{7,15}$"), plain), F.when(shaped, american), indian, american)
    return F.when(found.isNotNull(), _result(found, SUCCESS, ["parsed_by_rules", "formatted_e164"])).otherwise(_result(F.lit(None), FAILED, [], F.concat(F.lit("Phone normalization failed: "), raw, F.lit(". Stored as null per policy."))))


def date_normalized(raw: Column) -> Column:
    """``YYYY-MM``; a bare year becomes January, words for the present become null."""
    t = strip(raw)
    by_name = rf"(?i)^({MONTH_NAMES})\s+(\d{{4}})$"
    return (
        F.when(F.lower(t).isin(*PRESENT, "till date"), _result(F.lit(None), NOT_APPLICABLE, [], "end_date_is_present"))
        .when(t.rlike(r"^\d{4}-\d{2}$"), _result(t, SUCCESS, ["parsed_yyyy_mm"]))
        .when(t.rlike(by_name), _result(F.concat(F.regexp_extract(t, by_name, 2), F.lit("-"), month_number(F.regexp_extract(t, by_name, 1))), SUCCESS, ["parsed_month_year"]))
        .when(t.rlike(r"^\d{1,2}/\d{4}$"), _result(F.concat(F.substring_index(t, "/", -1), F.lit("-"), F.lpad(F.substring_index(t, "/", 1), 2, "0")), SUCCESS, ["parsed_slash_date"]))
        .when(t.rlike(r"^\d{4}$"), _result(F.concat(t, F.lit("-01")), PARTIAL, ["defaulted_to_month_01"], "Only year available, defaulted to month 01"))
        .otherwise(_result(F.lit(None), FAILED, [], F.concat(F.lit("Date normalization failed for value: "), raw)))
    )


def country_normalized(raw: Column) -> Column:
    """The two-letter code of a country's name."""
    code = literal_map(COUNTRIES)[F.lower(strip(raw))]
    return F.when(code.isNotNull(), _result(code, SUCCESS, ["iso3166_mapping"])).otherwise(_result(F.lit(None), FAILED, [], F.concat(F.lit("Country normalization failed for value: "), raw)))


def title_case(raw: Column) -> Column:
    """Every run of letters with its first letter in upper case and the rest in lower case."""
    marked = F.regexp_replace(F.lower(raw), r"(\p{L}+)", "\u0001$1")
    parts = F.split(marked, "\u0001", -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))), "")


def name_normalized(raw: Column) -> Column:
    """``Last, First`` turned round if the last name is one word, title case, single spaces."""
    t = strip(raw)
    last, first = strip(F.substring_index(t, ",", 1)), strip(F.regexp_replace(t, "^[^,]*,", ""))
    turned = F.contains(t, F.lit(",")) & ~F.contains(last, F.lit(" "))
    value = strip(F.regexp_replace(title_case(F.when(turned, F.concat(first, F.lit(" "), last)).otherwise(t)), r"\s+", " "))
    rest = ["title_cased", "removed_internal_whitespace"]
    return F.when(value == "", _result(F.lit(None), FAILED, [], "Name is empty")).when(turned, _result(value, SUCCESS, ["swapped_last_first", *rest])).otherwise(_result(value, SUCCESS, rest))


def location_normalized(raw: Column) -> Column:
    """A location as JSON (city, region, country) with the country as a code where it is known; always a success."""
    place = F.from_json(raw, "city string, region string, country string")
    country = country_normalized(place["country"])
    kept = F.to_json(place.withField("country", F.coalesce(country["value"], place["country"])), {"ignoreNullFields": "false"})
    known = country["status"] == SUCCESS
    return F.when(known, _result(kept, SUCCESS, ["iso3166_mapping"])).otherwise(_result(kept, SUCCESS, [], F.when(F.coalesce(place["country"], F.lit("")) != "", country["note"])))


def role_dates_normalized(raw: Column, role: str) -> Column:
    """A role list as JSON with start and end as ``YYYY-MM`` where they can be read."""
    roles = F.from_json(raw, f"array<{role}>")

    def read(x: Column) -> Column:
        d = date_normalized(x)
        return F.when(F.coalesce(x, F.lit("")) == "", x).when(d["status"] == FAILED, x).otherwise(d["value"])

    out = F.transform(roles, lambda r: r.withField("start", read(r["start"])).withField("end", read(r["end"])))
    return _result(F.to_json(out, {"ignoreNullFields": "false"}), SUCCESS, ["normalized_experience_dates"])


def normalize_claims(claims: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """Route every claim to its field's normalizer; other fields pass through.

    ``taxonomy`` (see ``operators.taxonomy``) gives skills their canonical names.
    Null raw values stay null and fail where a normalizer exists.
    """
    from ..operators.taxonomy import exact_match
    from .schema import ROLE

    columns = claims.columns
    raw, field = F.col("raw_value"), F.col("field")
    rows = claims.withColumn("_term", F.when(field == "skills", F.lower(strip(raw))))
    rows = exact_match(rows, taxonomy, "_term") if taxonomy is not None else rows.withColumns({"_canonical": F.lit(None).cast("string")})
    skill = (
        F.when(F.col("_canonical").isNotNull(), _result(F.col("_canonical"), SUCCESS, ["taxonomy_exact_or_alias_match"]))
        .when((F.col("match_type") == "fuzzy") & F.col("canonical_name").isNotNull(), _result(F.col("canonical_name"), SUCCESS, ["taxonomy_fuzzy_match"]))
        .otherwise(_result(title_case(raw), PARTIAL, ["title_cased_fallback"], "Skill not in taxonomy, kept as-is"))
    )
    found = (
        F.when(field == "email", email_normalized(raw)).when(field == "phone", phone_normalized(raw)).when(field == "full_name", name_normalized(raw))
        .when(field.isin("start", "end"), date_normalized(raw)).when(field == "location", location_normalized(raw)).when(field == "skills", skill)
        .when(field == "experience", role_dates_normalized(raw, ROLE)).when(field == "education", _result(raw, SUCCESS)).otherwise(_result(raw, NOT_APPLICABLE))
    )
    note = F.col("_n.note")
    before = F.col("extraction_notes")
    joined = F.when(note.isNull(), before).when(F.coalesce(before, F.lit("")) == "", note).otherwise(F.concat(before, F.lit(" | Normalization notes: "), note))
    rows = rows.withColumn("_n", found).withColumns({"normalized_value": F.col("_n.value"), "normalization_status": F.col("_n.status"), "normalization_applied": F.col("_n.applied"), "extraction_notes": joined})
    return rows.select(*columns)


def failure_warnings(claims: DataFrame) -> DataFrame:
    """``entity_id, warnings``: a message for each claim that could not be normalized, in order."""
    said = F.concat(F.lit("Normalization failed for "), F.col("field"), F.lit(": "), F.coalesce("raw_value", F.lit("null")))
    return claims.where(F.col("normalization_status") == FAILED).groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", said.alias("w")))), lambda x: x["w"]).alias("warnings"))
