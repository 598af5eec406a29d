"""Text operators: cleaning, sections, contact data, skills, roles and education, as Column functions.

All work on one document's text, in the JVM, with array functions over its
lines; nothing is exploded except where a claim becomes a row.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .constants import (
    ACADEMIC_WORDS, CITIES, COMPANY_WORDS, DEGREES, EDUCATION_HEADERS, EMAIL, INSTITUTIONS, MATCH_WEIGHT, MONTH_NAMES, NOT_NAMES, PHONES, PRESENT, SECTION_BODY, SECTIONS, TITLE_WORDS, URL_HINTS,
)
from .normalize import literal_map, month_index, month_number, strip

FULL_DOCUMENT, CONTACT_BLOCK = "FULL_DOCUMENT", "CONTACT_BLOCK"


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition, which Spark has no function for."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def clean_text(text: Column, compose: bool = False) -> Column:
    """Without control characters, each line trimmed, at most one blank line in a row; ``compose`` also applies NFC."""
    t = F.regexp_replace(text, r"[\p{C}&&[^\n\t]]", "")
    t = nfc(t) if compose else t
    t = F.array_join(F.transform(F.split(t, "\n", -1), lambda x: strip(F.regexp_replace(x, r"^\s+|\s+$", ""))), "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def full_lines(text: Column) -> Column:
    """The trimmed lines that are not blank."""
    return F.filter(F.transform(lines_of(text), lambda x: strip(x)), lambda x: x != "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it.

    A Column named twice is computed twice, and inside a lambda once for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _header(line: Column) -> Column:
    return strip(F.regexp_replace(strip(line), ":+$", ""))


def is_header(line: Column) -> Column:
    """A line in capitals, or a known heading, of fewer than 50 characters."""

    def fits(h: Column) -> Column:
        capitals = h.rlike(r"\p{Lu}") & ~h.rlike(r"\p{Ll}")
        return (h != "") & (F.length(h) < 50) & (capitals | F.lower(h).isin(*SECTIONS))

    return _let(_header(line), fits)


def header_positions(text: Column) -> Column:
    """Line numbers (from 0) of the headings that something follows."""
    return _let(lines_of(text), _headings)


def _headings(lines: Column) -> Column:
    last = F.array_max(F.transform(lines, lambda x, i: F.when(strip(x) != "", i)))
    return _let(last, lambda n: F.filter(F.transform(lines, lambda x, i: F.when((i < n) & is_header(x), i)), lambda i: i.isNotNull()))


def sections(text: Column) -> Column:
    """``array<struct<name, body>>``: the contact block (first 15 lines), then each section once, bodies of one name joined.

    Without headings the whole text is the section FULL_DOCUMENT.
    """
    known = literal_map(SECTIONS)

    def found(lines: Column, at: Column) -> Column:
        def section(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(at, k + 1), F.size(lines))
            body = F.regexp_replace(F.array_join(F.slice(lines, start + 2, end - start - 1), "\n"), r"^\s+|\s+$", "")
            return F.struct(_let(_header(F.get(lines, start)), lambda name: F.coalesce(known[F.lower(name)], F.upper(name))).alias("name"), body.alias("body"))

        return F.when(F.size(at) == 0, whole).otherwise(_let(F.transform(at, section), pooled))

    def pooled(parts: Column) -> Column:
        names = F.array_distinct(F.transform(parts, lambda p: p["name"]))
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.array_join(F.transform(F.filter(parts, lambda p: p["name"] == n), lambda p: p["body"]), "\n").alias("body")))

    whole = F.array(F.struct(F.lit(FULL_DOCUMENT).alias("name"), text.alias("body")))
    block = F.array(F.struct(F.lit(CONTACT_BLOCK).alias("name"), contact_block(text).alias("body")))
    return F.concat(block, _let(lines_of(text), lambda lines: _let(_headings(lines), lambda at: found(lines, at))))


def contact_block(text: Column) -> Column:
    """The first 15 lines."""
    return F.substring_index(text, "\n", 15)


def section(found: Column, name: str) -> Column:
    """The body of a section by name, or null."""
    return F.get(F.filter(found, lambda s: s["name"] == name), F.lit(0))["body"]


# -- contact ---------------------------------------------------------------------


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))


def phones(text: Column) -> Column:
    """One phone for each line that has one: the first of four patterns whose match is no year or range of years."""

    def first(line: Column) -> Column:
        found = [strip(F.regexp_extract(line, p, 0)) for p in PHONES]
        return F.coalesce(*(F.when((x != "") & ~x.rlike(r"^\d{4}\s*[\-–—]\s*\d{4}$") & ~x.rlike(r"^\d{4}$"), x) for x in found))

    return F.filter(F.transform(lines_of(text), first), lambda x: x.isNotNull())


def name(text: Column) -> Column:
    """The first of the top five lines that looks like a name: two to four capitalised words."""
    top = F.transform(F.slice(lines_of(text), 1, 5), lambda x: strip(x))

    def fits(line: Column) -> Column:
        tokens = F.split(line, r"\s+")
        hint = F.lit(False)
        for h in URL_HINTS:
            hint = hint | F.contains(F.lower(line), F.lit(h))
        capital = F.forall(tokens, lambda t: F.regexp_replace(t, "[.,]+$", "").rlike(r"^\p{Lu}"))
        stop = F.exists(tokens, lambda t: F.lower(t).isin(*NOT_NAMES))
        return (line != "") & F.size(tokens).between(2, 4) & ~line.rlike(r"\p{Nd}") & ~F.contains(line, F.lit("@")) & ~hint & ~stop & capital

    return F.get(F.filter(top, fits), F.lit(0))


def linkedin(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?i)linkedin\.com/in/[\w\-]+"), F.lit(0))


def github(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?i)github\.com/[\w\-]+"), F.lit(0))


def portfolio(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?i)https?://(?!linkedin|github)[\w\-\.]+\.[a-z]{2,}"), F.lit(0))


def location(text: Column) -> Column:
    """``struct<city, region, country>`` of the first known city, or null."""
    pattern = r"(?i)\b(" + "|".join(CITIES) + r")\b(?:,\s*([a-zA-Z\s]{2,20}))?(?:,\s*India)?"
    city, region = F.regexp_extract(text, pattern, 1), strip(F.regexp_extract(text, pattern, 2))
    known = literal_map({c.lower(): c for c in CITIES})[F.lower(city)]
    return F.when(city != "", F.struct(known.alias("city"), F.when((region != "") & ~F.lower(region).isin("india", "in"), region).alias("region"), F.lit("IN").alias("country")))


# -- skills ----------------------------------------------------------------------


def _tokens(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda t: strip(t)), lambda t: F.length(t).between(2, 50) & ~t.rlike(r"^\d+$"))


def section_skills(text: Column) -> Column:
    """Tokens of a skills section: a line with a colon begins a block, of a token the part after its last colon counts."""
    marked = F.regexp_replace(F.array_join(F.transform(lines_of(text), lambda x: F.when(F.contains(x, F.lit(":")), F.concat(F.lit("\u0001"), x)).otherwise(x)), " "), "^\u0001", "")
    parts = F.flatten(F.transform(F.split(marked, "\u0001"), lambda b: F.split(b, r"[,;|•\t*]+")))
    return _tokens(F.transform(parts, lambda t: F.element_at(F.split(t, ":"), -1)))


def document_skills(text: Column) -> Column:
    """Tokens of a whole document."""
    return _tokens(F.split(F.regexp_replace(text, "\n", " "), r"[,;|•\t*]+"))


def prose_skills(text: Column) -> Column:
    """Tokens of running text, where hyphens and line ends separate too."""
    return _tokens(F.split(text, r"[,;|•\n\-*]+"))


def skill_confidence(base: float, match_type: Column) -> Column:
    return F.lit(base) * literal_map(MATCH_WEIGHT)[match_type]


# -- dates, roles ----------------------------------------------------------------

_DASH = r"\s*[\-–—]\s*"
_RANGES = (
    rf"(?i)^(.*?)\b({MONTH_NAMES})\s+(\d{{4}}){_DASH}({MONTH_NAMES})\s+(\d{{4}})\b",
    rf"(?i)^(.*?)\b({MONTH_NAMES})\s+(\d{{4}}){_DASH}(?:{'|'.join(PRESENT)})\b",
    rf"^(.*?)\b(\d{{4}}){_DASH}(\d{{4}})\b",
    rf"(?i)^(.*?)\b({MONTH_NAMES})\s+(\d{{4}})\b",
)


def date_range(line: Column) -> Column:
    """``struct<start, end, is_present, company>`` of a line with dates, or null; company is what stands before them."""

    def group(k: int, n: int) -> Column:
        return F.regexp_extract(line, _RANGES[k], n)

    def month(k: int, n: int) -> Column:
        return F.concat(group(k, n + 1), F.lit("-"), month_number(group(k, n)))

    def made(k: int, start: Column, end: Column | None, present: bool) -> Column:
        before = strip(F.regexp_replace(strip(group(k, 1)), r"[,|:\-]+$", ""))
        end = F.lit(None).cast("string") if end is None else end
        return F.when(line.rlike(_RANGES[k]), F.struct(start.alias("start"), end.alias("end"), F.lit(present).alias("is_present"), F.when((before != "") & (F.length(before) < 50), before).alias("company")))

    return F.coalesce(made(0, month(0, 2), month(0, 4), False), made(1, month(1, 2), None, True), made(2, group(2, 2), group(2, 3), False), made(3, month(3, 2), None, False))


def _any(line: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(line), F.lit(w))
    return out


def _staged(df: DataFrame, steps: list[tuple[str, object]]) -> DataFrame:
    """Each step's column as a one-element explode, which the optimizer does not fold into the next step.

    Folded together the steps would hold one another many times over.
    """
    for name, step in steps:
        value = step() if callable(step) else step
        df = df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))
    return df


def _extended(b: Column, names: list[str], **more: Column) -> Column:
    return F.struct(*(b[n].alias(n) for n in names), *(c.alias(n) for n, c in more.items()))


def with_roles(df: DataFrame, text: str, out: str, confidence: Column | None = None) -> DataFrame:
    """``df`` with the roles of the experience section in column ``text``; without dates each paragraph is a role.

    Going back from a dated line, its block begins after the last dated line or
    stop (a bullet, or a line whose first letter is small) and reaches to where
    the next block begins.  Roles that overlap another one are concurrent; a role
    without dates counts as of the present month.
    """
    confidence = F.lit(SECTION_BODY) if confidence is None else confidence
    none = "struct<start:string,end:string,is_present:boolean,company:string>"

    def first(d: Column) -> Column:
        walls = F.filter("_walls", lambda w: w < d)
        return 1 + F.coalesce(F.array_max(walls), F.lit(-1))

    def block(d: Column, k: Column) -> Column:
        start, stop = F.get("_first", k), F.coalesce(F.get("_first", k + 1), F.size("_lines"))
        return F.struct(F.slice("_lines", start + 1, stop - start).alias("lines"), F.get("_dates", d).cast(none).alias("dates"), F.get("_lines", d).alias("line"))

    def rest(b: Column) -> Column:
        return F.filter(b["lines"], lambda x: ~x.eqNullSafe(b["line"]) & ~x.eqNullSafe(b["title"]))

    def overlaps(i: Column) -> Column:
        own = F.get("_spans", i)
        met = F.transform("_spans", lambda x, j: (i != j) & (own["s"] <= x["e"]) & (x["s"] <= own["e"]))
        return F.exists(met, lambda x: x)

    keep = ["lines", "dates", "line"]
    loose = F.transform(F.split(text, "\n\n"), lambda p: F.struct(F.filter(F.transform(F.split(p, "\n"), lambda x: strip(x)), lambda x: x != "").alias("lines"), F.lit(None).cast(none).alias("dates"), F.lit(None).cast("string").alias("line")))
    staged = _staged(df, [
        ("_lines", full_lines(F.col(text))),
        ("_dates", F.transform("_lines", date_range)),
        ("_at", F.filter(F.transform("_dates", lambda d, i: F.when(d.isNotNull(), i)), lambda i: i.isNotNull())),
        ("_stops", F.filter(F.transform("_lines", lambda x, i: F.when(x.rlike(r"^[^\p{L}\p{N}_\s(\[{]") | x.rlike(r"^[^a-zA-Z]*[a-z]"), i)), lambda i: i.isNotNull())),
        ("_walls", F.array_union("_at", "_stops")),
        ("_first", F.transform("_at", first)),
        ("_blocks", lambda: F.when(F.size("_at") > 0, F.transform("_at", block)).otherwise(F.filter(loose, lambda b: F.size(b["lines"]) > 0))),
        ("_blocks", lambda: F.transform("_blocks", lambda b: _extended(b, keep, title=F.get(F.filter(b["lines"], lambda x: ~x.eqNullSafe(b["line"]) & _any(x, TITLE_WORDS)), F.lit(0))))),
        ("_blocks", lambda: F.transform("_blocks", lambda b: _extended(b, [*keep, "title"], rest=rest(b)))),
        ("_blocks", lambda: F.transform("_blocks", lambda b: _extended(b, [*keep, "title"], company=F.coalesce(b["dates"]["company"], F.get(F.filter(b["rest"], lambda x: _any(x, COMPANY_WORDS)), F.lit(0)), F.get(b["rest"], F.lit(0)))))),
        ("_blocks", lambda: F.transform("_blocks", lambda b: _extended(b, [*keep, "title", "company"], said=F.filter(b["lines"], lambda x: ~x.eqNullSafe(b["title"]) & ~x.eqNullSafe(b["company"]) & ~x.eqNullSafe(b["line"]))))),
        (out, lambda: F.transform(F.filter("_blocks", lambda b: b["company"].isNotNull() | b["title"].isNotNull()), lambda b: F.struct(
            b["company"].alias("company"), b["title"].alias("title"), b["dates"]["start"].alias("start"), b["dates"]["end"].alias("end"), F.when(F.size(b["said"]) > 0, F.array_join(b["said"], "\n")).alias("summary"),
            F.lit(False).alias("concurrent"), F.array(F.lit("resume")).alias("sources"), confidence.alias("confidence")))),
        ("_spans", lambda: F.transform(out, lambda r: F.struct(month_index(r["start"]).alias("s"), month_index(r["end"]).alias("e")))),
        (out, lambda: F.transform(out, lambda r, i: r.withField("concurrent", overlaps(i)))),
    ])
    return staged.drop("_lines", "_dates", "_at", "_stops", "_walls", "_first", "_blocks", "_spans")


# -- education -------------------------------------------------------------------

_YEAR = r"\b(?:19|20)\d{2}\b"


def end_year(line: Column) -> Column:
    """The last year on a line, or null."""
    years = F.regexp_extract_all(line, F.lit(_YEAR), F.lit(0))
    return F.get(years, F.size(years) - 1).try_cast("int")


def is_education_header(line: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(r"\b\w+\b"), F.lit(0)))
    return (F.size(F.array_intersect(words, F.array(*map(F.lit, EDUCATION_HEADERS)))) >= 2) & ~line.rlike(_YEAR)


def has_school(line: Column) -> Column:
    return line.rlike(r"(?i)\b(?:" + "|".join(INSTITUTIONS) + r")\b")


def _word(keyword: str) -> str:
    return r"(?i)\b" + keyword.replace(".", r"\.") + r"\b"


def _degree_keyword(line: Column) -> Column:
    return F.coalesce(*(F.when(line.rlike(_word(k)), F.lit(k)) for k in DEGREES))


def with_education(df: DataFrame, text: str, out: str, confidence: Column | None = None) -> DataFrame:
    """``df`` with the education entries of the section in column ``text``; without years each paragraph is one.

    Going back from a line with a year, its block begins after the last year or
    table heading; a line with a school ends the way back and belongs to it, and
    a line that has both year and school goes back nowhere.
    """
    confidence = F.lit(SECTION_BODY) if confidence is None else confidence
    pattern = r"\b(?:[A-Z][A-Za-z0-9]*\s+){1,3}(?:" + "|".join(INSTITUTIONS) + r")(?:\s+(?:of|and|for))?(?:\s+[A-Z][A-Za-z0-9]*){0,3}\b"
    peel = r"^(?i)(?:(?:" + "|".join(ACADEMIC_WORDS) + r")[,.:;\-]*\s+)+"

    def begin(d: Column) -> Column:
        wall = 1 + F.coalesce(F.array_max(F.filter("_walls", lambda w: w < d)), F.lit(-1))
        school = F.coalesce(F.array_max(F.filter("_schools", lambda w: w < d)), F.lit(0))
        return F.when(F.array_contains("_schools", d), d).otherwise(F.greatest(wall, school))

    def block(d: Column, k: Column) -> Column:
        start, stop = F.get("_first", k), F.coalesce(F.get("_first", k + 1), F.size("_lines"))
        return F.struct(F.slice("_lines", start + 1, stop - start).alias("lines"), F.get("_years", d).alias("year"))

    def numbers(test) -> Column:
        return F.filter(F.transform("_lines", lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())

    def names(b: Column) -> Column:
        found = F.transform(b["lines"], lambda x: F.regexp_replace(F.regexp_extract(x, pattern, 0), peel, ""))
        return F.get(F.filter(found, lambda x: F.length(x) > 4), F.lit(0))

    def plain(b: Column) -> Column:
        return F.get(F.filter(b["lines"], lambda x: _degree_keyword(x).isNull() & ~(x.rlike(_YEAR) & (F.length(x) < 15))), F.lit(0))

    def degree(b: Column) -> Column:
        start, stop = F.instr(F.lower(b["d"]), F.lower(b["word"])), F.instr(b["d"], F.coalesce(b["named"], F.lit("")))
        end = F.when(b["named"].isNotNull() & (stop > start), stop).otherwise(F.length(b["d"]) + 1)
        return strip(F.regexp_replace(strip(F.substr(b["d"], start, end - start)), r"[,|:\-]+$", ""))

    def field(b: Column) -> Column:
        tail = strip(F.regexp_replace(strip(F.substr(b["degree"], F.length(b["word"]) + 1)), r"(?i)^(?:in|of|-)?\s*", ""))
        return strip(F.regexp_replace(tail, r"^[()]+|[()]+$", ""))

    keep = ["lines", "year"]
    loose = F.transform(F.split(text, "\n\n"), lambda p: F.struct(F.filter(F.transform(F.split(p, "\n"), lambda x: strip(x)), lambda x: x != "").alias("lines"), F.lit(None).cast("int").alias("year")))
    staged = _staged(df, [
        ("_lines", full_lines(F.col(text))),
        ("_years", F.transform("_lines", end_year)),
        ("_at", F.filter(F.transform("_years", lambda y, i: F.when(y.isNotNull(), i)), lambda i: i.isNotNull())),
        ("_walls", lambda: F.array_union("_at", numbers(is_education_header))),
        ("_schools", lambda: numbers(has_school)),
        ("_first", F.transform("_at", begin)),
        ("_blocks", lambda: F.when(F.size("_at") > 0, F.transform("_at", block)).otherwise(F.filter(loose, lambda b: F.size(b["lines"]) > 0))),
        ("_blocks", lambda: F.transform("_blocks", lambda b: _extended(b, keep, named=names(b), plain=plain(b), d=F.get(F.filter(b["lines"], lambda x: _degree_keyword(x).isNotNull()), F.lit(0))))),
        ("_blocks", lambda: F.transform("_blocks", lambda b: _extended(b, [*keep, "named", "plain", "d"], word=_degree_keyword(b["d"])))),
        ("_blocks", lambda: F.transform("_blocks", lambda b: _extended(b, [*keep, "named", "plain", "word"], degree=degree(b)))),
        ("_blocks", lambda: F.transform("_blocks", lambda b: _extended(b, keep, institution=F.coalesce(b["named"], b["plain"]), degree=b["degree"], field=field(b)))),
        (out, lambda: F.transform(F.filter("_blocks", lambda b: b["institution"].isNotNull() | b["degree"].isNotNull()), lambda b: F.struct(
            b["institution"].alias("institution"), b["degree"].alias("degree"), F.when(b["field"] != "", b["field"]).alias("field"),
            b["year"].alias("end_year"),  # a block without a year line has no year on any line
            F.array(F.lit("resume")).alias("sources"), confidence.alias("confidence")))),
    ])
    return staged.drop("_lines", "_years", "_at", "_walls", "_schools", "_first", "_blocks")


def adjusted(confidence: Column, no_sections: Column, near_empty: Column) -> Column:
    """Less 0.15 without sections, then times 0.3 for a nearly empty text, within 0 and 1."""
    c = F.when(no_sections, confidence - F.lit(0.15)).otherwise(confidence)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(near_empty, c * F.lit(0.3)).otherwise(c)))


def near_empty(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))) < 50
