"""Arbitration, normalizers, projection and text on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from claimweave.functions import normalize as N
from claimweave.functions import text as T
from claimweave.operators import arbitrate as A
from claimweave.operators import projection as P
from claimweave.operators import roles as R
from claimweave.operators.taxonomy import from_dict, match_tokens
from claimweave.plans import catalogue, pipeline
from claimweave.sources import files as S
from claimweave.sources.files import as_claims, kept_value

TAXONOMY = {"python": {"canonical": "Python", "aliases": ["py"], "category": "x"}, "next.js": {"canonical": "Next.js", "aliases": ["nextjs"]}}


def claims(spark, rows):
    base = spark.createDataFrame([("e", i, f, v, v, s, t, c, "exact", v) for i, (f, v, s, t, c) in enumerate(rows)], "entity_id string, ord bigint, field string, raw_value string, normalized_value string, source string, source_type string, confidence double, match_type string, canonical_name string")
    return as_claims(base, "structured", "direct_field", "structured_field")


@pytest.mark.parametrize(
    "rows, values, best",
    [
        ([("email", "x", "S", "structured", 0.80), ("email", "x", "U", "unstructured", 0.70)], ["x"], 0.95),
        ([("email", "x", "S", "structured", 0.80), ("email", "y", "U", "unstructured", 0.60)], ["x", "y"], 0.80),
        ([("email", "x", "S", "structured", 0.80), ("email", None, "U", "unstructured", 0.50)], ["x"], 0.80),
    ],
)
def test_union(spark, rows, values, best):
    r = A.union_fields(A.corroborate(claims(spark, rows))).first()
    assert list(r["values"]) == values and r.winning_confidence == pytest.approx(best)


@pytest.mark.parametrize(
    "rows, value, confidence, conflict",
    [
        ([("headline", "a", "S", "structured", 0.85), ("headline", "b", "U", "unstructured", 0.71)], "a", 0.85, False),
        ([("headline", "a", "S", "structured", 0.85), ("headline", "a", "U", "unstructured", 0.70)], "a", 1.0, False),
        ([("headline", "a", "S", "unstructured", 0.85), ("headline", "b", "U", "structured", 0.81)], "b", 0.81, True),
    ],
)
def test_highest(spark, rows, value, confidence, conflict):
    r = A.highest_confidence(A.corroborate(claims(spark, rows))).first()
    assert (r.value, r.conflict_detected) == (value, conflict) and r.winning_confidence == pytest.approx(confidence)


def test_skill_bonus(spark):
    r = A.union_skills(claims(spark, [("skills", "Go", "S", "structured", 0.8), ("skills", "Go", "U", "unstructured", 0.7)])).first()
    assert (r["name"], r.confidence) == ("Go", 0.95)


@pytest.mark.parametrize("spans, years", [([("2020-01", "2022-12")], 3.0), ([("2019-01", "2020-12"), ("2022-01", "2022-12")], 3.0), ([("2019-01", "2022-06"), ("2021-03", "2023-06")], 4.5), ([("2022-01", "Present")], 1.5), ([("2022-01", "2022-03")], 0.2)])
def test_years(spark, spans, years):
    d = spark.createDataFrame([("e", i, s, e) for i, (s, e) in enumerate(spans)], "entity_id string, ord int, a string, b string")
    d = d.select("entity_id", "ord", A.month_index(F.col("a"), "2023-06").alias("s"), A.month_index(F.col("b"), "2023-06", 12).alias("e"))
    assert A.years_of_experience(d).first().years == years


def test_intervals_against_brute_force(spark):
    r = random.Random(4)
    rows = [(str(e), i, s := r.randrange(0, 60), s + r.randrange(-5, 20)) for e in range(60) for i in range(r.randrange(1, 9))]
    d = spark.createDataFrame(rows, "entity_id string, ord int, s int, e int")
    got = {(x.entity_id, x.ord): x.concurrent for x in A.concurrent(d).collect()}
    years = {x.entity_id: x.total_months for x in A.years_of_experience(d).collect()}
    for e in {x[0] for x in rows}:
        mine = [x for x in rows if x[0] == e]
        for x in mine:
            assert got[e, x[1]] == any(x[2] <= y[3] and y[2] <= x[3] for y in mine if y is not x)
        merged = []
        for x in sorted(mine, key=lambda x: x[2]):
            if merged and x[2] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], x[3])
            else:
                merged.append([x[2], x[3]])
        assert years[e] == sum(b - a + 1 for a, b in merged)


@pytest.mark.parametrize(
    "how, raw, value, status",
    [
        ("phone", "9876543210", "+919876543210", "success"), ("phone", "(415) 555-0100", "+14155550100", "success"), ("phone", "+919876543210", "+919876543210", "success"), ("phone", "N/A", None, "failed"), ("phone", "call me", None, "failed"), ("phone", "555-HIRE", None, "failed"),
        ("email", " A@X.Com ", "a@x.com", "success"), ("email", "not-an-email", None, "failed"), ("email", "a@x.com; b@x.com", "a@x.com", "success"), ("date", "Jan 2023", "2023-01", "success"), ("date", "2023", "2023-01", "partial"), ("date", "3/2021", "2021-03", "success"),
        ("date", "Present", None, "not_applicable"), ("date", "garbage", None, "failed"), ("date", "Sept 2022", None, "failed"), ("name", "Doe, Jane", "Jane Doe", "success"), ("name", "JANE  DOE", "Jane Doe", "success"), ("name", "o'neil mary-ann", "O'Neil Mary-Ann", "success"), ("name", "", None, "failed"), ("country", "India", "IN", "success"), ("country", "IN", None, "failed"),
    ],
)
def test_normalizers(spark, how, raw, value, status):
    r = spark.createDataFrame([(raw,)], "x string").select(getattr(N, f"{how}_normalized")(F.col("x")).alias("r")).first().r
    assert (r.value, r.status) == (value, status)


def test_role_fold():
    role = {"company": "Acme Inc", "title": "Dev", "start": "2020-01", "end": "2021-01", "summary": "a", "concurrent": False, "sources": ["x"], "confidence": 0.5}
    out = R.fold([role, role | {"company": "ACME", "title": "Developer", "start": "2021-02", "end": None, "sources": ["y"], "summary": "b"}, role | {"company": "Other", "start": "2019-01", "end": "2019-05"}])
    assert [r["company"] for r in out] == ["Acme Inc", "Other"]
    assert out[0]["title"] == "Developer" and out[0]["end"] == "2021-01" and out[0]["sources"] == ["x", "y"] and out[0]["summary"] == "a | b" and out[0]["confidence"] == pytest.approx(0.6)


def test_matching(spark):
    t = from_dict(spark, TAXONOMY)
    got = {r.token: (r.canonical_name, r.match_type) for r in match_tokens(spark.createDataFrame([("PY",), ("Python",), ("pythonn",), ("zzz",)], "token string"), t).collect()}
    assert got == {"PY": ("Python", "alias"), "Python": ("Python", "exact"), "pythonn": ("Python", "fuzzy"), "zzz": ("zzz", "unverified")}


def test_sections(spark):
    text = "Jane Doe\njane@x.com\n\nSKILLS\nPython, Next.js\n\nWork Experience:\nAcme"
    found = spark.createDataFrame([(text,)], "t string").select(T.sections(F.col("t")).alias("s")).first().s
    assert {s.name: s.body for s in found if s.name != "CONTACT_BLOCK"} == {"SKILLS": "Python, Next.js", "EXPERIENCE": "Acme"}
    whole = spark.createDataFrame([("no headings here",)], "t string").select(T.sections(F.col("t")).alias("s")).first().s
    assert [s.name for s in whole] == ["CONTACT_BLOCK", "FULL_DOCUMENT"]


def test_projection(spark):
    d = spark.createDataFrame([("e", "Jane", None, 0.4)], "entity_id string, full_name string, headline string, overall_confidence double")
    out = P.project(d, P.ProjectionConfig([{"path": "name", "from": "full_name"}], True, False)).first().asDict()
    assert out == {"entity_id": "e", "name": "Jane", "overall_confidence": 0.4}
    with pytest.raises(Exception, match="missing"):
        P.project(d, P.ProjectionConfig([{"path": "headline", "required": True}])).collect()
    assert P.validate_config({"fields": [{"path": "a"}], "on_missing": "x"}) != []


def test_run(spark, tmp_path):
    (tmp_path / "people.csv").write_text("name,email,phone,current_company,title\nAsha Example,asha@example.com,+919876543210,Works,Intern\nshort,row\nBo Bad,bo@x.org,call me,n/a,-\n")
    (tmp_path / "empty.csv").write_text("")
    r = pipeline.run(spark, [str(tmp_path)], taxonomy=TAXONOMY)
    out = {x.entity_id: x for x in r.output.collect()}
    assert set(out) == {"asha@example.com", "bo@x.org"} and out["asha@example.com"].phones == ["+919876543210"] and out["bo@x.org"].phones == []
    said = " ".join(x.warning for x in r.warnings.collect())
    assert "Empty file" in said and "Malformed row 3" in said and "call me" in said
    with pytest.raises(ValueError, match="Invalid input"):
        pipeline.run(spark)


def test_missing_values(spark):
    d = spark.createDataFrame([("e", "Jane", None), ("f", None, "x")], "entity_id string, full_name string, headline string")
    config = P.ProjectionConfig([{"path": "full_name", "required": True}, {"path": "headline"}], False, False, "omit")
    assert {x.entity_id: x.why for x in d.select("entity_id", P.missing(d, config).alias("why")).collect()} == {"e": None, "f": "Required field is missing: full_name"}
    with pytest.raises(P.ProjectionError, match="full_name"):
        P.require(d, config)
    P.require(d.where("entity_id = 'e'"), config)
    with pytest.raises(P.ProjectionError, match="on_missing"):
        P.project(d, P.ProjectionConfig(on_missing="x"))
    assert P.project_json(d.where("entity_id = 'e'"), config).first().output == '{"full_name":"Jane"}'
    assert P.project(d, config, strict=False).count() == 2


def test_counted_log(spark):
    n = [spark.range(k) for k in range(1, 8)]
    r = pipeline.Result(*n, log=[{"step": "input", "details": "x"}, {"step": "extract", "details": "y"}, {"step": "arbitrate", "details": "z"}])
    assert [x.get("rows") for x in r.counted()] == [1, None, 3]


def test_scans(spark, tmp_path):
    (tmp_path / "scan.pdf").write_bytes(b"%PDF-1.4 scanned")
    (tmp_path / "plain.pdf").write_bytes(b"%PDF-1.4 " + b"Jane Roe\njane@x.org\n" * 20)
    text = lambda c: F.substr(c.cast("string"), F.lit(10))
    found = S.detect(S.read_files(spark, [str(tmp_path), str(tmp_path / "none")]), text(F.col("content")), content=True)
    assert {x.file_name: (x.detected_type, x.warning) for x in found.collect()} == {"scan.pdf": ("image_pdf", "Scanned PDF detected, OCR required"), "plain.pdf": ("pdf", None)}
    got = {x.source: (x.text, x.warning) for x in S.document_text(found, text, lambda c: F.lit("Ann Poe")).collect()}
    assert got["scan.pdf"] == ("Ann Poe", None) and got["plain.pdf"][0].startswith("Jane Roe")
    got = {x.source: (x.text, x.warning) for x in S.document_text(found).collect()}
    assert got["scan.pdf"] == ("", "OCR is not available: no text was extracted from the scanned PDF.") and got["plain.pdf"] == ("", "Text extraction failed")


def test_white_space(spark):
    """Values are trimmed of all white space."""
    raw = "\t\u00a0 A@X.com\u2003\r\n"
    r = spark.createDataFrame([(raw, "\t")], "x string, y string").select(N.email_normalized(F.col("x")).alias("e"), A.equality_key(F.lit("email"), F.col("x")).alias("k"), kept_value(F.col("y")).alias("kept"), N.country_normalized(F.lit("\nIndia\t")).alias("c")).first()
    assert (r.e.value, r.k, r.kept, r.c.value) == ("a@x.com", "a@x.com", False, "IN")


def test_overlapping_roles(spark):
    text = "A Inc\nEngineer\nJan 2020 - Mar 2021\n- x\nB Ltd Mar 2021 - Dec 2022\nAnalyst\n- y\nC Corp Jan 2015 - Jan 2016\nManager\n- z"
    found = T.with_roles(spark.createDataFrame([(text,)], "t string"), "t", "roles").first().roles
    assert [(x.company, x.concurrent) for x in found] == [("A Inc", True), ("B Ltd", True), ("C Corp", False)]


def test_samples():
    for c in P.SAMPLES.values():
        assert P.validate_config({"fields": c.fields, "on_missing": c.on_missing}) == []
    assert [f["path"] for f in P.SAMPLES["custom"].fields][:2] == ["full_name", "primary_email"]


def test_role_merge_by_entity(spark):
    """Merged roles of random entities are each entity's own fold, in its order."""
    r = random.Random(9)
    rows = [(str(e), i, r.choice(["Acme Inc", "ACME", "Bolt", "Core"]), r.choice(["Dev", "Lead"]), f"20{r.randint(10, 20)}-{r.randint(1, 12):02d}", f"20{r.randint(15, 24)}-{r.randint(1, 12):02d}", "s", False, [r.choice("xy")], 0.5) for e in range(30) for i in range(r.randint(1, 6))]
    d = spark.createDataFrame(rows, R.ROLE_COLUMNS)
    got = {(x.entity_id, x.ord): (x.company, x.title, x.start, x.end) for x in R.merge_roles(d).collect()}
    for e in {x[0] for x in rows}:
        mine = [dict(zip(("company", "title", "start", "end", "summary", "concurrent", "sources", "confidence"), x[2:], strict=True)) for x in rows if x[0] == e]
        want = {i: (x["company"], x["title"], x["start"], x["end"]) for i, x in enumerate(R.fold(mine))}
        assert {k[1]: v for k, v in got.items() if k[0] == e} == want


def test_sections_evaluate_once(spark):
    """Headings are looked for once a text, however many sections it has, and bodies of one name are joined."""
    said = str(T.sections(F.col("t")))
    assert said.count("\\p{Lu}") == 1 and said.count("array_distinct") == 1
    text = "Jane\nSKILLS\na\nEducation:\nb\n\nWORK HISTORY\nc\nskills\nd\nEND"
    rows = spark.createDataFrame([(text,), (None,), ("",), ("ONLY",)], "t string").select(T.sections(F.col("t")).alias("s"), T.header_positions(F.col("t")).alias("at")).collect()
    assert [(s.name, s.body) for s in rows[0].s][1:] == [("SKILLS", "a\nd\nEND"), ("EDUCATION", "b"), ("EXPERIENCE", "c")] and rows[0]["at"] == [1, 3, 6, 8]
    assert [[s.name for s in r.s] for r in rows[2:]] == [["CONTACT_BLOCK", "FULL_DOCUMENT"]] * 2


def test_documents_of_a_small_file_are_dealt(spark, tmp_path):
    """Many documents made from one small file are parsed by all cores, with the same education as ever."""
    spark.range(12, numPartitions=1).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    assert catalogue._cv(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    got = sorted((int(x.source[2:]) % 3, x.institution, x.degree, x.end_year) for x in catalogue.QUERIES["education_rows"](spark, str(tmp_path)).collect())
    assert got == sorted([(0, "North State University", "B.Tech in Physics", 2019), (0, "City School", "Class XII", 2015), (1, "Hill College", "MBA", None), (2, "Lake Institute", "M.Sc in Biology", 2014)] * 4, key=lambda x: (x[0], x[1]))


def test_role_merge_many_entities_at_a_time(spark):
    """No call for each entity; entities that go over several batches, null ids, odd dates and companies within others come out as by ``fold``."""
    r = random.Random(5)
    dates = [None, "", "Present", "2020", "x", "123456789012345678901234-05", *(f"20{y}-{m:02d}" for y in range(10, 20) for m in (1, 6))]
    names = ("company", "title", "start", "end", "summary", "concurrent", "sources", "confidence")
    rows = [(e, i, r.choice([None, "", "Inc", "Acme Inc", "ACME", "acme labs ltd", "Bolt", "Core", "Core Bolt"]), r.choice([None, "Dev", "Lead"]), r.choice(dates), r.choice(dates), r.choice([None, "a", "b"]), r.random() < 0.1, [r.choice("xy")], 0.5) for e in (None, *map(str, range(40))) for i in range(r.randint(1, 25))]
    want = {(e, i): x for e in {x[0] for x in rows} for i, x in enumerate(R.fold([dict(zip(names, x[2:], strict=True)) for x in rows if x[0] == e]))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = R.merge_roles(spark.createDataFrame(rows, R.ROLE_COLUMNS))
        got = {(x["entity_id"], x["ord"]): {n: x[n] for n in names} for x in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(want) < len(rows)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()


def test_documents_are_parsed_once(spark):
    """Profiles read kept claims: the parsing of documents does not stand in their plan, once for each reader."""
    from claimweave.operators import canonical as C
    from claimweave.plans.extract import document_claims

    d = spark.createDataFrame([("a", "Jane Roe\njane@x.org\n\nSKILLS\nPython, Go\n\nEXPERIENCE\nAcme Inc\nEngineer\nJan 2020 - Mar 2021"), ("b", None)], "source string, text string")
    p = C.canonical(N.normalize_claims(document_claims(d, from_dict(spark, TAXONOMY))))
    assert "\\p{Lu}" not in p._jdf.queryExecution().analyzed().toString()
    got = p.first()
    assert p.count() == 1 and (got.entity_id, got.source_files, got.years_experience, len(got.skills)) == ("jane@x.org", ["a"], 1.2, 2)
