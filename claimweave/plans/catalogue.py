"""Every query of the library by name, with equivalent DuckDB SQL where SQL can express it.

Claims are derived from the driver's tables in the same way on both sides.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import text as T
from ..functions.constants import CITIES, FIELD_CONFIDENCE, WHITE
from ..operators import arbitrate as A
from ..operators import canonical as C
from ..operators import projection as P
from ..operators import taxonomy as X
from ..operators.roles import merge_roles
from ..operators.validate import validate
from ..sources import files as S
from .extract import document_claims

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            # SQL's own trim takes blanks only; name the characters.
            SQL[f.__name__] = re.sub(r"\btrim\(([\w.]+)\)", lambda m: f"trim({m[1]}, '{WHITE}')", sql)
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- claims from the tables -------------------------------------------------------

_CLAIMS = """
claims AS (SELECT user_id || '|' || strftime(ts, '%Y-%m-%d') AS entity_id, event_id AS ord, 'headline' AS field, event_type AS value, 'src' || (event_id % 3) AS source,
  CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS st, CASE event_id % 5 WHEN 0 THEN 0.95::DOUBLE WHEN 1 THEN 0.85::DOUBLE WHEN 2 THEN 0.80::DOUBLE WHEN 3 THEN 0.665::DOUBLE ELSE 0.535::DOUBLE END AS base FROM events),
counted AS (SELECT *, count(*) OVER (PARTITION BY entity_id, value) AS k FROM claims),
boosted AS (SELECT *, list_reduce(list_concat([base], list_transform(range(1, k), lambda i: 0.15::DOUBLE)), lambda a, x: least(1.0::DOUBLE, a + x)) AS confidence FROM counted)
"""


def claims(spark: SparkSession, sf_dir: str, field: str = "headline") -> DataFrame:
    """An entity for each user and day; the event's type is the value."""
    e = _read(spark, sf_dir, "events")
    levels = [0.95, 0.85, 0.80, 0.665, 0.535]
    rows = e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("|"), F.date_format("ts", "yyyy-MM-dd")).alias("entity_id"), F.col("event_id").alias("ord"), F.lit(field).alias("field"), F.col("event_type").alias("raw_value"),
        F.col("event_type").alias("normalized_value"), F.concat(F.lit("src"), F.col("event_id") % 3).alias("source"), F.when(F.col("event_id") % 3 == 0, "structured").otherwise("unstructured").alias("source_type"),
        F.element_at(F.array(*map(F.lit, levels)), (F.col("event_id") % 5 + 1).cast("int")).alias("confidence"), F.lit("exact").alias("match_type"), F.col("event_type").alias("canonical_name"),
    )
    return S.as_claims(rows, "structured", "direct_field", "structured_field")


_INTERVALS = """
intervals AS (SELECT o_custkey::VARCHAR AS entity_id, year(o_orderdate) * 12 + month(o_orderdate) AS s, year(l_shipdate) * 12 + month(l_shipdate) AS e, l_orderkey * 100 + l_linenumber AS ord
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month intervals of every customer, from order to shipment; some are inverted."""
    o, li = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem")
    rows = o.select("o_orderkey", "o_custkey", "o_orderdate").join(li.select("l_orderkey", "l_linenumber", "l_shipdate"), F.col("o_orderkey") == F.col("l_orderkey"))

    def month(c: str):
        return F.year(c) * 12 + F.month(c)

    return rows.select(F.col("o_custkey").cast("string").alias("entity_id"), month("o_orderdate").alias("s"), month("l_shipdate").alias("e"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"))


@query("""
SELECT 'customer' AS source, c_custkey AS id, 'full_name' AS field, c_name AS value, 0.85::DOUBLE AS confidence FROM customer WHERE trim(c_name) <> '' AND lower(trim(c_name)) NOT IN ('n/a','na','null','none','-')
UNION ALL SELECT 'customer', c_custkey, 'headline', c_mktsegment, 0.80::DOUBLE FROM customer WHERE trim(c_mktsegment) <> '' AND lower(trim(c_mktsegment)) NOT IN ('n/a','na','null','none','-')
UNION ALL SELECT 'supplier', s_suppkey, 'full_name', s_name, 0.85::DOUBLE FROM supplier WHERE trim(s_name) <> '' AND lower(trim(s_name)) NOT IN ('n/a','na','null','none','-')
""")
def claims_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide rows to one claim for each filled cell."""
    c = _read(spark, sf_dir, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("headline"))
    s = _read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("full_name"), F.lit(None).cast("string").alias("headline"))
    rows = c.unionByName(s).unpivot(["source", "id"], ["full_name", "headline"], "field", "value")
    return rows.where(S.kept_value(F.col("value"))).withColumn("confidence", N.literal_map(FIELD_CONFIDENCE)[F.col("field")])


@query(f"WITH {_CLAIMS} SELECT b.entity_id, b.ord, b.confidence, coalesce((SELECT string_agg(DISTINCT c.source, ',' ORDER BY c.source) FROM claims c WHERE c.entity_id = b.entity_id AND c.value = b.value AND c.ord <> b.ord), '') AS corroborated_by FROM boosted b")
def claim_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raised confidences and corroborating sources (A2, A3)."""
    return A.corroborate(claims(spark, sf_dir)).select("entity_id", "ord", "confidence", F.array_join("corroborated_by", ",").alias("corroborated_by"))


@query(f"""WITH {_CLAIMS}, v AS (SELECT entity_id, trim(value) AS k, arg_min(value, ord) AS value, min(ord) AS first_ord, max(confidence) AS confidence, first(source ORDER BY confidence DESC, ord) AS source, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM boosted GROUP BY 1, 2)
SELECT entity_id, value, confidence, source, sources, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, first_ord) AS rank FROM v""")
def union_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of each entity, best first (A4)."""
    return A.union_values(A.corroborate(claims(spark, sf_dir))).select("entity_id", "value", "confidence", "source", F.array_join("sources", ",").alias("sources"), F.col("rank").cast("long").alias("rank"))


_WINNERS = f"""WITH {_CLAIMS}, m AS (SELECT *, max(confidence) OVER (PARTITION BY entity_id) AS mx FROM boosted),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY st DESC, confidence DESC, ord) AS rn FROM m WHERE mx - confidence <= 0.05::DOUBLE) WHERE rn = 1)
"""


@query(_WINNERS + "SELECT entity_id, value, source AS winning_source, confidence AS winning_confidence, ord AS winning_ord FROM w")
def highest_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winning claim of each entity."""
    return A.highest_confidence(A.corroborate(claims(spark, sf_dir))).select("entity_id", "value", "winning_source", "winning_confidence", "winning_ord")


@query(_WINNERS + "SELECT w.entity_id, coalesce(bool_or(b.value <> w.value AND abs(w.confidence - b.confidence) <= 0.05::DOUBLE), false) AS conflict_detected FROM w JOIN boosted b USING (entity_id) GROUP BY 1")
def conflict_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether another value stands within the margin of the winner."""
    return A.highest_confidence(A.corroborate(claims(spark, sf_dir))).select("entity_id", "conflict_detected")


@query(f"""WITH {_CLAIMS}, g AS (SELECT entity_id, value AS name, max(confidence) AS c, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) AS n, min(ord) AS o FROM boosted GROUP BY 1, 2),
r AS (SELECT *, round_even(CASE WHEN n > 1 THEN least(1.0::DOUBLE, c + 0.15::DOUBLE) ELSE c END, 3) AS confidence FROM g)
SELECT entity_id, name, confidence, sources, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, o) AS rank FROM r""")
def skills_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills pooled by name with their confidence."""
    return A.union_skills(A.corroborate(claims(spark, sf_dir, "skills"))).select("entity_id", "name", "confidence", F.array_join("sources", ",").alias("sources"), F.col("rank").cast("long").alias("rank"))


@query(_WINNERS + """, s AS (SELECT entity_id, 0.10::DOUBLE AS wt, confidence FROM w UNION ALL SELECT entity_id, 0.15::DOUBLE, confidence FROM w WHERE ord % 2 = 0)
SELECT entity_id, round_even(sum(wt * confidence) / sum(wt), 3) AS overall_confidence FROM s GROUP BY 1""")
def overall_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted mean of populated fields (A22, A23); half of the entities also have a name here."""
    w = A.highest_confidence(A.corroborate(claims(spark, sf_dir)))
    head = w.select("entity_id", F.lit("headline").alias("field"), F.col("winning_confidence").alias("confidence"), F.lit(True).alias("populated"))
    name = w.select("entity_id", F.lit("full_name").alias("field"), F.col("winning_confidence").alias("confidence"), (F.col("winning_ord") % 2 == 0).alias("populated"))
    return A.overall_confidence(head.unionByName(name))


@query(f"""WITH {_INTERVALS}, r AS (SELECT *, max(e) OVER (PARTITION BY entity_id ORDER BY s, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM intervals),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY s, ord) AS island FROM r),
m AS (SELECT entity_id, island, max(e) - min(s) + 1 AS m, count(*) AS n FROM i GROUP BY 1, 2)
SELECT entity_id, round_even(sum(m) / 12.0::DOUBLE, 1)::DOUBLE AS years, sum(m)::BIGINT AS total_months, sum(n) > count(*) AS concurrent_roles FROM m GROUP BY 1""")
def years_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenure without overlaps."""
    return A.years_of_experience(intervals(spark, sf_dir))


@query(f"WITH {_INTERVALS} SELECT a.entity_id, a.ord, EXISTS (SELECT 1 FROM intervals b WHERE b.entity_id = a.entity_id AND b.ord <> a.ord AND a.s <= b.e AND b.s <= a.e) AS concurrent FROM intervals a")
def concurrent_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that overlap another one of the same entity."""
    return A.concurrent(intervals(spark, sf_dir)).select("entity_id", "ord", "concurrent")


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li, s = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "supplier")
    rows = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        F.col("o_custkey").cast("string").alias("entity_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"), F.concat("s_name", F.lit(" Inc")).alias("company"), F.col("o_orderpriority").alias("title"), F.date_format("o_orderdate", "yyyy-MM").alias("start"),
        F.date_format("l_shipdate", "yyyy-MM").alias("end"), F.lit(None).cast("string").alias("summary"), F.lit(False).alias("concurrent"), F.array(F.lit("resume")).alias("sources"), F.lit(0.535).alias("confidence"),
    )


@query()
def role_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles merged by an ordered fold."""
    return merge_roles(_roles(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


@query("""SELECT c_custkey, sha256(CASE WHEN c_custkey % 3 = 0 THEN lower(trim(c_name)) || '@example.com' WHEN c_custkey % 3 = 1 THEN lower(trim(c_name)) ELSE 'entity:' || c_custkey END) AS candidate_id FROM customer""")
def candidate_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by e-mail, else name, else entity (B1)."""
    c, k = _read(spark, sf_dir, "customer"), F.col("c_custkey")
    mail = F.when(k % 3 == 0, F.concat("c_name", F.lit("@example.com")))
    return c.select("c_custkey", C.candidate_id(mail, F.when(k % 3 < 2, F.col("c_name")), k.cast("string")).alias("candidate_id"))


# -- normalizers -------------------------------------------------------------------


def _flat(rows: DataFrame, key: str, raw: str, found) -> DataFrame:
    n = rows.withColumn("_n", found(F.col(raw)))
    return n.select(key, raw, F.col("_n.value").alias("value"), F.col("_n.status").alias("status"))


_MAILS = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN chr(9) || ' ' || replace(c_name, '#', '.') || '@Example.COM' || chr(10) WHEN 1 THEN 'bad; ' || replace(c_name, '#', '.') || '@x.org' WHEN 2 THEN c_name ELSE 'a,b' END AS raw FROM customer"


@query(f"""WITH r AS ({_MAILS}), p AS (SELECT *, regexp_full_match(lower(trim(raw)), '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{{2,}}') AS ok,
 list_filter(list_transform(string_split_regex(trim(raw), '[,;]+'), lambda x: lower(trim(x))), lambda x: regexp_full_match(x, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{{2,}}'))[1] AS first FROM r)
SELECT c_custkey, raw, CASE WHEN regexp_matches(raw, '[,;]') THEN first WHEN ok THEN lower(trim(raw)) END AS value, CASE WHEN (CASE WHEN regexp_matches(raw, '[,;]') THEN first IS NOT NULL ELSE ok END) THEN 'success' ELSE 'failed' END AS status FROM p""")
def norm_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses."""
    k, name = F.col("c_custkey"), F.replace(F.col("c_name"), F.lit("#"), F.lit("."))
    raw = F.when(k % 4 == 0, F.concat(F.lit("\t "), name, F.lit("@Example.COM\n"))).when(k % 4 == 1, F.concat(F.lit("bad; "), name, F.lit("@x.org"))).when(k % 4 == 2, F.col("c_name")).otherwise("a,b")
    return _flat(_read(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")), "c_custkey", "raw", N.email_normalized)


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%b %Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%-m/%Y') WHEN 3 THEN strftime(o_orderdate, '%Y') WHEN 4 THEN 'Present' ELSE 'garbage' END AS raw, o_orderdate AS d FROM orders)
SELECT o_orderkey, raw, CASE o_orderkey % 6 WHEN 0 THEN strftime(d, '%Y-%m') WHEN 1 THEN strftime(d, '%Y-%m') WHEN 2 THEN strftime(d, '%Y-%m') WHEN 3 THEN strftime(d, '%Y-01') END AS value,
 CASE o_orderkey % 6 WHEN 3 THEN 'partial' WHEN 4 THEN 'not_applicable' WHEN 5 THEN 'failed' ELSE 'success' END AS status FROM r""")
def norm_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates to months."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    raw = F.when(k % 6 == 0, F.date_format(d, "MMM yyyy")).when(k % 6 == 1, F.date_format(d, "yyyy-MM")).when(k % 6 == 2, F.date_format(d, "M/yyyy")).when(k % 6 == 3, F.date_format(d, "yyyy")).when(k % 6 == 4, "Present").otherwise("garbage")
    return _flat(_read(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")), "o_orderkey", "raw", N.date_normalized)


@query("""SELECT n_nationkey, n_name AS raw, CASE lower(trim(n_name)) WHEN 'india' THEN 'IN' WHEN 'united states' THEN 'US' WHEN 'usa' THEN 'US' WHEN 'us' THEN 'US' WHEN 'united kingdom' THEN 'GB' WHEN 'uk' THEN 'GB' WHEN 'germany' THEN 'DE' WHEN 'canada' THEN 'CA' WHEN 'australia' THEN 'AU' WHEN 'singapore' THEN 'SG' END AS value,
 CASE WHEN lower(trim(n_name)) IN ('india','united states','usa','us','united kingdom','uk','germany','canada','australia','singapore') THEN 'success' ELSE 'failed' END AS status FROM nation""")
def norm_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries to codes."""
    return _flat(_read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("raw")), "n_nationkey", "raw", N.country_normalized)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(split_part(p_name, ' ', 2)) || ', ' || split_part(p_name, ' ', 1) ELSE upper(p_name) || '  x' END AS raw,
 array_to_string(list_transform(string_split(CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) ELSE p_name || ' x' END, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS value, 'success' AS status FROM part""")
def norm_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names: turned round, title case."""
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.upper(b), F.lit(", "), a)).otherwise(F.concat(F.upper("p_name"), F.lit("  x")))
    return _flat(_read(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")), "p_partkey", "raw", N.name_normalized)


@query("""WITH r AS (SELECT c_custkey, lpad(((c_custkey * 7919) % 10000)::VARCHAR, 4, '0') AS d FROM customer)
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '98765 ' || d || '0' WHEN 1 THEN '(415) 555-' || d WHEN 2 THEN '+44 20' || d || '999' ELSE 'call me' END AS raw,
 CASE c_custkey % 4 WHEN 0 THEN '+9198765' || d WHEN 1 THEN '+1415555' || d WHEN 2 THEN '+4420' || d || '999' END || CASE WHEN c_custkey % 4 = 0 THEN '0' ELSE '' END AS value, CASE WHEN c_custkey % 4 = 3 THEN 'failed' ELSE 'success' END AS status FROM r""")
def norm_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones to E.164."""
    k, d = F.col("c_custkey"), F.lpad(((F.col("c_custkey") * 7919) % 10000).cast("string"), 4, "0")
    raw = F.when(k % 4 == 0, F.concat(F.lit("98765 "), d, F.lit("0"))).when(k % 4 == 1, F.concat(F.lit("(415) 555-"), d)).when(k % 4 == 2, F.concat(F.lit("+44 20"), d, F.lit("999"))).otherwise("call me")
    return _flat(_read(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")), "c_custkey", "raw", N.phone_normalized)


# -- skills ------------------------------------------------------------------------


def _taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with an even length as keys, the reversed words as alias."""
    names = _read(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("key")).agg(F.min("p_partkey").cast("int").alias("tax_ord")).where(F.length("key") % 2 == 0)
    keys = names.select("tax_ord", "key", F.initcap("key").alias("canonical"))
    alias = F.concat(F.split_part("key", F.lit(" "), F.lit(2)), F.lit(" "), F.split_part("key", F.lit(" "), F.lit(1)))
    return keys.select("tax_ord", F.col("key").alias("term"), F.lit(False).alias("is_alias"), "key", "canonical").unionByName(keys.select("tax_ord", alias.alias("term"), F.lit(True).alias("is_alias"), "key", "canonical"))


@query("""WITH k AS (SELECT DISTINCT lower(p_name) AS key FROM part WHERE length(p_name) % 2 = 0)
SELECT p.p_partkey, CASE WHEN k.key IS NOT NULL THEN 'exact' ELSE 'other' END AS match FROM part p LEFT JOIN k ON lower(trim(p.p_name)) = k.key""")
def skill_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens found by a taxonomy key (X12, first half)."""
    rows = X.exact_match(_read(spark, sf_dir, "part").select("p_partkey", F.lower(N.strip("p_name")).alias("t")), _taxonomy(spark, sf_dir).where("not is_alias"), "t")
    return rows.select("p_partkey", F.when(F.col("_canonical").isNotNull(), "exact").otherwise("other").alias("match"))


@query("""WITH k AS (SELECT lower(p_name) AS key, min(p_partkey) AS o FROM part WHERE length(p_name) % 2 = 0 GROUP BY 1),
t AS (SELECT key AS term, 0 AS a, key, o FROM k UNION ALL SELECT split_part(key, ' ', 2) || ' ' || split_part(key, ' ', 1), 1, key, o FROM k), b AS (SELECT term, arg_min(key, o * 2 + a) AS key, arg_min(a, o * 2 + a) AS a FROM t GROUP BY 1)
SELECT p_partkey, CASE a WHEN 0 THEN 'exact' WHEN 1 THEN 'alias' ELSE 'unverified' END AS match_type, coalesce(key, lower(p_name)) AS canonical FROM part LEFT JOIN b ON lower(trim(p_name)) = term""")
def skill_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and alias matches of all part names; the earliest entry wins."""
    rows = X.match_tokens(_read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("token")), _taxonomy(spark, sf_dir), fuzzy=False)
    return rows.select("p_partkey", "match_type", F.lower("canonical_name").alias("canonical"))


@query()
def skill_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, alias and fuzzy matches of all part names."""
    rows = X.match_tokens(_read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("token")), _taxonomy(spark, sf_dir))
    return rows.withColumn("confidence", T.skill_confidence(0.535, F.col("match_type")))


@query()
def fuzzy_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first key that is like a token."""
    return X.fuzzy_match(_read(spark, sf_dir, "part").select(F.lower("p_name").alias("token")), _taxonomy(spark, sf_dir))


# -- text --------------------------------------------------------------------------


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", "text")


@query()
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts."""
    return _docs(spark, sf_dir).select("doc_id", T.clean_text(F.col("text"), compose=True).alias("text"))


@query()
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents."""
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.sections(F.col("text"))).alias("s")).select("doc_id", "s.name", F.length("s.body").alias("n_chars"))


@query("""WITH b AS (SELECT doc_id, array_to_string(string_split(text, chr(10))[1:15], chr(10)) AS t FROM documents)
SELECT doc_id, unnest(regexp_extract_all(t, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}')) AS email FROM b""")
def contact_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses in the first 15 lines."""
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.emails(T.contact_block(F.col("text")))).alias("email"))


@query()
def contact_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One phone for each line of the first 15."""
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.phones(T.contact_block(F.col("text")))).alias("n", "phone"))


@query("""SELECT page_id, url, unnest(regexp_extract_all(url, '(?i)https?://[\\w\\-\\.]+\\.[a-z]{2,}')) AS portfolio FROM pages WHERE NOT regexp_matches(url, '(?i)://(linkedin|github)')""")
def contact_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that are neither of the two profile sites."""
    return _read(spark, sf_dir, "pages").select("page_id", "url", F.explode(T.portfolio(F.col("url"))).alias("portfolio"))


@query("""SELECT c_custkey, 'LinkedIn.com/in/' || replace(c_name, '#', '-') AS linkedin, 'github.com/u' || c_custkey AS github FROM customer""")
def contact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile links in a line of text."""
    name = F.replace(F.col("c_name"), F.lit("#"), F.lit("-"))
    line = F.concat(F.lit("see LinkedIn.com/in/"), name, F.lit(" and https://github.com/u"), F.col("c_custkey").cast("string"), F.lit("/x"))
    return _read(spark, sf_dir, "customer").select("c_custkey", F.get(T.linkedin(line), F.lit(0)).alias("linkedin"), F.get(T.github(line), F.lit(0)).alias("github"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Ana Maria Lopez' END AS name FROM customer""")
def contact_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that looks like a name."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("Resume Page\nuser 12\n"), F.when(k % 3 == 0, "Ana Maria Lopez\nTom Other").when(k % 3 == 1, "ana lopez").otherwise("Ana.Lopez@example.com X"))
    return _read(spark, sf_dir, "customer").select("c_custkey", T.name(text).alias("name"))


@query(f"""WITH c AS (SELECT c_custkey, {CITIES!r}[1 + c_custkey % 11] AS city FROM customer) SELECT c_custkey, city, CASE WHEN c_custkey % 2 = 0 THEN 'Some State' END AS region, 'IN' AS country FROM c""")
def contact_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City, region and country."""
    k = F.col("c_custkey")
    city = F.element_at(F.array(*map(F.lit, CITIES)), (1 + k % 11).cast("int"))
    line = F.concat(F.lit("lives in "), F.upper(city), F.when(k % 2 == 0, ", Some State, India").otherwise(", India"))
    return _read(spark, sf_dir, "customer").select("c_custkey", T.location(line).alias("l")).select("c_custkey", "l.city", "l.region", "l.country")


@query("""WITH t AS (SELECT doc_id, string_split_regex(replace(text, chr(10), ' '), '[,;|•\t*]+') AS p FROM documents), u AS (SELECT doc_id, unnest(p) AS r FROM t), s AS (SELECT doc_id, trim(r, ' ') AS token FROM u)
SELECT doc_id, token, count(*) AS n FROM s WHERE length(token) BETWEEN 2 AND 50 AND NOT regexp_full_match(token, '[0-9]+') GROUP BY 1, 2""")
def skill_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of whole documents (X11)."""
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.document_skills(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT doc_id, unnest(string_split_regex(text, '[,;|•\n\\-*]+')) AS r FROM documents), s AS (SELECT doc_id, trim(r, ' ') AS token FROM u)
SELECT doc_id, token, count(*) AS n FROM s WHERE length(token) BETWEEN 2 AND 50 AND NOT regexp_full_match(token, '[0-9]+') GROUP BY 1, 2""")
def prose_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of running text."""
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.prose_skills(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, 'Python' || c_custkey AS first, 'Spark' AS second, 'SQL' AS third FROM customer""")
def section_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a skills section with labels."""
    text = F.concat(F.lit("Languages: Python"), F.col("c_custkey").cast("string"), F.lit(", 42\nTools: Spark;\nSQL"))
    t = T.section_skills(F.replace(text, F.lit("Spark;\nSQL"), F.lit("Spark; SQL")))
    return _read(spark, sf_dir, "customer").select("c_custkey", F.get(t, F.lit(0)).alias("first"), F.get(t, F.lit(1)).alias("second"), F.get(t, F.lit(2)).alias("third"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN strftime(o_orderdate, '%Y-%m') END AS "start",
 CASE o_orderkey % 5 WHEN 0 THEN '2031-09' WHEN 2 THEN '2032' END AS "end", CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE o_orderkey % 5 = 1 END AS is_present, CASE WHEN o_orderkey % 5 < 4 THEN 'Acme Ltd' END AS company FROM orders""")
def date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date ranges and what stands before them."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    month = F.date_format(d, "MMM yyyy")
    line = F.concat(F.lit("Acme Ltd, "), F.when(k % 5 == 0, F.concat(month, F.lit(" – September 2031"))).when(k % 5 == 1, F.concat(month, F.lit(" - Present"))).when(k % 5 == 2, F.concat(F.date_format(d, "yyyy"), F.lit("-2032"))).when(k % 5 == 3, month).otherwise("no date"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", T.date_range(line).alias("r")).select("o_orderkey", "r.start", "r.end", "r.is_present", "r.company")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt over all cores: a small file can hold many, each of which becomes a document to parse."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), key)


def _cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One synthetic document for each customer: with dates, without any, and with an interval inside another."""
    k = F.col("c_custkey").cast("string")
    head = F.concat(F.lit("Person Name\nperson"), k, F.lit("@example.com | +91 98765"), F.lpad(k, 5, "0"), F.lit("\nPune, Maharashtra, India\n\nSKILLS\nLanguages: cold ring, Rust\n\nEXPERIENCE\n"))
    dated = F.concat(F.lit("Acme "), k, F.lit(" Inc\nData Engineer\nJan 2020 - Mar 2021\n- built things\nBolt Ltd Mar 2021 - Present\nSenior Analyst\n- ran cold ring\n\nEDUCATION\nNorth State University\nB.Tech in Physics\n2019\nCity School 2015\nClass XII"))
    loose = F.lit("Software Developer\nNova Technologies\nwrote code\n\nEDUCATION\nHill College\nMBA")
    inside = F.concat(F.lit("Core "), k, F.lit(" Corp\nLead Architect\nFeb 2018 - Dec 2018\n- drew plans\nDelta LLC Jan 2015 - Jan 2017\nResearcher\n- read\n\nEDUCATION\nLake Institute\nM.Sc in Biology\n2014"))
    m = F.col("c_custkey") % 3
    return _dealt(_read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(F.concat(F.lit("cv"), k).alias("source"), F.concat(head, F.when(m == 0, dated).when(m == 1, loose).otherwise(inside)).alias("text"))


@query("""SELECT 'cv' || c_custkey AS source, unnest(['Acme ' || c_custkey || ' Inc', 'Bolt Ltd']) AS company, unnest(['Data Engineer', 'Senior Analyst']) AS title, unnest(['2020-01', '2021-03']) AS "start", unnest(['2021-03', NULL]) AS "end", unnest(['- built things', '- ran cold ring']) AS summary, true AS concurrent FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'cv' || c_custkey, 'Nova Technologies', 'Software Developer', NULL, NULL, 'wrote code', false FROM customer WHERE c_custkey % 3 = 1
UNION ALL SELECT 'cv' || c_custkey, unnest(['Core ' || c_custkey || ' Corp', 'Delta LLC']), unnest(['Lead Architect', 'Researcher']), unnest(['2018-02', '2015-01']), unnest(['2018-12', '2017-01']), unnest(['- drew plans', '- read']), false FROM customer WHERE c_custkey % 3 = 2""")
def role_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of synthetic documents (X18 to X21): dated ones, paragraphs without dates, and which overlap."""
    rows = _cv(spark, sf_dir).withColumn("sections", T.sections(F.col("text"))).withColumn("part", T.section(F.col("sections"), "EXPERIENCE"))
    return T.with_roles(rows, "part", "roles").select("source", F.explode("roles").alias("r")).select("source", "r.company", "r.title", "r.start", "r.end", "r.summary", "r.concurrent")


@query("""SELECT 'cv' || c_custkey AS source, unnest(['North State University', 'City School']) AS institution, unnest(['B.Tech in Physics', 'Class XII']) AS degree, unnest(['Physics', NULL]) AS field, unnest([2019, 2015])::INT AS end_year FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'cv' || c_custkey, 'Hill College', 'MBA', NULL, NULL FROM customer WHERE c_custkey % 3 = 1
UNION ALL SELECT 'cv' || c_custkey, 'Lake Institute', 'M.Sc in Biology', 'Biology', 2014 FROM customer WHERE c_custkey % 3 = 2""")
def education_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Education of synthetic documents (X22 to X27): with years, and a paragraph without."""
    rows = _cv(spark, sf_dir).withColumn("sections", T.sections(F.col("text"))).withColumn("part", T.section(F.col("sections"), "EDUCATION"))
    return T.with_education(rows, "part", "schools").select("source", F.explode("schools").alias("e")).select("source", "e.institution", "e.degree", "e.field", "e.end_year")


@query()
def document_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From synthetic documents to profiles, whole."""
    table = _taxonomy(spark, sf_dir)
    p = C.canonical(N.normalize_claims(document_claims(_cv(spark, sf_dir), table), table))
    return p.select("entity_id", "candidate_id", "full_name", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"), "location.city", "years_experience", F.size("skills").alias("n_skills"), F.size("experience").alias("n_roles"), F.size("education").alias("n_schools"), F.size("provenance").alias("n_provenance"), "overall_confidence")


@query("""SELECT doc_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CASE WHEN doc_id % 2 = 0 THEN 0.665::DOUBLE - 0.15::DOUBLE ELSE 0.665::DOUBLE END) * (CASE WHEN length(text) < 50 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END))) AS confidence FROM documents""")
def confidence_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowered confidences."""
    return _docs(spark, sf_dir).select("doc_id", T.adjusted(F.lit(0.665), F.col("doc_id") % 2 == 0, T.near_empty(F.col("text"))).alias("confidence"))


@query("""WITH r AS (SELECT c_custkey AS k, c_custkey % 5 AS m FROM customer)
SELECT 'f' || k || CASE m WHEN 0 THEN '.pdf' WHEN 1 THEN '.csv' WHEN 2 THEN '.png' WHEN 3 THEN '.csv' ELSE '.xyz' END AS file_name, CASE m WHEN 0 THEN 'pdf' WHEN 1 THEN 'csv' WHEN 3 THEN 'unknown' ELSE 'unknown' END AS detected_type, m < 2 AS readable,
 CASE m WHEN 2 THEN 'Raw image file. Convert to PDF first' WHEN 3 THEN 'Empty file' WHEN 4 THEN 'Unsupported file type' END AS warning FROM r""")
def source_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of files by first bytes and extension."""
    k, m = F.col("c_custkey"), F.col("c_custkey") % 5
    content = F.when(m == 0, F.lit("%PDF-1.7 x")).when(m == 1, F.lit("Name,Other\na,b")).when(m == 2, F.lit("x")).when(m == 3, F.lit("")).otherwise(F.lit("zzz")).cast("binary")
    path = F.concat(F.lit("/in/f"), k.cast("string"), F.element_at(F.array(*map(F.lit, [".pdf", ".csv", ".png", ".csv", ".xyz"])), (m + 1).cast("int")))
    files = _read(spark, sf_dir, "customer").select(path.alias("path"), content.alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    return S.detect(files).select("file_name", "detected_type", "readable", "warning")


# -- profiles, projection, validation ------------------------------------------------


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of customers without arbitration, for the projection queries."""
    c, k = _read(spark, sf_dir, "customer"), F.col("c_custkey")
    mail = F.concat(F.lit("U"), k.cast("string"), F.lit("@X.org"))
    return c.select(
        k.cast("string").alias("entity_id"), F.col("c_name").alias("full_name"), F.when(k % 3 > 0, F.array(mail)).otherwise(F.array().cast("array<string>")).alias("emails"), F.array(F.lit("+919876543210"), F.lit("bad")).alias("phones"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("headline"),
        F.struct(F.lit("Pune").alias("city"), F.lit(None).cast("string").alias("region"), F.lit("India").alias("country")).alias("location"), (k % 60).cast("double").alias("years_experience"), (k % 10 / 10).cast("double").alias("overall_confidence"),
        F.array(F.struct(F.lit("Spark").alias("name"), F.lit(0.5).alias("confidence"), F.array(F.lit("a")).alias("sources")), F.struct(F.lit("SQL").alias("name"), F.lit(0.25).alias("confidence"), F.array(F.lit("b")).alias("sources"))).alias("skills"),
        F.array(*(F.struct(F.lit(f).alias("field"), F.lit(0.5).alias("winning_confidence")) for f in ("email", "skills", "headline"))).alias("provenance"),
    )


@query("""SELECT c_custkey::VARCHAR AS entity_id, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN 'U' || c_custkey || '@X.org' END AS mail, 'Spark,SQL' AS skill_names, 'Pune' AS city, NULL::VARCHAR AS nothing FROM customer""")
def project_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members, indexes, maps over lists, unknown paths."""
    config = P.ProjectionConfig([{"path": "name", "from": "full_name"}, {"path": "mail", "from": "emails[0]"}, {"path": "skill_names", "from": "skills[].name", "type": "string[]"}, {"path": "city", "from": "location.city"}, {"path": "nothing", "from": "emails[9].x.y"}], False, False)
    return P.project(_profiles(spark, sf_dir), config).withColumn("skill_names", F.array_join("skill_names", ","))


@query("""SELECT c_custkey::VARCHAR AS entity_id, CASE WHEN c_custkey % 2 = 0 THEN '{"full_name":"' || c_name || '","headline":"' || c_mktsegment || '"}' ELSE '{"full_name":"' || c_name || '"}' END AS output FROM customer""")
def project_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null keys left out row by row."""
    return P.project_json(_profiles(spark, sf_dir), P.ProjectionConfig([{"path": "full_name", "required": True}, {"path": "headline"}], False, False, "omit"))


@query("""SELECT c_custkey::VARCHAR AS entity_id, (c_custkey % 60)::DOUBLE::VARCHAR AS years, c_custkey % 60 <> 0 AS any_years, CASE WHEN c_custkey % 3 > 0 THEN 'u' || c_custkey || '@x.org' ELSE '' END AS mails, 'IN' AS country, NULL::DOUBLE AS bad, '+919876543210,bad' AS phones FROM customer""")
def project_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalizers and types."""
    config = P.ProjectionConfig([
        {"path": "years", "from": "years_experience", "type": "string"}, {"path": "any_years", "from": "years_experience", "type": "boolean"}, {"path": "mails", "from": "emails", "type": "string[]", "normalize": "lowercase"},
        {"path": "country", "from": "location.country", "normalize": "iso3166"}, {"path": "bad", "from": "full_name", "type": "number"}, {"path": "phones", "type": "string[]", "normalize": "E164"},
    ], False, False)
    return P.project(_profiles(spark, sf_dir), config).withColumns({"mails": F.array_join("mails", ","), "phones": F.array_join("phones", ",")})


@query("""SELECT c_custkey::VARCHAR AS entity_id, '[{"name":"Spark","sources":["a"]},{"name":"SQL","sources":["b"]}]' AS skills, 'skills' AS kept FROM customer""")
def project_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without confidences; provenance of the fields referred to."""
    out = P.project(_profiles(spark, sf_dir), P.ProjectionConfig([{"path": "skills", "type": "object[]"}], False, True))
    return out.select("entity_id", F.to_json("skills").alias("skills"), F.array_join(F.transform("provenance", lambda p: p["field"]), ",").alias("kept"))


@query("""WITH e AS (SELECT c_custkey AS k, (CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 10 = 9 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END)::INT AS n_errors FROM customer)
SELECT k::VARCHAR AS entity_id, n_errors = 0 AS valid, n_errors, (CASE WHEN k % 10 < 5 THEN 1 ELSE 0 END + CASE WHEN k % 7 <> 0 AND k % 60 > 50 THEN 1 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END + 1)::INT AS n_warnings FROM e""")
def validate_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and warnings of profiles (V1 to V7): some have no id, a confidence above 1, negative years or a null skill."""
    k = F.col("entity_id").cast("long")
    p = _profiles(spark, sf_dir)
    skill = p.schema["skills"].dataType
    full = p.withColumns({
        "candidate_id": F.when(k % 4 != 0, F.sha2("entity_id", 256)), "overall_confidence": F.when(k % 10 == 9, 1.5).otherwise(F.col("overall_confidence")), "years_experience": F.when(k % 7 == 0, -1.0).otherwise(F.col("years_experience")),
        "skills": F.when(k % 11 == 0, F.array(F.lit(None).cast(skill.elementType))).otherwise(F.col("skills")),
        "experience": F.array().cast("array<struct<company:string,title:string,start:string,end:string,summary:string>>"), "education": F.array().cast("array<struct<institution:string,degree:string,field:string,end_year:int>>"),
        "links": F.from_json(F.lit("{}"), "linkedin string, github string, portfolio array<string>, other array<string>"),
    })
    v = validate(P.project(full, P.ProjectionConfig()))
    return v.select("entity_id", "valid", F.size("validation_errors").alias("n_errors"), F.size("validation_warnings").alias("n_warnings"))


@query(_WINNERS + """, g AS (SELECT entity_id, value AS name, max(confidence) AS c, count(DISTINCT source) AS n FROM boosted GROUP BY 1, 2),
r AS (SELECT entity_id, count(*)::INT AS n_skills, max(round_even(CASE WHEN n > 1 THEN least(1.0::DOUBLE, c + 0.15::DOUBLE) ELSE c END, 3)) AS best FROM g GROUP BY 1)
SELECT w.entity_id, sha256('entity:' || w.entity_id) AS candidate_id, w.value AS headline, r.n_skills, round_even((0.10::DOUBLE * w.confidence + 0.20::DOUBLE * r.best) / (0.10::DOUBLE + 0.20::DOUBLE), 3) AS overall_confidence, 13::INT AS n_provenance FROM w JOIN r USING (entity_id)""")
def canonical_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles from claims of events: arbitration, provenance, overall confidence."""
    rows = claims(spark, sf_dir).unionByName(claims(spark, sf_dir, "skills"))
    p = C.canonical(rows)
    return p.select("entity_id", "candidate_id", "headline", F.size("skills").alias("n_skills"), "overall_confidence", F.size("provenance").alias("n_provenance"))
