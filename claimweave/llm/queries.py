"""The queries of this subpackage, and SQL for what of them SQL can express.

The last three take columns from a whole operator's result: those that a
statement in SQL can give too.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, licenses, linededup, mpegts, quality, simhash, tokenfile, toxicity, urlrules


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op3: host, path and explicit rule of every page, with the rule's verdict."""
    found = urlrules.op3_url_rules(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op10: words and places of the base phrases of every document."""
    return licenses.op10_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def media_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op8: sizes of every document's text and payload."""
    return mpegts.op8_mpegts(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes")


QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_url_rules": urlrules.op3_url_rules,
    "op4_token_file": tokenfile.op4_token_file,
    "op5_bpe": bpe.op5_bpe,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_line_dedup": linededup.op7_line_dedup,
    "op8_mpegts": mpegts.op8_mpegts,
    "op9_simhash": simhash.op9_simhash,
    "op10_licenses": licenses.op10_licenses,
    "url_parts": url_parts,
    "license_places": license_places,
    "media_sizes": media_sizes,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


_RULES = sorted(urlrules.RULES, key=lambda r: -len(r[0] + r[1]))
_PHRASES = [(phrase.split(), label) for phrase, label in licenses.BASE]
_PLACES = ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f'''w[i + {k}] = '{x}\'''' if k else f'''w[i] = '{x}\'''' for k, x in enumerate(words))}) AS p{n}" for n, (words, _) in enumerate(_PHRASES))
_ALL = "list_concat(list_concat(p0, p1), p2)"

SQL: dict[str, str] = {
    "url_parts": f"""WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h + p}'" for h, p, _ in _RULES)} END AS rule, CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for h, p, v in _RULES)} END AS rule_verdict FROM p""",
    "license_places": f"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents), f AS (SELECT doc_id, len(w) AS n, {_PLACES} FROM t)
SELECT doc_id, n::BIGINT AS n_words, len({_ALL})::BIGINT AS n_base, list_min({_ALL})::BIGINT - 1 AS first_word, list_max({_ALL})::BIGINT - 1 AS last_word,
 array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN len(p{n}) > 0 THEN '{label}' END" for n, (_, label) in enumerate(_PHRASES))}], lambda x: x IS NOT NULL)), ',') AS base_labels FROM f""",
    "media_sizes": "WITH t AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n FROM documents) SELECT doc_id, n AS n_bytes, greatest(64, (n + 63) // 64 * 64)::BIGINT AS payload_bytes FROM t",
}
