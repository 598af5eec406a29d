"""URL filters: a path-template tree of every host, judged by labelled purity.

All of it is DataFrame operations.  A path's segments are first written by shape
(runs of digits as ``{n}``, long hexadecimal runs as ``{x}``).  Then, level by
level from the host down, the branches below a node are looked at: where a node
has many branches its rare ones become the wildcard ``*`` (a variable segment),
and labelled branches whose share of good pages does not differ from that of the
node's other pages (a two-proportion test) are merged into the wildcard too.
Every page so has one template; templates whose smoothed share of good labelled
pages is low are rejected.

Explicit rules, a host and a path's beginning, come before templates; of several
that fit, the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import input_table, written

#: Levels of the tree; what stands deeper is one more segment.
DEPTH = 6
#: Branches of a node beyond which its rare ones (below this share) are variable.
BRANCHES, RARE = 8, 0.05
#: Standard deviations by which a branch must differ to stay apart.
APART = 1.96
#: Weight of the overall share in a template's purity, and the purity below which it is rejected.
SMOOTH, PURITY = 4.0, 0.5
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(pages: DataFrame) -> DataFrame:
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substr(F.col("url"), at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return pages.select(
        "page_id",
        F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER).alias("host"),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def _shapes(path: Column) -> Column:
    """The segments of a path by shape, at most DEPTH and one for the rest."""
    shaped = F.regexp_replace(F.regexp_replace(path, "(?<![0-9A-Za-z])(?=[0-9a-f]*[0-9])[0-9a-f]{12,}(?![0-9A-Za-z])", "{x}"), "[0-9]+", "{n}")
    parts = F.split(F.regexp_replace(shaped, "^/", ""), "/", -1)
    deep = F.array_join(F.slice(parts, DEPTH + 1, F.greatest(F.size(parts) - DEPTH, F.lit(0))), "/")
    return F.when(F.size(parts) > DEPTH, F.array_append(F.slice(parts, 1, DEPTH), deep)).otherwise(parts)


def templates(paths: DataFrame) -> DataFrame:
    """``host, shapes, template`` from ``host, shapes, n, labelled, good``: one row for each path shape of a host.

    One grouped pass for each level; a table of path shapes, not of pages, goes
    from level to level.
    """
    now, _ = written(paths.withColumn("template", F.lit("")), "paths")
    for level in range(DEPTH + 1):
        segment = F.get("shapes", F.lit(level))
        branch = now.where(F.size("shapes") > level).groupBy("host", "template", segment.alias("segment")).agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
        node = branch.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("good").alias("all_good"), F.count("*").alias("branches"))
        p = F.try_divide("all_good", "all_labelled")
        others = F.col("all_labelled") - F.col("labelled")
        gap = F.try_divide("good", "labelled") - F.try_divide(F.col("all_good") - F.col("good"), others)
        z = F.try_divide(F.abs(gap), F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1), "labelled") + F.try_divide(F.lit(1), others))))
        variable = (F.col("branches") > BRANCHES) & (F.col("n") < RARE * F.col("all_n"))
        alike = (F.col("labelled") > 0) & (others > 0) & (p > 0) & (p < 1) & (z < APART)
        merged = branch.join(node, ["host", "template"]).withColumn("as", F.when(variable | F.coalesce(alike, F.lit(False)), "*").otherwise(F.col("segment")))
        merged = merged.select(F.col("host").alias("h"), F.col("template").alias("t"), F.col("segment").alias("s"), "as")
        on = (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")) & (segment == F.col("s"))
        grown = now.join(merged, on, "left").withColumn("template", F.when(F.col("as").isNotNull(), F.concat("template", F.lit("/"), "as")).otherwise(F.col("template")))
        now, _ = written(grown.select("host", "shapes", "n", "labelled", "good", "template"), "paths")
    return now


def judged(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, template, purity, rule, verdict`` of every row of ``pages``.

    A page is good if its label has quality 1 and is not toxic; several labels
    of a page count once each.  Null urls and urls without ``://`` have empty
    host and path, which is a template like any other.  Repeated rows stay.
    Without any labels every template has purity 1 and is allowed.  Empty tables give empty
    results.
    """
    split = _split(pages).withColumn("shapes", _shapes(F.col("path")))
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.count("*").alias("labelled"), F.sum(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("long")).alias("good"))
    known = split.join(good, split["page_id"] == good["doc_id"], "left")
    zero = F.lit(0).cast("long")
    paths = known.groupBy("host", "shapes").agg(F.count("*").alias("n"), F.sum(F.coalesce("labelled", zero)).alias("labelled"), F.sum(F.coalesce("good", zero)).alias("good"))
    tree = templates(paths)
    share = F.lit(tree.agg(F.try_divide(F.sum("good"), F.sum("labelled"))).first()[0]).cast("double")  # one number
    purity = tree.groupBy("host", "template").agg(F.sum("good").alias("g"), F.sum("labelled").alias("l"))
    purity = purity.withColumn("purity", F.coalesce((F.col("g") + SMOOTH * share) / (F.col("l") + SMOOTH), F.lit(1.0))).select("host", "template", "purity")
    of_shape = tree.select("host", "shapes", "template").join(purity, ["host", "template"])
    rows = split.join(of_shape, ["host", "shapes"])
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("purity") < PURITY, "block").otherwise("allow")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rows.select("page_id", "host", "path", "template", "purity", rule.alias("rule"), verdict.alias("verdict"))


def op3_url_rules(spark, sf_dir: str) -> DataFrame:
    """The query: every page's rule or template, and the verdict."""
    return judged(input_table(spark, sf_dir, "pages"), input_table(spark, sf_dir, "labels"))
