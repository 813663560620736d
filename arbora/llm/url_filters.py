"""URL rules, with redirect equivalence: a block reaches every alias of a blocked URL.

Redirects and canonical links are edges between URLs; connected components are sets of aliases. A URL
with a rule of its own keeps that verdict (so an explicit allow stands even among blocked aliases);
one without a rule is blocked if any alias is blocked by a rule, else allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components

#: (action, host, path): a rule fits its host and all subdomains if the path starts with its own.
Rule = tuple[str, str, str]
#: Rules up to which they are compared in place; more are joined by host.
IN_PLACE = 100
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: object) -> object:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))


def with_parts(urls: DataFrame, url_col: str) -> DataFrame:
    """Adds host, path and key (host, path and query: scheme and fragment do not tell aliases apart)."""
    rest = urls.withColumn("_url", F.col(url_col).cast("string")).withColumn("_rest", F.coalesce(_rest(F.col("_url")), F.lit("")))
    return (
        rest.withColumn("host", F.translate(F.regexp_extract("_rest", r"^([^/?#]*)", 1), _UPPER, _LOWER))
        .withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))
        .withColumn("key", F.concat("host", "path", F.regexp_extract("_rest", r"^[^?#]*(\?[^#]*)", 1)))
        .drop("_url", "_rest")
    )


def with_rule(parts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds rule (its host and path) and action of the longest rule that fits host and path, else nulls."""
    if not rules:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "action": F.lit(None).cast("string")})
    if len(rules) <= IN_PLACE:
        fits = [
            F.when(((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(a).alias("action")))
            for a, h, p in rules
        ]
        best = fits[0] if len(fits) == 1 else F.greatest(*fits)
        return parts.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "action": F.col("_best.action")}).drop("_best")
    spark = parts.sparkSession
    table = spark.createDataFrame([(a, h, p) for a, h, p in rules], "a string, h string, p string")
    pairs = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = pairs.withColumn("h", F.explode(ends)).join(table, "h").where(F.col("path").startswith(F.col("p")))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length(F.concat("h", "p")).alias("n"), F.concat("h", "p").alias("rule"), F.col("a").alias("action"))).alias("best"))
    return parts.join(best, ["host", "path"], "left").withColumns({"rule": F.col("best.rule"), "action": F.col("best.action")}).drop("best")


def links_in(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): canonical links and immediate refreshes that pages name, resolved against their URL."""
    tagged = pages.select(F.col(url_col).cast("string").alias("src"), F.col(html_col).alias("html")).where(F.col("src").contains("://") & F.col("html").rlike(r"(?i)<link[^>]*canonical|http-equiv[^>]*refresh"))
    canonical = F.regexp_extract("html", r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract("html", r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1)
    found = tagged.select("src", F.explode(F.array(canonical, refresh)).alias("to")).where("to <> ''").withColumn("to", F.replace("to", F.lit("&amp;"), F.lit("&")))
    scheme, base = F.regexp_extract("src", r"^([^:]*:)//", 1), F.regexp_extract("src", r"^([^:]*://[^/?#]*)", 1)
    folder = F.regexp_extract("src", r"^([^:]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    dst = (
        F.when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, "to"))
        .when(F.col("to").startswith("/"), F.concat(base, "to"))
        .otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), "to"))
    )
    return found.select("src", dst.alias("dst")).distinct()


def judged(urls: DataFrame, edges: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of urls, given alias edges (src, dst).

    A null URL, or one without ://, has empty host and path, meets no rule and has no alias: allow.
    Null ends of edges are ignored; repeated rows each get their row; no edges leave rules alone.
    """
    named = urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("u"))
    own = with_rule(with_parts(named, "u"), rules)
    ends = edges.where("src is not null and dst is not null").select("src", "dst")
    keys = with_parts(with_parts(ends, "src").select(F.col("key").alias("a"), "dst"), "dst").select("a", F.col("key").alias("b")).where("a <> '' and b <> ''")
    groups = connected_components(keys)
    # a key is host, path and query, so it has its own rule
    aliases = with_rule(with_parts(groups.withColumn("u", F.concat(F.lit("x://"), "node")), "u").select("node", "root", "host", "path"), rules)
    blocked = aliases.where("action = 'block'").select("root").distinct()
    caught = aliases.join(blocked, "root", "left_semi").select(F.col("node").alias("key"), F.lit(True).alias("caught")).distinct()
    met = own.join(caught, "key", "left")
    verdict = F.coalesce("action", F.when(F.col("caught") & (F.col("key") != ""), "block"), F.lit("allow"))
    return met.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
