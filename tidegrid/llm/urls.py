"""URL verdicts from host-suffix and path-prefix rules, looked up by short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a digest that the first lookup compares.
PREFIX_DIGITS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_keys(rules: DataFrame) -> DataFrame:
    """rules(host, path, verdict) with their text, digest, digest prefix and shape."""
    rule = F.concat("host", "path")
    return rules.select(
        rule.alias("rule"), "verdict", F.length(rule).alias("rule_length"), F.sha2(rule, 256).alias("rule_digest"),
        F.substring(F.sha2(rule, 256), 1, PREFIX_DIGITS).alias("prefix"),
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_length"),
    )


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """Verdict for every row of pages: (key, host, path, rule, verdict).

    A rule fits its host and all subdomains if the path starts with the rule's; of those that fit the
    longest wins (equal texts: `block` before `allow`). Without one, rule is null and the verdict `otherwise`.

    Each URL is expanded into the host suffixes and path prefixes of the shapes that rules have; the
    expressions meet the rules on the first digits of their SHA-256, the full digest then decides. The
    expansions of a row lie in one task, so the one shuffle carries a row per distinct (key, host, path).
    Null or malformed URLs have empty host and path. Repeated rows stay repeated, null keys stay, other
    columns are ignored. An empty rule table gives `otherwise` everywhere.
    """
    keyed = rule_keys(rules)
    shapes = [(r[0], r[1]) for r in keyed.select("labels", "path_length").distinct().orderBy("labels", "path_length").collect()]
    rows = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    n_labels = F.size(F.split("host", r"\."))
    forms = [
        F.when(
            (n_labels >= labels) & (F.length("path") >= size) & (F.col("host") != ""),
            F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, size)),
        )
        for labels, size in shapes
    ]
    expanded = rows.select("*", F.posexplode(F.array(F.lit(None).cast("string"), *forms)).alias("at", "form"))
    digest = F.sha2("form", 256)
    # a URL's own row meets no rule; a prefix of its own deals such rows evenly
    own = F.concat(F.lit("~"), F.xxhash64("key", "host", "path").cast("string"))
    expanded = expanded.where((F.col("at") == 0) | F.col("form").isNotNull()).select(
        "key", "host", "path", "at", digest.alias("digest"), F.coalesce(F.substring(digest, 1, PREFIX_DIGITS), own).alias("prefix")
    )
    met = expanded.join(keyed.select("prefix", "rule", "verdict", "rule_length", "rule_digest"), "prefix", "left")
    sure = F.when(F.col("digest") == F.col("rule_digest"), F.struct("rule_length", "verdict", "rule"))
    # the smallest of (negated length, verdict): the longest rule, and `block` before `allow`
    best = F.min(F.when(sure.isNotNull(), F.struct((-F.col("rule_length")).alias("n"), F.col("verdict").alias("v"), F.col("rule").alias("r"))))
    judged = met.groupBy("key", "host", "path").agg(F.count_if(F.col("at") == 0).alias("copies"), best.alias("best"))
    return judged.select(
        F.col("key").alias(key), "host", "path", F.col("best.r").alias("rule"),
        F.coalesce("best.v", F.lit(otherwise)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
