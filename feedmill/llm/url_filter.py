"""URL filters by hashed host-suffix and path-prefix expressions.

A rule is (verdict, host, path). It fits a URL whose host is the rule's host or a subdomain of it and
whose path starts with the rule's path. Each URL is expanded into the expressions host suffix + path
prefix that any rule could equal; expressions and rules meet in an equi-join on the first four bytes of
their SHA-256, the full digests are compared afterwards, and the longest fitting rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedmill.llm.common import carried, field, others

#: Rules are broadcast up to this many; longer lists are joined by shuffle.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Host of a URL: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.

    Empty for null and for text without ``://``.
    """
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null and without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", url_col: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    Null or malformed URLs get empty host and path and the default verdict. Repeated rows stay repeated.
    Of several fitting rules the longest text (host + path) wins; of equally long ones the one with the
    longer host; a rule given twice with different verdicts blocks. Columns of ``pages`` that are named
    like one of the four results, in any case, are replaced; other names cannot clash. An empty table gives an
    empty table; no rules give the default verdict everywhere.

    Rules are broadcast up to BROADCAST_RULES; distinct URLs are matched, and the matches joined back to the rows.
    """
    spark = pages.sparkSession
    keep = others(pages.columns, ("host", "path", "rule", "verdict"))
    base = pages.select(carried(keep).alias("row"), field(url_col).alias("url"), url_host(field(url_col)).alias("host"), url_path(field(url_col)).alias("path"))
    opened = ["row.*"] if keep else []
    if not rules:
        return base.select(*opened, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    known = spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, rhost string, rpath string").select(
        "verdict", F.concat("rhost", "rpath").alias("rule"), F.length("rhost").alias("hlen"), F.sha2(F.concat("rhost", "rpath"), 256).alias("full")
    ).withColumn("short", F.substring("full", 1, 8))
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    parts = F.split("host", r"\.")
    suffixes = F.array(*[F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in labels])
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    expressions = F.array_compact(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))
    urls = base.filter(F.col("url").isNotNull()).select("url", "host", "path").distinct()
    forms = urls.select("url", F.explode(expressions).alias("e")).select("url", F.sha2("e", 256).alias("digest")).withColumn("short", F.substring("digest", 1, 8))
    found = forms.join(F.broadcast(known) if len(rules) <= BROADCAST_RULES else known, "short").filter("digest = full")
    best = found.groupBy("url").agg(F.max(F.struct(F.length("rule"), "hlen", (F.col("verdict") == "block").alias("b"), "rule", "verdict")).alias("best"))
    known_urls = base.filter(F.col("url").isNotNull()).join(best, "url", "left").select("row", "host", "path", "best")
    # rows without URL are not sent to one key of the join
    without = base.filter(F.col("url").isNull()).select("row", "host", "path", F.lit(None).cast(best.schema["best"].dataType).alias("best"))
    return known_urls.unionByName(without).select(*opened, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
