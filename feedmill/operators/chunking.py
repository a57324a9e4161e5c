"""News items cut into one change per row. Items are independent: everything is done within an item's line array, nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedmill import params
from feedmill.functions import patterns as P
from feedmill.functions.text import bullet_text, image_urls, section_name, split_long, strip_markup, trim_white


def _version(title: Column, lines: Column) -> Column:
    """The cleaned title without a trailing #; else the first line that is not blank."""
    header = trim_white(F.regexp_replace(trim_white(title), "#+$", ""))
    first = F.filter(lines, lambda x: x != "")
    return F.when(header != "", header).when(F.size(first) > 0, first[0]).otherwise("Unknown Version")


def lines_of(items: DataFrame) -> DataFrame:
    """Per item its metadata and ``__lines``, (line_no, line, header): the lines that are not blank and do not repeat
    the version, each with the name of the section that it heads, if it does."""
    text = F.coalesce(F.col("contents"), F.lit(""))
    d = items.select(
        "app_id", F.coalesce("gid", F.lit("unknown")).alias("gid"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("news_type", F.lit("patch")).alias("news_type"),
        F.date_format(F.timestamp_seconds(F.coalesce("date", F.lit(0))), "yyyy-MM-dd").alias("patch_date"), image_urls(text).alias("image_urls"),
        strip_markup(F.coalesce("title", F.lit(""))).alias("__title"), F.split(strip_markup(text), "\n").alias("__text"),
    )
    version = F.col("patch_version")
    d = d.withColumn("patch_version", _version(F.col("__title"), F.col("__text")))
    numbered = F.transform("__text", lambda line, i: F.struct(i.alias("line_no"), line.alias("line")))
    told = F.filter(numbered, lambda x: (x["line"] != "") & ~x["line"].startswith(version) & ~version.startswith(x["line"]))
    marked = F.transform(told, lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), section_name(x["line"]).alias("header")))
    return d.select("app_id", "gid", "url", "news_type", "patch_date", "image_urls", "patch_version", marked.alias("__lines"))


def section_headers(items: DataFrame) -> DataFrame:
    d = lines_of(items).select("app_id", "gid", F.explode(F.filter("__lines", lambda x: x["header"].isNotNull())).alias("x"))
    return d.select("app_id", "gid", "x.line_no", F.col("x.header").alias("section"))


def _bodies(d: DataFrame) -> DataFrame:
    """``__bodies`` of each item: (section, body) of the lines that become chunks, in order.

    The line array is cut at its headers, so each line is looked at once, however many there are.
    """
    starts = F.filter(F.transform("__lines", lambda x, i: F.when(x["header"].isNotNull(), i)), lambda i: i.isNotNull())
    d = d.withColumn("__starts", F.concat(F.array(F.lit(-1)), starts))

    def run(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("__starts", k + 1), F.size("__lines"))
        section = F.when(start < 0, "General").otherwise(F.get("__lines", start)["header"])
        return F.struct(section.alias("section"), F.slice("__lines", start + 2, stop - start - 1).alias("lines"))

    def body(x: Column) -> Column:
        line, clean = x["line"], bullet_text(x["line"])
        address = line.rlike("^https?://") & ~F.contains(line, F.lit(" "))
        return F.when(address, None).when(line.rlike(P.BULLET), F.when(F.length(clean) >= params.BULLET_MIN, clean)).when(F.length(line) > params.PARAGRAPH_OVER, line)

    told = F.transform(F.transform("__starts", run), lambda r: F.transform(r["lines"], lambda x: F.struct(r["section"].alias("section"), body(x).alias("body"))))
    return d.withColumn("__bodies", F.filter(F.flatten(told), lambda x: x["body"].isNotNull())).drop("__starts", "__lines")


def chunk_news(items: DataFrame) -> DataFrame:
    """Chunks of all items: each bullet of ten characters or more and each paragraph of over forty, cut at sentences
    where it is long, with version and section in front; numbered from 0 within the item.

    Items that share an id, or have none (``unknown``), are cut and numbered each by itself; null text gives no chunk.
    """
    d = _bodies(lines_of(items))
    prefix = lambda section: F.concat("patch_version", F.lit(" | "), section, F.lit(": "))
    cut = F.transform("__bodies", lambda b: F.transform(split_long(b["body"], prefix(b["section"])), lambda p: F.struct(b["section"].alias("section"), p.alias("part"))))
    d = d.select("*", F.posexplode(F.flatten(cut)).alias("__n", "__chunk"))
    return d.select(
        F.concat("gid", F.lit("-"), "__n").alias("chunk_id"), F.concat(prefix(F.col("__chunk.section")), "__chunk.part").alias("text"), "patch_version", "patch_date", F.col("__chunk.section").alias("section"), "news_type",
        F.col("gid").alias("source_gid"), F.col("url").alias("source_url"), "app_id", "image_urls",
    )
