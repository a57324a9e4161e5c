"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from feedmill import params
from feedmill.functions import patterns as P

_WHITE = r"[\s\x1c-\x1f]"
_TRIM = rf"(?U)^{_WHITE}+|{_WHITE}+$"


def trim_white(text: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(text, _TRIM, "")


def words(text: Column) -> Column:
    """Runs of non-white characters; null gives null."""
    return F.filter(F.split(text, rf"(?U){_WHITE}+"), lambda w: w != "")


def half_even(value: Column, digits: int = 1) -> Column:
    """Rounding of the scaled double, ties to even."""
    scale = 10.0**digits
    return F.rint(value * scale) / scale


def two_places(value: Column) -> Column:
    """The double's exact value rounded to two places, as ``printf('%.2f')`` of C and Python has it; scaling first would make ties of values beside them."""
    high = value.cast("float").cast("double")
    # both products are exact: the parts have 24 and 29 bits
    a, b = high * 100.0, (value - high) * 100.0
    whole = F.floor(a).cast("double")
    over = a - whole - 0.5
    up = (over > -b) | ((over == -b) & (F.pmod(whole, F.lit(2.0)) == 1))
    return F.when(F.abs(value) < 1e9, (whole + up.cast("int")) / 100.0).otherwise(value)


def keyword(word: Column) -> Column:
    """A lower-case word without punctuation at its ends."""
    return F.btrim(word, F.lit(params.WORD_EDGE))


def bm25_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(P.BM25_TOKEN), 0)


def image_urls(text: Column) -> Column:
    """Image addresses of the three tag forms, form by form, each once; empty for null."""
    found = [F.regexp_extract_all(text, F.lit(p), 1) for p in (P.IMG_BBCODE, P.IMG_HTML, P.IMG_HYBRID_URL)]
    return F.coalesce(F.array_distinct(F.concat(*found)), F.array().cast("array<string>"))


def strip_markup(text: Column) -> Column:
    """Plain text of marked-up text: images and tags out, list items as dashes, upper-case bracket headers on lines of their own."""
    t = text
    for pattern in (P.IMG_BBCODE, P.IMG_HTML, P.IMG_HYBRID, P.CLAN_IMAGE):
        t = F.regexp_replace(t, pattern, "")
    t = F.regexp_replace(F.regexp_replace(t, P.LIST_ITEM_BBCODE, "- "), P.LIST_ITEM_HTML, "- ")
    for pattern in (P.LIST_ITEM_END, P.BBCODE_TAG, P.HTML_TAG):
        t = F.regexp_replace(t, pattern, "")
    for entity, char in P.ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, P.UPPER_HEADER, "\n$1\n")
    t = F.array_join(F.transform(F.split(t, "\n"), lambda line: trim_white(F.regexp_replace(line, r"[ \t]+", " "))), "\n")
    return trim_white(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def news_type(title: Column, contents: Column) -> Column:
    """patch, content_update or event, by the first rule that fits; a null part counts as empty."""
    title, preview = F.coalesce(title, F.lit("")), F.coalesce(F.substring(contents, 1, 1000), F.lit(""))
    has = lambda text, pattern: text.rlike(f"(?iU){pattern}")
    return (
        F.when(has(title, P.TITLE_NEWSLETTER), "content_update").when(has(title, P.TITLE_EVENT), "event").when(has(title, P.TITLE_PATCH), "patch")
        .when(has(preview, P.CONTENT_PATCH), "patch").when(has(F.concat_ws(" ", title, preview), P.CONTENT_EVENT), "event").otherwise("content_update")
    )


def section_name(line: Column) -> Column:
    """Name of the section that a trimmed line heads; null for other lines."""
    inner = F.regexp_extract(line, P.BRACKET_HEADER, 1)
    sentence = F.regexp_like(line, F.lit(r"[.!?]$")) & (F.length(line) > 30)
    return F.when((F.length(line) < 3) | line.rlike(P.BULLET), None).when(inner != "", trim_white(inner)).when(sentence, None).when(line.rlike(P.SECTION_HEADER), line)


def bullet_text(line: Column) -> Column:
    return trim_white(F.regexp_replace(F.regexp_replace(line, P.BULLET_MARK, ""), P.NUMBER_MARK, ""))


def split_long(body: Column, prefix: Column, most: int = params.CHUNK_MAX) -> Column:
    """Bodies of at most ``most`` characters with the prefix, packed from whole sentences; a longer sentence stays whole."""
    sentences = F.split(F.regexp_replace(body, r"(?U)([.!?])\s+", "$1\u001f"), "\u001f")
    room = F.lit(most) - F.length(prefix)

    def pack(acc, s):
        joined = F.concat_ws(" ", acc["last"], s)
        fits = F.length(joined) <= room
        return F.struct(F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["last"])).alias("done"), F.when(fits, joined).otherwise(s).alias("last"))

    start = F.struct(F.array().cast("array<string>").alias("done"), sentences[0].alias("last"))
    packed = F.aggregate(F.slice(sentences, F.lit(2), F.greatest(F.size(sentences), F.lit(1))), start, pack, lambda acc: F.array_append(acc["done"], acc["last"]))
    return F.when(F.length(body) <= room, F.array(body)).otherwise(packed)


def summary_text(text: Column) -> Column:
    """What stands between the first <summary> and the first </summary>; the whole text if either is missing; trimmed."""
    a, b = F.locate("<summary>", text), F.instr(text, "</summary>")
    inner = F.substring(text, a + 9, F.greatest(b - a - 9, F.lit(0)))
    return trim_white(F.when((a == 0) | (b == 0), text).otherwise(inner))
