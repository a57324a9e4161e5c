"""Licence scan by canonical digests, in DataFrame functions only.

A text is brought to a canonical form - lower case, equivalent spellings made one, copyright and
all-rights-reserved lines removed, every run of other characters than letters and digits one space - and
looked up by the SHA-256 of the whole form among those of known licences. The units looked up are each
document as a whole and each of its lines, so a document that is a licence and one that carries a one-line
notice are both found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedmill.llm.common import field
from feedmill.llm.license_texts import KNOWN_LICENSES

#: Spellings that licence guidelines treat as equal.
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("centre", "center"), ("favour", "favor"), ("fulfil ", "fulfill "),
    ("https", "http"), ("licence", "license"), ("merchantibility", "merchantability"), ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"), ("organisation", "organization"), ("per cent", "percent"), ("sub license", "sublicense"), ("whilst", "while"),
]
COPYRIGHT_LINE = r"(?im)^[ \t#*/;-]*(?:(?:copyright[ \t]+)?(?:\(c\)|©)|copyright[ \t]+(?:[0-9<\[{]|by[ \t]|holder:))[^\n]*$|^[ \t#*/;-]*all rights reserved\.?[ \t]*\r?$"
#: Known digests are broadcast up to this many; more are joined by shuffle.
BROADCAST_DIGESTS = 100_000


#: If every known text holds one of these in lower case, only lines and texts that do are brought to the canonical form of a line.
GATE = ("licen", "permission", "redistribut", "software")


def canonical(text: Column) -> Column:
    """The canonical form; empty for null and for text without letters or digits."""
    form = F.lower(F.regexp_replace(F.regexp_replace(text, COPYRIGHT_LINE, " "), r"[^\p{L}\p{N}]+", " "))
    form = F.concat(F.lit(" "), F.trim(form), F.lit(" "))
    for a, b in EQUIVALENT:
        form = F.replace(form, F.lit(a), F.lit(b))
    return F.coalesce(F.trim(form), F.lit(""))


def _gate(text: Column) -> Column:
    low = F.lower(text)
    return F.contains(low, F.lit(GATE[0])) | F.contains(low, F.lit(GATE[1])) | F.contains(low, F.lit(GATE[2])) | F.contains(low, F.lit(GATE[3]))


def known_digests(licenses: DataFrame) -> DataFrame:
    """(__digest, __license) of (license, kind, body) rows: texts with equal canonical forms are one, with the smallest id; empty forms are none."""
    forms = licenses.select(F.col("license").alias("__license"), canonical(F.col("body")).alias("__form")).filter("__form <> ''")
    return forms.groupBy(F.sha2("__form", 256).alias("__digest")).agg(F.min("__license").alias("__license"), F.bool_and(_gate(F.col("__form"))).alias("__gated"))


def scan_licenses(docs: DataFrame, licenses: list[tuple[str, str, str]] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of ``docs``: id, ``license`` (id of the licence that the whole text is, else null),
    ``n_notices`` (lines that are a known licence or notice), ``notices`` (their distinct ids, sorted,
    comma-joined; empty if none) and ``canonical_sha256`` (null text: that of the empty form).

    ``licenses`` are (id, kind, text) rows, as a list or as a DataFrame (license, kind, body) of any size; by default
    ``KNOWN_LICENSES``. Repeated rows stay repeated. Null and empty texts match nothing. A text that is known as two licences
    gets the smaller id. An empty table gives an empty table; other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    if not isinstance(licenses, DataFrame):
        licenses = spark.createDataFrame(KNOWN_LICENSES if licenses is None else licenses, "license string, kind string, body string")
    known = known_digests(licenses)
    size = known.agg(F.count("*").alias("n"), F.bool_and("__gated").alias("gated")).first()
    gate = _gate if size.gated else (lambda text: F.lit(True))
    known = known.drop("__gated")
    near = F.broadcast if size.n <= BROADCAST_DIGESTS else (lambda df: df)
    base = docs.select(field(id_col).alias("__id"), F.coalesce(field(text_col), F.lit("")).alias("__text"))
    lines = base.filter(gate(F.col("__text"))).select("__id", F.xxhash64("__text").alias("__same"), F.posexplode(F.split("__text", "\n")).alias("__pos", "__line"))
    lines = lines.filter(gate(F.col("__line"))).select("__id", "__same", "__pos", F.sha2(canonical(F.col("__line")), 256).alias("__digest"))
    notices = lines.join(near(known), "__digest").groupBy("__id", "__same").agg(F.count_distinct("__pos").alias("__n"), F.array_join(F.array_sort(F.collect_set("__license")), ",").alias("__notices"))
    whole = base.select("__id", F.xxhash64("__text").alias("__same"), F.sha2(canonical(F.col("__text")), 256).alias("__digest"))
    notices = notices.select(F.col("__id").alias("__i"), F.col("__same").alias("__s"), "__n", "__notices")
    same = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__same") == F.col("__s"))
    found = whole.join(near(known), "__digest", "left").join(notices, same, "left")
    return found.select(
        F.col("__id").alias(id_col), F.col("__license").alias("license"), F.coalesce("__n", F.lit(0)).cast("bigint").alias("n_notices"),
        F.coalesce("__notices", F.lit("")).alias("notices"), F.col("__digest").alias("canonical_sha256"),
    )


def oracle_sql() -> str:
    """DuckDB SQL for ``scan_licenses(documents)``."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    form = f"' ' || trim(lower(regexp_replace(regexp_replace(t, {q(COPYRIGHT_LINE)}, ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') || ' '"
    for a, b in EQUIVALENT:
        form = f"replace({form}, {q(a)}, {q(b)})"
    values = ", ".join(f"({q(k)}, {q(body)})" for k, _, body in KNOWN_LICENSES)
    return f"""
with known as (select sha256(trim({form}, ' ')) as digest, min(license) as license from (values {values}) v(license, t) group by 1),
base as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
whole as (select rid, doc_id, sha256(trim({form}, ' ')) as canonical_sha256 from base),
lines as (select rid, unnest(string_split(t, chr(10))) as t from base),
hits as (select rid, license from (select rid, sha256(trim({form}, ' ')) as digest from lines) join known using (digest)),
notices as (select rid, count(*) as n, string_agg(distinct license, ',' order by license) as ids from hits group by rid)
select doc_id, known.license as license, coalesce(n, 0) as n_notices, coalesce(ids, '') as notices, canonical_sha256
from whole left join known on digest = canonical_sha256 left join notices using (rid)
"""
