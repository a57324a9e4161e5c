"""The registered queries of the corpus operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedmill.llm import decontaminate, html_content, language_id, lexical_search, license_scan, toxicity, url_filter
from feedmill.llm.ann_search import nearest
from feedmill.llm.byte_bpe import encode_digests
from feedmill.llm.common import shared_dir, table
from feedmill.llm.minhash_dedup import near_duplicates
from feedmill.llm.packing import pack_documents
from feedmill.llm.prefix_trie import conversation_trie
from feedmill.llm.token_counts import TokenCounts, piece_count, word_count

#: (verdict, host, path) of op10.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op2_token_counts(spark, sf_dir):
    """All documents inserted; a seventh deleted; a fifth counted anew by a second tokenizer; each batch committed twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", word_count(F.col("text")).alias("ws"), F.when(F.col("doc_id") % 5 == 2, piece_count(F.col("text"))).alias("alnum"))
    void = [F.lit(None).cast(t).alias(n) for n, t in (("old_source", "string"), ("old_lang", "string"), ("old_tokenizer", "string"), ("old_tokens", "bigint"))]
    first = lambda df, op: df.select(F.lit(op).alias("op"), "source", "lang", F.lit("ws-1").alias("tokenizer"), F.col("ws").alias("tokens"), *void)
    revised = docs.filter("doc_id % 5 = 2 and doc_id % 7 <> 3").select(
        F.lit("revise").alias("op"), "source", "lang", F.lit("alnum-2").alias("tokenizer"), F.col("alnum").alias("tokens"),
        F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.lit("ws-1").alias("old_tokenizer"), F.col("ws").alias("old_tokens"),
    )
    counts = TokenCounts(spark, shared_dir(spark))
    for batch, changes in (("0001-load", first(docs, "insert")), ("0002-remove", first(docs.filter("doc_id % 7 = 3"), "delete")), ("0003-recount", revised), ("0002-remove", first(docs, "delete"))):
        counts.commit(batch, changes)
    return counts.totals()


def op3_minhash_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def doc_fold(n: int):
    """crc32 of the doc_id as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    prototypes = language_id.train(docs.filter(doc_fold(3) != 1))
    found = language_id.predict(docs, prototypes, passed=["doc_id"])
    return found.select("doc_id", F.coalesce(doc_fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_html_content(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html_content.extract(pages, html_content.train(pages), passed=["page_id", "url"])


#: A text is toxic from this score on.
TOXIC_FROM = 0.3


def known_labels(labels):
    """Toxic labels, but for the fold that is held out."""
    return labels.filter(doc_fold(4) != 2).select("doc_id", F.col("toxic").alias("label"))


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, known_labels(table(spark, sf_dir, "labels")))
    found = toxicity.score(docs, machine, passed=["doc_id"])
    return found.select("doc_id", F.coalesce(doc_fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op8_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors.filter("vec_id % 20 = 0"), vectors, k=20)


def op10_url_filter(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op11_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_conversation_trie(spark, sf_dir):
    return conversation_trie(table(spark, sf_dir, "conversations"))


OP2_SQL = r"""
with d as (
  select source, lang, doc_id,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) as ws,
    len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]+|[^A-Za-z0-9 \t\n\x0B\f\r]')) as alnum
  from documents where doc_id % 7 <> 3 or doc_id is null
)
select source, lang, 'ws-1' as tokenizer, count(*) as docs, sum(ws)::bigint as tokens from d where doc_id % 5 <> 2 or doc_id is null group by 1, 2
union all
select source, lang, 'alnum-2', count(*), sum(alnum)::bigint from d where doc_id % 5 = 2 group by 1, 2
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from d),
e as (select doc_id, len(s) as n, unnest(s) as h from s),
p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c
  from e a join e b on a.h = b.h and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p where 100 * c >= 75 * (na + nb - c)),
r as (select doc_id as id, doc_id as c from s union select r.id, l.b from r join l on r.c = l.a)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept
from s join (select id as doc_id, min(c) as component_id from r group by 1) using (doc_id)
"""

OP5_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id::varchar as item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
m as (select item, w, least(10, len(w)) as k from b where len(w) > 0),
win as (select distinct item, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as s from m),
occ as (select rid, k, unnest(range(1, len(w) - k + 2)) as i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as s
  from d, (select distinct k from win) where len(w) >= k),
hit as (select rid, i, k, item from occ join win using (k, s)),
words as (select rid, count(*) as n from (select distinct rid, unnest(range(i, i + k)) as p from hit) group by 1),
items as (select rid, count(*) as n, string_agg(item, ',' order by item) as ids from (select distinct rid, item from hit) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(words.n, 0) as n_hit, coalesce(items.n, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(words.n, 0) > 0 as contaminated
from d left join words using (rid) left join items using (rid)
"""

OP10_SQL = r"""
with u as (
  select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages
), r(verdict, rhost, rpath) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f as (
  select page_id, host, path, r.verdict, rhost || rpath as rule, row_number() over (partition by page_id order by length(rhost || rpath) desc) as k
  from u left join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from f where k = 1
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, {_TERMS} as w from documents),
s as (select count(*) filter (len(w) > 0) as docs, sum(len(w))::bigint as terms from d),
b as (select item_id, {_TERMS} as w from (select item_id, min(coalesce(text, '')) as text from benchmark group by 1)),
q as (select item_id, t, count(*) as times from (select item_id, unnest(w) as t from b) group by 1, 2),
p as (select rid, doc_id, n, t, count(*) as tf from (select rid, doc_id, len(w)::bigint as n, unnest(w) as t from d) where t in (select t from q) group by all),
f as (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as weight from p, s group by t, docs),
sc as (select item_id, rid, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::bigint as score
  from q join p using (t) join f using (t), s group by 1, 2, 3)
select item_id, rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id nulls first)::int as rank from sc where score > 0) where rank <= 20
"""

#: crc32 of a number's digits, bit by bit: each digit is put in, then eight shifts follow.
_CRC32 = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(conv_id::varchar, ''), lambda d: [ascii(d)::bigint + 1000, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, b: xor((case when b > 0 then xor(a, b - 1000) else a end) >> 1, 3988292384 * ((case when b > 0 then xor(a, b - 1000) else a end) & 1))), 4294967295::bigint)"""

OP13_SQL = rf"""
with t as (select conv_id, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} as x,
    row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as k
  from conversations where conv_id is not null),
o as (select conv_id, list(x order by k) as l from t group by 1),
h as (select conv_id, l, {_CRC32} % 6 as h from o),
s as (select h.conv_id, list_concat(coalesce(b.l[1:h.h], []), h.l[h.h + 1:]) as l from h left join o b on b.conv_id = h.conv_id - h.conv_id % 100),
e as (select conv_id, len(l) as n, unnest(range(0, len(l) + 1)) as d, l from s),
p as (select conv_id, n, d, md5(l[1:d]::varchar) as name, case when d > 0 then md5(l[1:d - 1]::varchar) end as up, case when d > 0 then length(l[d].t) else 0 end as chars, l from e),
g as (select name, d, any_value(up) as up, min(conv_id) as conv_id, count(*) as n, any_value(chars) as chars, arg_min(l, conv_id) as l,
    string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d) as ends from p group by name, d),
kids as (select up as name, d - 1 as d, count(*) as n_children from g where d > 0 group by 1, 2),
anc as (select md5(l[1:a]::varchar) as name, a as d, (n - 1) * chars as saved, (kids.n_children is null)::int as leaf
  from (select *, unnest(range(0, d + 1)) as a from g) g left join kids on kids.name = g.name and kids.d = g.d),
sums as (select name, d, sum(saved) as saved, sum(leaf) as leaves from anc group by 1, 2)
select g.conv_id, g.d as depth, u.conv_id as parent_conv_id, g.n as n_convs, coalesce(n_children, 0) as n_children, leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(coalesce(g.ends, '')) as ends_sha256
from g join sums using (name, d) left join kids using (name, d) left join g u on u.name = g.up and u.d = g.d - 1
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_token_counts, op3_minhash_dedup, op4_language_id, op5_decontaminate,
        op6_html_content, op7_toxicity, op8_byte_bpe, op9_nearest_neighbours, op10_url_filter,
        op11_lexical_search, op12_best_fit_packing, op13_conversation_trie,
    )
}
ORACLES = {
    "op1_license_scan": license_scan.oracle_sql(),
    "op2_token_counts": OP2_SQL,
    "op3_minhash_dedup": OP3_SQL,
    "op5_decontaminate": OP5_SQL,
    "op10_url_filter": OP10_SQL,
    "op11_lexical_search": OP11_SQL,
    "op13_conversation_trie": OP13_SQL,
}
