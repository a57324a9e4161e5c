"""DuckDB SQL for the registered queries, over the same adapter rules."""

from __future__ import annotations

from feedmill import params
from feedmill.functions import patterns as P
from feedmill.plans import adapters as A

_q = lambda s: "'" + s.replace("'", "''") + "'"
_re = lambda p: _q(p.replace("(?iUd)", "(?i)").replace("(?iU)", "(?i)").replace("(?iu)", "(?i)").replace("(?U)", ""))
_list = lambda xs: "(" + ", ".join(map(_q, xs)) + ")"
_NL = "chr(10)"

STOP = _list(params.STOP_WORDS)


def _with(*names: str) -> str:
    """CTEs that the named one need, in order."""
    return "with " + ",\n".join(f"{n} as ({CTES[n]})" for n in names) + "\n"


_EMBED = "list_transform(embedding, lambda x: x::double)"
_TOKENS = f"regexp_extract_all(lower(text), {_q(P.BM25_TOKEN)})"

CTES = {
    "reviews": A.REVIEWS,
    "labels": A.LABELS,
    "parsed": "select *, case when secondary_categories = '' then '' else array_to_string(from_json(secondary_categories, '[\"VARCHAR\"]'), ',') end as second, confidence < 0.7 as needs_review from labels",
    "responses": A.RESPONSES,
    "paid": "select * from reviews where paid and not gift",
    "clean": "select * from paid where length(review_text) >= 5 and len(list_filter(regexp_split_to_array(review_text, '\\s+'), lambda w: w <> '')) >= 3",
    "classified": "select r.*, p.primary_category, p.second, p.confidence, p.needs_review from reviews r join parsed p using (review_id) where not is_near_duplicate and primary_category <> 'other'",
    "words": "select app_id, primary_category as category, trim(unnest(list_filter(regexp_split_to_array(lower(review_text), '\\s+'), lambda w: w <> '')), " + _q(params.WORD_EDGE) + ") as word from classified",
    "metrics": """select app_id, primary_category as category, count(*) as total_reviews, count(*) filter (created >= 1711843200 - 30 * 86400) as recent_reviews,
        count(*) filter (created >= 1711843200 - 60 * 86400 and created < 1711843200 - 30 * 86400) as prior_reviews,
        round_even(count(*) filter (not voted_up) / count(*) * 100, 1) as negative_pct, round_even(avg(playtime_hours), 1) as avg_playtime_hours
      from classified group by all having count(*) >= 3""",
    "trend": "select *, case when prior_reviews = 0 then recent_reviews::double else round_even(recent_reviews / prior_reviews, 1) end as velocity_ratio from metrics",
    "shares": """select *, case when max(total_reviews) over w > 0 then total_reviews / max(total_reviews) over w else 0 end as v,
        case when max(velocity_ratio) over w > 0 then velocity_ratio / max(velocity_ratio) over w else 0 end as g from trend window w as (partition by app_id)""",
    "scored": "select * exclude (v, g), round_even(round((0.3::double * v + 0.3::double * g + 0.2::double * (negative_pct / 100) + 0.2::double * (negative_pct / 100 * v)) * 100, 9), 1) as priority_score from shares",
    "ranked": "select *, row_number() over (partition by app_id order by priority_score desc, category)::int as priority_rank from scored",
    "topwords": """select app_id, category, word, count(*) as n, row_number() over (partition by app_id, category order by count(*) desc, word)::int as rank from words
        where length(word) > 1 and word not in """ + STOP + " group by app_id, category, word qualify rank <= 10",
    "samples": "select app_id, primary_category as category, left(review_text, 300) as t, row_number() over (partition by app_id, primary_category order by weighted_vote_score desc, review_id) as k from classified qualify k <= 5",
    "wordlists": "select app_id, category, string_agg(word, ',' order by rank) as top_keywords, string_agg('''' || word || '''', ', ' order by rank) as quoted from topwords group by all",
    "samplelists": "select app_id, category, string_agg(t, '|' order by k) as joined, string_agg('- \"' || t || '\"', chr(10) order by k) as listed from samples group by all",
    "news": f"""select 'app' || (page_id % 3) as app_id, page_id::varchar as gid, page_id as pos, list_element([{", ".join(map(_q, A.TITLES))}], (page_id % 12 + 1)::int) || ' ' || (page_id // 24) as title, url, html as contents,
        1704067200 + page_id * 3600 as date, list_element(['steam_community_announcements', 'blog', null], (page_id % 3 + 1)::int) as feedname, case when page_id % 2 = 0 then 'Community' end as feedlabel from pages""",
    "typed": f"""select *, case when regexp_matches(title, {_q("(?i)" + P.TITLE_NEWSLETTER)}) then 'content_update' when regexp_matches(title, {_q("(?i)" + P.TITLE_EVENT)}) then 'event' when regexp_matches(title, {_q("(?i)" + P.TITLE_PATCH)}) then 'patch'
        when regexp_matches(left(contents, 1000), {_q("(?i)" + P.CONTENT_PATCH)}) then 'patch' when regexp_matches(title || ' ' || left(contents, 1000), {_q("(?i)" + P.CONTENT_EVENT)}) then 'event' else 'content_update' end as news_type from news""",
    "deduped": "select * from typed qualify row_number() over (partition by app_id, lower(trim(title)) order by date desc, pos) = 1",
    "notes": """select doc_id as item, 'app' || (doc_id % 3) as app_id, case when doc_id % 40 = 8 then 'same' when doc_id % 40 <> 7 then doc_id::varchar end as gid, 'Patch ' || doc_id as version, strftime(make_timestamp((1704067200 + doc_id * 3600) * 1000000), '%Y-%m-%d') as patch_date,
        '[img]http://i.example.com/' || (doc_id % 7) || '.png[/img]<img src="http://i.example.com/1.png">' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)),
          lambda l, i: case (i - 1) % 4 when 0 then '[b]' || l || '[/b]' when 1 then '[*] ' || l when 2 then '[ SOUND ]' || chr(10) || l else l end), chr(10)) as contents from documents""",
}


def _strip(column: str) -> str:
    t = column
    for p in (P.IMG_BBCODE, P.IMG_HTML, P.IMG_HYBRID, P.CLAN_IMAGE):
        t = f"regexp_replace({t}, {_re(p)}, '', 'g')"
    t = f"regexp_replace(regexp_replace({t}, {_re(P.LIST_ITEM_BBCODE)}, '- ', 'g'), {_re(P.LIST_ITEM_HTML)}, '- ', 'g')"
    for p in (P.LIST_ITEM_END, P.BBCODE_TAG, P.HTML_TAG):
        t = f"regexp_replace({t}, {_re(p)}, '', 'g')"
    for a, b in P.ENTITIES:
        t = f"replace({t}, {_q(a)}, {_q(b)})"
    t = f"regexp_replace({t}, {_re(P.UPPER_HEADER)}, {_NL} || '\\1' || {_NL}, 'g')"
    t = f"array_to_string(list_transform(string_split({t}, {_NL}), lambda l: regexp_replace(regexp_replace(l, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), {_NL})"
    return f"regexp_replace(regexp_replace({t}, '\\n{{3,}}', {_NL} || {_NL}, 'g'), '^\\s+|\\s+$', '', 'g')"


def _pack(body: str, room: str) -> str:
    parts = f"string_split(regexp_replace({body}, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31))"
    step = f"case when length(regexp_extract(a, '[^' || chr(30) || ']*$')) + 1 + length(x) <= {room} then a || ' ' || x else a || chr(30) || x end"
    return f"case when length({body}) <= {room} then [{body}] else string_split(list_reduce({parts}, lambda a, x: {step}), chr(30)) end"


_BULLET = _re(P.BULLET)
CTES |= {
    "plain": f"select *, {_strip('contents')} as body from notes",
    "numbered": f"select item, app_id, coalesce(gid, 'unknown') as gid, version, patch_date, unnest(range(0, len(string_split(body, {_NL})))) as line_no, unnest(string_split(body, {_NL})) as line from plain",
    "lines": f"""select *, case when length(line) < 3 or regexp_matches(line, {_BULLET}) then null when regexp_extract(line, {_re(P.BRACKET_HEADER)}, 1) <> '' then trim(regexp_extract(line, {_re(P.BRACKET_HEADER)}, 1))
        when regexp_matches(line, '[.!?]$') and length(line) > 30 then null when regexp_matches(line, {_re(P.SECTION_HEADER)}) then line end as header
      from numbered where line <> '' and not starts_with(line, version) and not starts_with(version, line)""",
    "sections": "select *, coalesce(last_value(header ignore nulls) over (partition by item order by line_no rows between unbounded preceding and current row), 'General') as section from lines",
    "cleaned": f"select *, trim(regexp_replace(regexp_replace(line, {_re(P.BULLET_MARK)}, ''), {_re(P.NUMBER_MARK)}, '')) as c from sections where header is null",
    "bodies": f"""select *, version || ' | ' || section || ': ' as prefix, case when regexp_matches(line, {_BULLET}) then case when length(c) >= 10 then c end when length(line) > 40 then line end as b
      from cleaned where not (regexp_matches(line, '^https?://') and not contains(line, ' '))""",
    "parts": f"select *, {_pack('b', '(500 - length(prefix))')} as p from bodies where b is not null",
    "segments": "select *, unnest(range(0, len(p))) as seg, unnest(p) as part from parts",
    "docs3": """select app_id, pos, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s
      from (select app_id, pos, list_filter(regexp_split_to_array(lower(review_text), '\\s+'), lambda x: x <> '') as w from reviews)""",
    "firsts": "select app_id, min(pos) as pos, any_value(s) as s from (select app_id, pos, list_sort(s) as s from docs3 where len(s) > 0) group by app_id, s",
    "shingle": "select app_id, pos, len(s) as n, unnest(s) as h from firsts",
    "common": "select a.app_id, a.pos as first, b.pos as second, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from shingle a join shingle b on a.app_id = b.app_id and a.h = b.h and a.pos < b.pos and least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) group by 1, 2, 3",
    "pairs": "select app_id, first, second, c / (na + nb - c) as similarity from common where c / (na + nb - c) >= 0.85",
    "chunks": f"select doc_id::varchar as chunk_id, 'app' || (doc_id % 3) as app_id, text, {_EMBED} as v, 'v' || (doc_id % 5) as patch_version from documents left join embeddings on doc_id = vec_id",
    "queries": "select 'q' || chunk_id as query_id, app_id, text as query_text, v, chunk_id::bigint as n from chunks where v is not null and chunk_id::bigint % 25 = 0",
    "distances": "select query_id, q.app_id, chunk_id, round(1 - list_cosine_similarity(q.v, c.v), 9) as distance from queries q join chunks c using (app_id) where c.v is not null",
    "vector": "select *, (row_number() over (partition by query_id order by distance, chunk_id) - 1)::int as rank from distances qualify rank < 8 and distance <= 0.7",
    "tokens": f"select app_id, chunk_id, {_TOKENS} as t from chunks",
    "corpus": "select app_id, count(*) as n_docs, avg(len(t)) as avgdl from tokens group by 1",
    "post": "select app_id, chunk_id, dl, term, count(*) as tf from (select app_id, chunk_id, len(t) as dl, unnest(t) as term from tokens) group by all",
    "raw": "select app_id, term, count(*) as df, ln(any_value(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) as idf from post join corpus using (app_id) group by 1, 2",
    "terms": "select app_id, term, df, case when idf < 0 then 0.25 * avg(idf) over (partition by app_id) else idf end as idf from raw",
    "asked": f"select query_id, app_id, term, count(*) as qtf from (select query_id, app_id, unnest({_TOKENS.replace('text', 'query_text')}) as term from queries) group by all",
    "bm25s": "select query_id, a.app_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) as score from asked a join post using (app_id, term) join terms using (app_id, term) join corpus using (app_id) group by 1, 2, 3",
    "bm25": "select *, (row_number() over (partition by query_id order by score desc, chunk_id) - 1)::int as rank from bm25s where score > 0 qualify rank < 8",
    "merged": "select query_id, chunk_id, v.rank as vr, b.rank as br from vector v full outer join bm25 b using (query_id, chunk_id)",
    "fused": """select *, round(coalesce(1 / (60 + vr), 0) + coalesce(1 / (60 + br), 0), 12) as rrf_score,
        (row_number() over (partition by query_id order by round(coalesce(1 / (60 + vr), 0) + coalesce(1 / (60 + br), 0), 12) desc, vr nulls last, br) - 1)::int as rank from merged qualify rank < 12""",
    "relevance": f"""select f.*, c.text, c.patch_version, q.app_id, q.n,
        case when len(list_distinct({_TOKENS.replace('text', 'query_text')})) > 0 then len(list_intersect(list_distinct({_TOKENS.replace('text', 'query_text')}), {_TOKENS.replace('text', 'c.text')})) / len(list_distinct({_TOKENS.replace('text', 'query_text')})) else 0 end as relevance_score
      from fused f join queries q using (query_id) join chunks c using (chunk_id)""",
    "placed": "select * exclude (rank), (row_number() over (partition by query_id order by relevance_score desc, rank) - 1)::int as rank from relevance",
    "hits": "select * from placed where rank < 5",
    "assessed": """select query_id, any_value(n) as n, string_agg(chunk_id, ',' order by rank) as source_ids, string_agg(chunk_id, ',' order by rank) filter (rank % 2 = 0) as rel, count(*) filter (rank % 2 = 0) as nrel,
        case when any_value(n) % 11 = 0 then 1.5 else 0.25 end as conf, case when any_value(n) % 7 = 0 then false else true end as enough from hits group by 1""",
    "gated": f"select query_id, list_element([{', '.join(map(_q, params.CATEGORIES))}], (n % 10 + 1)::int) as category from queries",
    "packages": """select g.query_id, category, a.* exclude (query_id), category <> 'other' as should, a.query_id is not null as answered, coalesce(conf, 0) between 0 and 1 as ok from gated g left join assessed a using (query_id)""",
}

_REVIEWS, _CLASSIFIED = ("reviews",), ("reviews", "labels", "parsed", "classified")
_CLUSTERS = (*_CLASSIFIED, "words", "topwords", "metrics", "trend", "shares", "scored", "ranked", "samples", "wordlists", "samplelists")
_NOTES = ("notes", "plain", "numbered", "lines", "sections", "cleaned", "bodies", "parts", "segments")
_BM25 = ("chunks", "queries", "tokens", "corpus", "post", "raw", "terms", "asked", "bm25s", "bm25")
_BOTH = (*_BM25, "distances", "vector", "merged", "fused")
_HITS = (*_BOTH, "relevance", "placed", "hits")
_PACKAGES = (*_HITS, "assessed", "gated", "packages")
_BODY_JSON = "case when starts_with(response_text, '```') then array_to_string(list_slice(string_split(response_text, chr(10)), 2, -2), chr(10)) else response_text end"
_VALIDATED = f"""
, b as (select *, {_BODY_JSON} as body from responses),
j as (select *, json_valid(body) as ok, case when json_valid(body) then body else '{{}}' end as js from b),
x as (select *, json_extract_string(js, '$.primary_category') as pc, coalesce(from_json(json_extract(js, '$.secondary_categories'), '["VARCHAR"]'), []) as sc, try_cast(json_extract_string(js, '$.confidence') as double) as cf, json_extract_string(js, '$.reasoning') as rs from j),
v as (select *, case when not ok then 'json' when pc is null or pc not in {_list(params.CATEGORIES)} then 'primary' when len(list_filter(sc, lambda c: c not in {_list(params.RETRIEVAL_CATEGORIES)})) > 0 then 'secondary'
  when cf is null or not (cf between 0 and 1) then 'confidence' when coalesce(length(rs), 0) < 10 then 'reasoning' end as error from x)
"""
_TYPED = ("news", "typed", "deduped")
_PAIRS = ("docs3", "firsts", "shingle", "common", "pairs")


def _flags(source: str, *before: str) -> str:
    """The flags of near-duplicates: the nodes of the pair graph are walked in order, each app with its list of kept ones."""
    ctes = ",\n".join(f"{n} as ({CTES[n].replace('from reviews', f'from {source}') if n == 'docs3' else CTES[n]})" for n in (*before, *_PAIRS))
    return f"""with recursive {ctes},
nodes as (select app_id, pos, row_number() over (partition by app_id order by pos) as k, early from (select app_id, pos, list(first) filter (first is not null) as early from
  (select app_id, second as pos, first from pairs union all select app_id, first, null from pairs) group by 1, 2)),
walk as (select distinct app_id, 0::bigint as k, []::bigint[] as kept from nodes
  union all select w.app_id, n.k, case when list_has_any(coalesce(n.early, []), w.kept) then w.kept else list_append(w.kept, n.pos) end from walk w join nodes n on n.app_id = w.app_id and n.k = w.k + 1),
ends as (select app_id, kept from walk qualify row_number() over (partition by app_id order by k desc) = 1),
out as (select n.app_id, n.pos from nodes n join ends e using (app_id) where not list_contains(e.kept, n.pos)
  union all select app_id, pos from docs3 where len(s) > 0 and (app_id, pos) not in (select (app_id, pos) from firsts))
select review_id, app_id, (app_id, pos) in (select (app_id, pos) from out) as is_near_duplicate from {source}"""



ORACLES = {
    "read_review_pages": _with("reviews") + "select app_id, (pos // 300)::int as page, (row_number() over (partition by app_id, pos // 300 order by pos) - 1)::int as pos, review_id, minutes from reviews",
    "news_pipeline": _with("news", "typed").replace("from pages", "from pages where page_id % 3 < 2") + "select app_id, gid, title, feedname, news_type from typed where news_type <> 'event' and gid in (select gid from (select * from typed qualify row_number() over (partition by app_id, lower(trim(title)) order by date desc, pos) = 1))",
    "insert_or_ignore_reviews": _with("reviews") + "select review_id, app_id, voted_up, votes_up, playtime_hours, is_near_duplicate, length(review_text) as n_chars from reviews where pos % 2 = 1",
    "insert_or_ignore_classifications": _with("labels", "parsed")
    + "select review_id, app_id, primary_category, case when second = '' then '[]' else '[\"' || second || '\"]' end as secondary_categories, confidence, needs_review from parsed where pos % 3 <> 0",
    "upsert_chunks": _with("chunks")
    + "select chunk_id, app_id, case when chunk_id::bigint % 3 = 0 then 1 else 0 end as version, md5(case when chunk_id::bigint % 3 = 0 then 'v2 ' || text else text end) as text_md5 from chunks union all select 'n' || chunk_id, app_id, 1, md5('v2 ' || text) from chunks where chunk_id::bigint % 3 = 0",
    "load_reviews": _with("reviews") + "select review_id, app_id, voted_up, playtime_hours from reviews where app_id = 'app1' and not is_near_duplicate",
    "count_reviews": "select count(*) as n_reviews from documents",
    "load_classifications": _with("labels", "parsed") + "select review_id, primary_category, second as secondary_categories, confidence from parsed",
    "extract_review_fields": _with("reviews", "paid") + "select review_id, app_id, steam_id, voted_up, created, playtime_hours, votes_up, votes_funny, weighted_vote_score, length(review_text) as n_chars from paid",
    "clean_reviews": _with("reviews", "paid", "clean") + "select review_id, app_id, review_text from clean",
    "retrieval_gate": _with("labels") + "select review_id, primary_category, primary_category <> 'other' as should_retrieve from labels",
    "sample_negative_reviews": _with(*_CLASSIFIED) + "select app_id, primary_category, review_id, voted_up from classified where not voted_up qualify row_number() over (partition by app_id, primary_category order by md5(review_id || '/0'), review_id) = 1",
    "unclassified_reviews": _with("reviews", "labels") + "select review_id, app_id from reviews where not is_near_duplicate and review_id not in (select review_id from labels)",
    "classified_reviews": _with(*_CLASSIFIED) + "select review_id, app_id, voted_up, created, playtime_hours, weighted_vote_score, primary_category, second as secondary_categories, confidence, needs_review from classified",
    "near_duplicate_pairs": _with("reviews", "docs3", "firsts", "shingle", "common", "pairs") + "select app_id, first, second, round(similarity, 6) as similarity from pairs",
    "near_duplicate_lsh": _with("reviews", *_PAIRS) + "select app_id, first, second, round(similarity, 6) as similarity from pairs",
    "near_duplicate_members": _with("reviews", "docs3") + "select app_id, pos, case when len(s) > 0 then min(pos) over (partition by app_id, list_sort(s)) end as representative from docs3",
    "near_duplicate_flags": _flags("reviews", "reviews"),
    "clean_pipeline": _flags("clean", "reviews", "paid", "clean"),
    "bm25_tokens": f"select item_id, array_to_string({_TOKENS}, ' ') as tokens from benchmark",
    "bm25_chunk_tokens": _with("chunks", "tokens") + "select chunk_id, coalesce(array_to_string(t, ' '), '') as tokens from tokens",
    "bm25_index_stats": _with(*_BM25[:-3]) + "select app_id, term, df, round(idf, 6) as idf from terms",
    "vector_topk": _with("chunks", "queries", "distances", "vector") + "select query_id, app_id, chunk_id, round(distance, 6) as distance, rank from vector",
    "bm25_topk": _with(*_BM25) + "select query_id, app_id, chunk_id, round(score, 6) as score, rank from bm25",
    "rrf_fusion": _with(*_BOTH) + "select query_id, chunk_id, round(rrf_score, 6) as rrf_score, concat_ws(',', case when vr is not null then 'vector' end, case when br is not null then 'bm25' end) as retrievers, rank from fused",
    "retriever_overlap": _with(*_BOTH[:-1]) + "select query_id, count(vr) as n_vector, count(br) as n_bm25, count(*) filter (vr is not null and br is not null) as n_both from merged group by 1",
    "rerank_topn": _with(*_HITS) + "select query_id, chunk_id, round(relevance_score, 6) as relevance_score, rank from hits",
    "hybrid_retrieve": _with(*_HITS) + "select query_id, app_id, chunk_id, rank, patch_version, round(rrf_score, 6) as rrf_score from hits",
    "evidence_packages": _with(*_PACKAGES)
    + """select query_id, case when not should then 'skipped' when answered and ok and nrel > 0 and enough then 'retrieved' else 'insufficient' end as retrieval_decision,
      case when not should then 'Category ''' || category || ''' needs no retrieval' when not answered then 'Retrieval or assessment failed' when not ok then 'Confidence out of range' when enough then 'Retrieved ' || nrel || ' relevant chunks with confidence 0.25' else 'Evidence insufficient after 1 retrieval attempts' end as retrieval_reasoning,
      case when should and answered and ok then conf else 0 end::double as confidence, case when should and answered and ok then coalesce(rel, '') else '' end as relevant_ids, case when should and answered and ok then source_ids else '' end as source_ids,
      case when should and answered and ok then coalesce(rel, '') else '' end as sources, not answered or ok as valid from packages""",
    "citation_audit": _with(*_PACKAGES) + "select query_id, coalesce(case when should and answered and ok then nullif(split_part(source_ids, ',', 2), '') end, '') as unsupported, coalesce(case when should and answered and ok then split_part(source_ids, ',', 2) = '' end, true) as supported from packages",
    "evidence_prompts": _with(*_HITS)
    + """, l as (select query_id, string_agg('[' || rank || '] chunk_id=' || chunk_id || ' version=' || patch_version || ' section=General relevance=' || printf('%.2f', relevance_score) || chr(10) || '    "' || text || '"', chr(10) order by rank) as t from hits group by 1)
      select query_id, md5(coalesce(t, '(no chunks retrieved — retrieval returned empty results)')) as prompt_md5 from queries left join l using (query_id)""",
    "source_prompts": _with(*_PACKAGES)
    + """, s as (select *, row_number() over (partition by query_id order by rank) - 1 as k from hits where rank % 2 = 0),
      l as (select query_id, string_agg('[' || k || '] chunk_id=' || chunk_id || ' version=' || patch_version || ' section=General' || chr(10) || '    "' || text || '"', chr(10) order by k) as t from s group by 1)
      select query_id, md5(case when should and answered and ok and t is not null then '<evidence_sources>' || chr(10) || t || chr(10) || '</evidence_sources>' else '<evidence_sources>No relevant sources retrieved.</evidence_sources>' end) as prompt_md5
      from packages left join l using (query_id)""",
    "encode_chunks": "select doc_id::varchar as chunk_id, length(text)::double as e0, (length(text) - length(replace(text, ' ', '')))::double as e1 from documents",
    "basic_stats": _with("reviews")
    + """select app_id, count(*) as total_reviews, count(*) filter (voted_up) as positive_count, count(*) filter (not voted_up) as negative_count, round_even(count(*) filter (voted_up) / count(*) * 100, 1) as positive_pct, round_even(count(*) filter (not voted_up) / count(*) * 100, 1) as negative_pct,
      round_even(avg(playtime_hours), 1) as avg_playtime_hours, round_even(median(playtime_hours), 1) as median_playtime_hours, round_even(avg(votes_up), 1) as avg_votes_up, count(*) filter (is_near_duplicate) as duplicate_count,
      strftime(make_timestamp(min(created) * 1000000), '%Y-%m-%d %H:%M:%S') as earliest_review, strftime(make_timestamp(max(created) * 1000000), '%Y-%m-%d %H:%M:%S') as latest_review from reviews group by 1""",
    "keyword_frequency": _with("reviews")
    + f"select word, count(*) as n from (select trim(unnest(list_filter(regexp_split_to_array(lower(review_text), '\\s+'), lambda w: w <> '')), {_q(params.WORD_EDGE)}) as word from reviews) where length(word) > 1 and word not in {STOP} group by 1 order by n desc, word limit 20",
    "keywords_first_seen": _with("reviews")
    + f""", w as (select pos, list_filter(regexp_split_to_array(lower(review_text), '\\s+'), lambda w: w <> '') as w from reviews),
      u as (select pos, unnest(range(len(w))) as p, trim(unnest(w), {_q(params.WORD_EDGE)}) as word from w)
      select word, count(*) as n from u where length(word) > 1 and word not in {STOP} group by 1 order by n desc, min(pos::hugeint * 1000000000 + p) limit 20""",
    "keywords_by_category": _with(*_CLASSIFIED, "words", "topwords") + "select app_id, category, word, n, rank from topwords",
    "build_clusters": _with(*_CLUSTERS)
    + "select t.app_id, t.category, total_reviews, recent_reviews, prior_reviews, velocity_ratio, negative_pct, avg_playtime_hours, coalesce(top_keywords, '') as top_keywords, md5(joined) as samples_md5 from trend t left join wordlists using (app_id, category) left join samplelists using (app_id, category)",
    "rank_clusters": _with(*_CLUSTERS) + "select * from ranked",
    "event_clusters": "with classified as (select 'all' as app_id, event_type as primary_category, epoch(ts)::double as created, user_id % 3 <> 0 as voted_up, round(value, 1) as playtime_hours from events),\n"
    + ",\n".join(f"{n} as ({CTES[n].replace('1711843200', '1706659200').replace('30 * 86400', '10 * 86400').replace('60 * 86400', '20 * 86400')})" for n in ("metrics", "trend", "shares", "scored", "ranked")) + "\nselect * from ranked",
    "cluster_prompts": _with(*_CLUSTERS)
    + """select app_id, category, md5(concat_ws(chr(10), '<cluster_data>', 'category: ' || category, 'total_reviews: ' || total_reviews, 'recent_reviews: ' || recent_reviews, 'prior_reviews: ' || prior_reviews, 'velocity_ratio: ' || printf('%.1f', velocity_ratio), 'negative_pct: ' || printf('%.1f', negative_pct),
      'avg_playtime_hours: ' || printf('%.1f', avg_playtime_hours), 'top_keywords: [' || coalesce(quoted, '') || ']', 'sample_reviews:', listed, 'priority_score: ' || printf('%.1f', priority_score), '</cluster_data>')) as prompt_md5
      from ranked left join wordlists using (app_id, category) left join samplelists using (app_id, category)""",
    "negative_review_listing": _with(*_CLASSIFIED)
    + """, l as (select app_id, primary_category, review_id, review_text, row_number() over (partition by app_id, primary_category order by review_id) as k from classified where not voted_up)
      select app_id, primary_category, count(*) as n_negative, string_agg('[' || review_id || '] ' || replace(left(review_text, 80), chr(10), ' '), ' / ' order by k) filter (k <= 3) as previews, greatest(count(*) - 3, 0) as n_more from l group by 1, 2""",
    "token_usage_rollup": f"with l as ({A.TOKEN_LOG}) select node, sum(input)::bigint as input, sum(output)::bigint as output, grouping(node)::int as is_total from l group by rollup (node)",
    "dedup_news_by_title": _with(*_TYPED) + "select app_id, gid, title, date from deduped",
    "classify_news_type": _with("news", "typed") + "select gid, news_type from typed",
    "news_type_counts": _with(*_TYPED) + "select app_id, count(*) filter (news_type = 'patch') as patch, count(*) filter (news_type = 'content_update') as content_update, count(*) filter (news_type = 'event') as event from deduped group by 1",
    "feed_distribution": _with(*_TYPED) + "select 'feedname' as kind, coalesce(feedname, '<missing>') as value, count(*) as n from deduped where news_type <> 'event' group by all union all select 'feedlabel', coalesce(feedlabel, '<missing>'), count(*) from deduped where news_type <> 'event' group by all",
    "strip_markup": _with("notes", "plain") + "select gid, md5(body) as text_md5 from plain",
    "extract_image_urls": _with("notes") + f"select gid, array_to_string(list_distinct_in_order, ',') as urls from (select gid, list_filter(u, lambda x, i: list_position(u, x) = i) as list_distinct_in_order from (select gid, regexp_extract_all(contents, {_re(P.IMG_BBCODE)}, 1) || regexp_extract_all(contents, {_re(P.IMG_HTML)}, 1) || regexp_extract_all(contents, {_re(P.IMG_HYBRID_URL)}, 1) as u from notes))",
    "section_headers": _with(*_NOTES[:4]) + "select app_id, gid, line_no::int as line_no, header as section from lines where header is not null".replace("select app_id, gid", "select gid"),
    "chunk_news": _with(*_NOTES) + "select gid || '-' || (row_number() over (partition by item order by line_no, seg) - 1) as chunk_id, section, version as patch_version, patch_date, app_id, length(prefix || part) as n_chars, md5(prefix || part) as text_md5 from segments",
    "split_long_text": f"with p as (select doc_id, {_pack('b', '(500 - 17)')} as p from (select doc_id, replace(text, chr(10), ' ') as b from documents)) select doc_id, unnest(range(0, len(p)))::int as seg, md5(unnest(p)) as body_md5 from p",
    "validate_classifications": _with("responses") + _VALIDATED
    + "select review_id, error is null as valid, error, case when error is null then pc end as primary_category, case when error is null then array_to_string(list_filter(sc, lambda c: c <> pc), ',') end as secondary_categories, case when error is null then cf end as confidence, case when error is null then rs end as reasoning, case when error is null then cf < 0.7 end as needs_review from v",
    "classification_run_summary": _with("reviews", "labels", "responses") + _VALIDATED
    + """, q as (select r.app_id, r.pos, v.error is null as valid from reviews r join v using (review_id) where not r.is_near_duplicate and r.review_id not in (select review_id from labels)),
      d as (select *, coalesce(sum(valid::int) over (partition by app_id order by pos rows between unbounded preceding and 1 preceding), 0) as done from q)
      select app_id, count(*) as total, count(*) filter (valid) as classified, count(*) filter (not valid) as failed from d where done < 40 group by 1""",
    "normalize_tones": f"select review_id, case when starts_with(response_text, '{{') and split_part(response_text, '\"', 4) in {_list(params.TONES)} then split_part(response_text, '\"', 4) else 'neutral' end as tone from ({A.TONE_RESPONSES})",
    "extract_summaries": f"select doc_id, md5(regexp_replace(case when contains(response_text, '<summary>') and contains(response_text, '</summary>') then split_part(split_part(response_text, '<summary>', 2), '</summary>', 1) else response_text end, '^\\s+|\\s+$', '', 'g')) as summary_md5 from ({A.SUMMARY_RESPONSES})",
    "stream_ingest_reviews": _with("reviews", "paid", "clean") + "select review_id, app_id, voted_up, playtime_hours, votes_up, length(review_text) as n_chars from clean",
}
#: The same results by other means.
ORACLES |= {
    "versioned_upsert_chunks": ORACLES["upsert_chunks"],
    "indexed_insert_reviews": _with("reviews") + "select review_id, app_id, voted_up, votes_up, playtime_hours, is_near_duplicate, length(review_text) as n_chars from reviews",
    "stateful_ingest_reviews": ORACLES["stream_ingest_reviews"],
    "near_duplicate_flags_banded": ORACLES["near_duplicate_flags"],
    "near_duplicate_flags_incremental": ORACLES["near_duplicate_flags"],
    "bm25_topk_postings": ORACLES["bm25_topk"],
    "rrf_fusion_early": ORACLES["rrf_fusion"],
    "rolling_clusters": f"select '2024-03-31' as as_of, * from ({ORACLES['build_clusters']}) union all select '2024-02-29' as as_of, * from ({ORACLES['build_clusters'].replace('1711843200 - 30', '1709164800 - 30').replace('1711843200 - 60', '1709164800 - 60')})",
    "sketched_periods": _with("reviews") + "select app_id, strftime(make_timestamp(created * 1000000), '%Y-%m') as month, count(*) as n_reviews, true as close from reviews group by 1, 2",
}
