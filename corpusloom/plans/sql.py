"""DuckDB SQL for the named queries, over the same tables."""

from __future__ import annotations

from corpusloom.functions import constants as C
from corpusloom.functions.scoring import IDF_EVEN, Query, robustify
from corpusloom.plans.config import defaults
from corpusloom.plans.queries import NOW, PASSAGES, QUERIES_TYPED, QUOTE

CFG = defaults()
K1, B = CFG["bm25"]["k1"], CFG["bm25"]["b"]
ALL = [*QUERIES_TYPED, QUOTE]


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(map(_s, xs)) + "]"


SPACE = r"[\p{Z}\t-\r\x1c-\x1f\x{85}]+"
WORDCHAR = r"\p{L}\p{N}_"
_STOP = _list(list(dict.fromkeys(C.STOP)))
_CORPUS = "corpus as (select c.chunk_id, c.doc_id, c.source, c.page, c.text, m.title, m.authors, m.year, m.doi, m.start_page, m.citekey from chunk c left join docmeta m using (doc_id) where c.text is not null and c.text <> '')"
_TEXTS = "corpus as (select * from chunk where text is not null and text <> '')"


def _tokens(col: str = "text") -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({col}, ''), '{C.TOKEN}'), lambda w: lower(w)), lambda w: not list_contains({_STOP}, w))"


def _strip(col: str) -> str:
    return f"regexp_replace({col}, '^{SPACE}|{SPACE}$', '', 'g')"


def _collapse(col: str) -> str:
    return f"trim(regexp_replace(coalesce({col}, ''), '{SPACE}', ' ', 'g'))"


_INDEX = f"""
toks as (select chunk_id, {_tokens()} as t from corpus),
post as (select chunk_id, term, count(*) as tf from (select chunk_id, unnest(t) as term from toks) group by all),
stats as (select count(*) as n, avg(cast(len(t) as double)) as avgdl from toks),
terms as (select term, count(*) as df, ln((select n from stats) - count(*) + 0.5) - ln(count(*) + 0.5) as idf from post group by term),
dls as (select chunk_id, cast(len(t) as double) as dl from toks)
"""


def _queries(qs: list[Query]) -> str:
    rows = [f"({_s(q.query_id)}, {_s(t)}, {q.tokens.count(t)})" for q in qs for t in dict.fromkeys(q.tokens)]
    return f"qt(query_id, term, qtf) as (values {', '.join(rows)}), qs(query_id) as (values {', '.join(f'({_s(q.query_id)})' for q in qs)})"


_BM25 = f"""
scored as (select q.query_id, p.chunk_id, sum(q.qtf * (case when t.idf < 0 then 0.25 * (select avg(idf) from terms) else t.idf end) * p.tf * {K1 + 1} / (p.tf + {K1} * (1 - {B} + {B} * d.dl / (select avgdl from stats)))) as bm25
  from qt q join terms t using (term) join post p using (term) join dls d on d.chunk_id = p.chunk_id group by q.query_id, p.chunk_id),
dense as (select qs.query_id, c.chunk_id, coalesce(s.bm25, 0) as bm25 from qs cross join corpus c left join scored s on s.query_id = qs.query_id and s.chunk_id = c.chunk_id)
"""


def _words(col: str) -> str:
    return f"(case when {_collapse(f'lower({col})')} = '' then [] else string_split({_collapse(f'lower({col})')}, ' ') end)"


def _gap(hits: str) -> str:
    """hits: a list of structs (w, i)."""
    return f"list_min(list_transform(range(2, len({hits}) + 1), lambda k: case when {hits}[k].w <> {hits}[k - 1].w then {hits}[k].i - {hits}[k - 1].i end))"


def _hits(words: str, wanted: list[str]) -> str:
    return f"list_filter(list_transform(range(1, len({words}) + 1), lambda k: {{'w': {words}[k], 'i': k}}), lambda h: list_contains({_list(wanted)}, h.w))"


def _proximity(qs: list[Query], window: int, name: str = "prox") -> str:
    """(query_id, chunk_id, value)"""
    per = []
    for q in qs:
        if len(q.tokens) < 2:
            per.append(f"select {_s(q.query_id)} as query_id, chunk_id, cast(0 as double) as v from corpus")
        else:
            per.append(f"select {_s(q.query_id)} as query_id, chunk_id, case when g is null or g > {window} then 0 else 1 - g / {float(window)} end as v from (select chunk_id, {_gap('h')} as g from (select chunk_id, {_hits('ws', q.tokens)} as h from wordlists))")
    return f"{name} as ({' union all '.join(per)})"


_WORDLISTS = f"wordlists as (select chunk_id, {_words('text')} as ws from corpus)"


def _ngram(q: Query) -> str:
    t = _collapse("lower(text)")
    return f"least({' + '.join([f'cast(contains({t}, {_s(g)}) as int)' for g in q.grams]) or '0'}, 6) / 6.0"


_PATTERN = "(" + " + ".join(f"cast(contains(lower(coalesce(text, '')), {_s(p)}) as int)" for p in C.ANSWER_PATTERNS) + ") * cast(0.05 as double)"
_T = "trim(lower(coalesce(text, '')))"
_META = f"""((case when contains(substr({_T}, 1, 50), 'abstract') then cast(0.15 as double) else 0 end) + (case when {' or '.join(f"contains(substr({_T}, 1, 60), '{x}')" for x in C.SECTIONS)} then cast(0.1 as double) else 0 end)
 + coalesce(case when title is null or title = '' then 0 when contains({_T}, trim(lower(title))) then case when length({_T}) < length(trim(lower(title))) + 20 then cast(0.2 as double) else cast(0.05 as double) end else 0 end, 0))"""


def _sum_len(xs: str) -> str:
    return f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"


def _gibberish(threshold: float) -> str:
    parts = f"regexp_split_to_array(text, '[^{WORDCHAR}]+')"
    bad = " + ".join([
        _sum_len(f"list_filter({parts}, lambda x: regexp_full_match(x, '[0-9]{{3,5}}'))"),
        _sum_len(r"regexp_extract_all(text, 'doi:[^\p{Z}\t-\r]+|10\.[0-9]{4,}/[^\p{Z}\t-\r]+')"),
        _sum_len(f"list_filter({parts}, lambda x: length(x) > 3 and (regexp_full_match(x, '[0-9]+[a-zA-Z]+[0-9]*') or regexp_full_match(x, '[a-zA-Z]+[0-9]+[a-zA-Z]*')))"),
        _sum_len(rf"regexp_extract_all(text, '[^{WORDCHAR}\p{{Z}}\t-\r]{{2,}}')"),
        _sum_len(f"list_filter({_words('text')}, lambda x: length(x) > 2 and (length(x) - length(regexp_replace(x, '[0-9]', '', 'g'))) / length(x) > 0.5)"),
    ])
    span = 0.5 - threshold
    ratio = f"(cast({bad} as double) / length(text))"
    return f"(case when length(text) < 20 then 1 when {ratio} <= {threshold} then 1 else greatest(0, 1 - least({ratio} - {threshold}, {span}) / {span}) end)"


def _fuzzy(q: Query) -> str:
    n = len(q.quote)
    if n < 20:
        return "cast(0 as double)"
    t = _collapse("lower(text)")
    longest = f"coalesce(list_max(list_transform(list_filter([{', '.join(f'[{i}, {size}]' for size in range(20, n + 1) for i in range(1, n - size + 2))}], lambda p: contains({t}, substr({_s(q.quote)}, p[1], p[2]))), lambda p: p[2])), 0)"
    return f"(case when {longest} < 20 then 0 else least(1, least(0.5, {longest} / 100.0) + 0.5) end)"


def _baseline(qs: list[Query]) -> str:
    p, n = CFG["bonuses"]["proximity"], CFG["bonuses"]["ngram"]
    gram = "case d.query_id " + " ".join(f"when {_s(q.query_id)} then {_ngram(q)}" for q in qs) + " end"
    fuzzy = "case d.query_id " + " ".join(f"when {_s(q.query_id)} then {_fuzzy(q)}" for q in qs) + " end"
    return f"""{_WORDLISTS}, {_proximity(qs, p['window'])},
own as (select chunk_id, {_PATTERN} as pat, {_META} as meta, {_gibberish(0.2)} as pen from corpus),
base as (select d.query_id, c.chunk_id, c.doc_id, c.source, c.page, c.text, c.title, c.authors, c.year, c.doi, c.start_page, c.citekey, d.bm25,
  round(((d.bm25 + {p['weight']} * x.v + {n['weight']} * ({gram}) + o.pat + o.meta) * o.pen) + 2 * ({fuzzy}), 6) as score
  from dense d join corpus c using (chunk_id) join prox x on x.query_id = d.query_id and x.chunk_id = d.chunk_id join own o on o.chunk_id = d.chunk_id),
pool as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as pool_rank from base qualify pool_rank <= 200)"""


_POOL = f"{_CORPUS}, {_INDEX}, {_queries(ALL)}, {_BM25}, {_baseline(ALL)}"


def _heuristic(qs: list[Query]) -> str:
    per = []
    for q in qs:
        d = list(dict.fromkeys(q.rerank))
        n = len(d)
        twice = [w for w in d if q.rerank.count(w) > 1]
        found = f"len(list_filter({_list(d)}, lambda w: list_contains(rt, w)))" if d else "0"
        again = f"case when list_has_any(rt, {_list(twice)}) then 1 end" if twice else "cast(null as bigint)"
        phrases = " + ".join(f"cast(contains(array_to_string(rt, ' '), {_s(f'{a} {b}')}) as int)" for a, b in zip(q.rerank, q.rerank[1:])) or "0"
        per.append(f"""select query_id, chunk_id, pool_rank, 0.6 * ({found} * {IDF_EVEN!r} / ({IDF_EVEN * n!r} + 1e-9)) + 0.3 * greatest(0, (24 - least(coalesce({again}, 1000000), coalesce(g + 1, 1000000))) / cast(24 as double)) + 0.1 * least(1, ({phrases}) * cast(0.15 as double)) as h
          from (select *, {_gap('hs')} as g from (select *, {_hits('rt', d)} as hs from rts where query_id = {_s(q.query_id)}))""")
    return f"rts as (select query_id, chunk_id, pool_rank, regexp_extract_all(lower(text), '{C.RERANK_TOKEN}') as rt from pool where pool_rank <= 150), heur as ({' union all '.join(per)}), run3 as (select query_id, chunk_id, row_number() over (partition by query_id order by h desc, pool_rank) as rank from heur)"


_CHANGED = ", ".join(_s(q.query_id) for q in ALL if robustify(q.text) != q.text.strip().lower())
_ROBUST = f"run5 as (select query_id, chunk_id, row_number() over (partition by query_id order by round(bm25, 6) desc, pool_rank) as rank from pool where query_id in ({_CHANGED}))"
_RUNS = f"{_POOL}, {_heuristic(ALL)}, {_ROBUST}, runs as (select query_id, 1 as run_id, chunk_id, pool_rank as rank from pool union all select query_id, 3, chunk_id, rank from run3 union all select query_id, 5, chunk_id, rank from run5)"
_RRF = f"""{_RUNS}, rrf as (select query_id, chunk_id, list_reduce(list_prepend(cast(0 as double), list(1.0 / (75.0 + rank) order by run_id, rank)), lambda a, x: a + x) as rrf, min(run_id * 1000000 + rank) as seen from runs where rank <= 200 group by query_id, chunk_id),
fused as (select query_id, chunk_id, rrf, row_number() over (partition by query_id order by rrf desc, seen) as fused_pos from rrf)"""
_SELECTED = f"""{_RRF}, cand as (select p.*, f.fused_pos from pool p join fused f on f.query_id = p.query_id and f.chunk_id = p.chunk_id where fused_pos <= 200),
capped as (select *, score - cast(0.3 as double) * (n - 1) as adjusted from (select *, row_number() over (partition by query_id, doc_id order by score desc, fused_pos) as n from cand) where n <= 2),
chosen as (select *, row_number() over (partition by query_id order by adjusted desc, fused_pos) as selected_rank from capped qualify selected_rank <= 8)"""

_AT = "case when coalesce(start_page, 0) <> 0 then start_page + page - 1 else page end"
_PANDOC = f"(case when citekey is not null and citekey <> '' then case when coalesce(page, 0) <> 0 then '[@' || citekey || ', p. ' || ({_AT}) || ']' else '[@' || citekey || ']' end end)"
_FIRST = "trim(string_split(authors[1], ',')[1])"
_CITED = f"('(' || (case when coalesce(len(authors), 0) < 1 then 'Unknown' when len(authors) = 1 then {_FIRST} else {_FIRST} || ' et al.' end) || ', ' || coalesce(cast(year as varchar), 'n.d.') || (case when coalesce(page, 0) <> 0 then ', p. ' || ({_AT}) else '' end) || ')')"


def _snippet(n: int) -> str:
    t = f"replace({_strip('text')}, chr(10), ' ')"
    return f"case when length({t}) > {n} then substr({t}, 1, {n - 3}) || '...' else {t} end"


_FILE_KEY = "lower(split_part(pdf_file, '/', -1))"
_LAST = "year desc nulls last, citekey desc nulls last, title desc nulls last, doi desc nulls last, pdf_file desc nulls last"
_BY_FILE = f"by_file as (select {_FILE_KEY} as key, * from biblio where pdf_file is not null and pdf_file <> '' qualify row_number() over (partition by {_FILE_KEY} order by {_LAST}) = 1)"
_BY_DOI = f"by_doi as (select lower(doi) as key, * from biblio where doi is not null and doi <> '' qualify row_number() over (partition by lower(doi) order by {_LAST}) = 1)"
_TOLD = {
    "crossref": "coalesce(crossref.title, '') || '|' || coalesce(array_to_string(crossref.authors, ';'), '') || '|' || coalesce(cast(crossref.year as varchar), '') || '|' || coalesce(cast(crossref.start_page as varchar), '')",
    "openalex": "coalesce(openalex.venue, '') || '|' || coalesce(openalex.publisher, '') || '|' || coalesce(array_to_string(openalex.concepts, ';'), '') || '|' || coalesce(openalex.oa_url, '')",
    "unpaywall": "coalesce(unpaywall.oa_url, '') || '|' || coalesce(cast(unpaywall.is_oa as varchar), '')",
}
_LATEST = "latest as (select lower(doi) as doi, " + ", ".join(f"arg_max({c}, (coalesce(epoch_us(updated_at), 0), {t})) filter (where {c} is not null) as {c}" for c, t in _TOLD.items()) + ", max(updated_at) as updated_at from doi_cache where doi is not null group by lower(doi))"
_FRESH = f"coalesce(epoch_us(timestamptz '{NOW}+00') - epoch_us(updated_at) < {200 * 86_400_000_000}, false)"
_NAMES = "array_to_string(list_filter(list_transform(coalesce(authors, []), lambda a: case when nullif(trim(a.family), '') is null then coalesce(nullif(trim(a.given), ''), '') when nullif(trim(a.given), '') is null then trim(a.family) else trim(a.family) || ', ' || trim(a.given) end), lambda x: x <> ''), '; ')"
_HALVES = """cut as (select cast(floor(min(epoch_us(scanned_at)) + (max(epoch_us(scanned_at)) - min(epoch_us(scanned_at))) / 2) as bigint) as c from manifest),
one as (select path, arg_max((size, mtime), (scanned_at, mtime, size)) as s from manifest where epoch_us(scanned_at) <= (select c from cut) and lower(path) like '%.pdf' and not starts_with(path, '__') group by path),
two as (select path, arg_max((size, mtime), (scanned_at, mtime, size)) as s from manifest where epoch_us(scanned_at) > (select c from cut) and lower(path) like '%.pdf' and not starts_with(path, '__') group by path),
diff as (select split_part(coalesce(a.path, b.path), '/', -1) as source, case when a.path is null then 'new' when b.path is null then 'removed' when a.s is distinct from b.s then 'changed' else 'unchanged' end as change from one a full join two b on a.path = b.path)"""
_SCANS = """cut as (select cast(floor(min(epoch_us(scanned_at)) + (max(epoch_us(scanned_at)) - min(epoch_us(scanned_at))) / 2) as bigint) as c from manifest),
cached as (select path, arg_max((size, mtime), (scanned_at, mtime, size)) as s from manifest where epoch_us(scanned_at) <= (select c from cut) group by path),
current as (select path, arg_max((size, mtime), (scanned_at, mtime, size)) as s from manifest where scanned_at is not null group by path),
diff as (select coalesce(a.path, b.path) as path, case when a.path is null then 'new' when b.path is null then 'removed' when a.s is distinct from b.s then 'changed' else 'unchanged' end as change
  from (select * from cached where lower(path) like '%.pdf' and not starts_with(path, '__')) a full join (select * from current where lower(path) like '%.pdf' and not starts_with(path, '__')) b on a.path = b.path)"""
_NOT_WORD = f"'[^{WORDCHAR}]+'"

ORACLE: dict[str, str] = {
    "tokenize_terms": f"select chunk_id, cast(len(t) as bigint) as n_terms, array_to_string(t, ' ') as terms from (select chunk_id, {_tokens()} as t from chunk)",
    "rerank_tokens": f"select chunk_id, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '{C.RERANK_TOKEN}'), ' ') as tokens from chunk",
    "term_freq": f"with {_TEXTS}, {_INDEX} select chunk_id, term, tf from post",
    "doc_freq_idf": f"with {_TEXTS}, {_INDEX} select term, df, round(idf, 6) as idf from terms",
    "bm25_topk": f"with {_TEXTS}, {_INDEX}, {_queries(ALL[:1])}, {_BM25} select row_number() over (order by round(bm25, 6) desc, chunk_id) as rank, chunk_id, round(bm25, 6) as bm25 from dense qualify rank <= 10",
    "bm25_batch_topk": f"with {_TEXTS}, {_INDEX}, {_queries(QUERIES_TYPED)}, {_BM25} select query_id, row_number() over (partition by query_id order by round(bm25, 6) desc, chunk_id) as rank, chunk_id, round(bm25, 6) as bm25 from dense qualify rank <= 10",
    "proximity_bonus": f"with {_TEXTS}, {_WORDLISTS}, {_proximity(ALL[:1], 30)} select chunk_id, round(v, 6) as bonus from prox",
    "ngram_bonus": f"select chunk_id, round({_ngram(Query('', 'percent of the roughly metres wide sites'))}, 6) as bonus from chunk where text is not null and text <> ''",
    "pattern_bonus": f"select chunk_id, round({_PATTERN}, 6) as bonus from chunk where text is not null and text <> ''",
    "metadata_bonus": f"with {_CORPUS} select chunk_id, round({_META}, 6) as bonus from corpus",
    "gibberish_penalty": f"select chunk_id, round({_gibberish(0.02)}, 6) as factor from chunk where text is not null and text <> ''",
    "fuzzy_match": f"select chunk_id, round(cast({_fuzzy(QUOTE)} as double), 6) as bonus from chunk where text is not null and text <> ''",
    "baseline_pool": f"with {_POOL} select query_id, pool_rank as rank, chunk_id, score from pool",
    "heuristic_run": f"with {_POOL}, {_heuristic(ALL)} select query_id, rank, chunk_id from run3",
    "robust_run": f"with {_POOL}, {_ROBUST} select query_id, rank, chunk_id from run5",
    "rm3_terms": f"""with {_TEXTS}, {_INDEX}, {_queries(QUERIES_TYPED[:2])}, {_BM25},
first as (select query_id, chunk_id, row_number() over (partition by query_id order by bm25 desc, chunk_id) as rank from dense qualify rank <= 6),
words as (select query_id, rank, unnest(t) as term, unnest(range(len(t))) as pos from first join toks using (chunk_id)),
counted as (select query_id, term, count(*) as tf, min(rank * 1000000 + pos) as seen from words where length(term) >= 3 group by query_id, term),
ranked as (select query_id, term, tf, row_number() over (partition by query_id order by tf desc, seen) as rank from counted qualify rank <= 10)
select r.* from ranked r left join qt on qt.query_id = r.query_id and qt.term = r.term where qt.term is null""",
    "rrf_fusion": f"with {_RRF} select query_id, chunk_id, round(rrf, 6) as rrf from fused",
    "diversity_select": f"with {_SELECTED} select query_id, selected_rank as rank, chunk_id, doc_id, round(adjusted, 6) as adjusted from chosen",
    "diversity_onepass": f"with {_POOL}, k as (select *, score - cast(0.3 as double) * (n - 1) as adjusted from (select *, row_number() over (partition by query_id, source order by pool_rank) as n from pool) where n <= 2) select query_id, row_number() over (partition by query_id order by adjusted desc, pool_rank) as rank, chunk_id, round(adjusted, 6) as adjusted from k",
    "confidence": f"""with {_RUNS}, sizes as (select query_id, count(*) as n, max(score) as best from pool group by query_id),
spreads as (select s.query_id, case when best > 0 then (best - p.score) / (best + 1e-6) else 0 end as spread from sizes s join pool p on p.query_id = s.query_id and p.pool_rank = s.n // 2 + 1),
nr as (select query_id, count(distinct run_id) as n_runs from runs group by query_id),
seen as (select query_id, chunk_id, count(distinct run_id) as c from runs where rank <= 8 group by query_id, chunk_id),
st as (select query_id, case when n_runs < 2 then 0.5 else cast(count(*) filter (where c = n_runs) as double) / count(*) end as stability from seen join nr using (query_id) group by query_id, n_runs),
both_ as (select query_id, spread, coalesce(stability, 0.5) as stability, 0.5 * least(1, 2 * spread) + 0.5 * coalesce(stability, 0.5) as s from spreads left join st using (query_id))
select query_id, case when s > 0.75 then 'high' when s > 0.4 then 'medium' else 'low' end as level, round(s, 3) as score, round(spread, 3) as spread, round(stability, 3) as stability from both_""",
    "flagship_search": f"with {_SELECTED} select query_id, row_number() over (partition by query_id order by score desc, page, source, coalesce(doi, ''), chunk_id) as rank, chunk_id, score, source as file, cast(page as bigint) as page, doi, title, coalesce({_PANDOC}, {_CITED}) as citation, {_PANDOC} as pandoc, {_snippet(900)} as text from chosen",
    "snippet": f"select chunk_id, {_snippet(120)} as snippet from chunk",
    "dedup_chunks": f"with k as (select chunk_id, regexp_replace(lower(text), {_NOT_WORD}, '', 'g') as k from chunk where text is not null) select min(chunk_id) as chunk_id from k where k <> '' group by md5(k)",
    "text_hash": "select chunk_id, sha256(text) as sha256 from chunk",
    "quality_filter": r"""with c as (select chunk_id, coalesce(text, '') as t from chunk)
select chunk_id from c where length(regexp_replace(t, '^[\p{Z}\t-\r\x1c-\x1f\x{85}]+|[\p{Z}\t-\r\x1c-\x1f\x{85}]+$', '', 'g')) >= 10
and length(t) - length(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) <= 0.05 * length(t)
and length(list_aggregate(list_filter(string_split(t, ''), lambda x: not regexp_full_match(x, '[\p{Cc}\p{Cf}\p{Co}]') or regexp_full_match(x, '[\t-\r\x1c-\x1f\x{85}]')), 'string_agg', '')) >= 0.7 * length(t)
and len(list_distinct(regexp_extract_all(lower(t), '[a-z ]'))) >= 5""",
    "sentence_split": rf"""with p as (select chunk_id, string_split(regexp_replace(regexp_replace(text, '(^|[^{WORDCHAR}])({'|'.join(C.ABBREVIATIONS)})\.', '\1\2~DOT~', 'g'), '([.!?]+){SPACE}', '\1' || chr(1), 'g'), chr(1)) as s from chunk where text is not null and text <> ''),
f as (select chunk_id, list_filter(list_transform(s, lambda x: {_strip("replace(x, '~DOT~', '.')")}), lambda x: length(x) > 10) as s from p)
select chunk_id, unnest(range(len(s))) as pos, unnest(s) as sentence from f""",
    "doi_extract": rf"select chunk_id, nullif(regexp_replace(regexp_extract(text, '{C.DOI}'), '[\]).,;]+$', ''), '') as doi from chunk where text is not null and text <> ''",
    "citation_strings": f"with {_CORPUS} select chunk_id, {_CITED} as citation, {_PANDOC} as pandoc from corpus",
    "citekeys": """with f as (select source, min(doc_id) as o from docmeta group by source),
k as (select source, o, lower(substr(regexp_split_to_array(regexp_replace(source, '([^.])\\.[^.]*$', '\\1'), '[ ,_]')[1], 1, 15)) as base from f),
n as (select *, row_number() over (partition by base order by o) as n from k)
select source, base || case when n = 1 then '' when n <= 27 then '-' || chr(cast(n + 95 as integer)) else '-z' || (n - 27) end as citekey from n""".replace("\\\\", "\\"),
    "biblio_by_file": f"with {_BY_FILE} select key, citekey, title, cast(year as varchar) as year, doi from by_file",
    "biblio_by_doi": f"with {_BY_DOI} select key, citekey, title, cast(year as varchar) as year, pdf_file from by_doi",
    "biblio_enrich": f"with {_BY_FILE}, {_BY_DOI} select m.doc_id, case when f.key is not null then 'file' when d.key is not null then 'doi' else 'none' end as matched, case when f.key is not null then f.citekey else d.citekey end as biblio_citekey, cast(case when f.key is not null then f.year else d.year end as varchar) as biblio_year, case when f.key is not null then f.doi when d.key is not null then m.doi end as biblio_doi from docmeta m left join by_file f on lower(split_part(m.source, '/', -1)) = f.key left join by_doi d on lower(m.doi) = d.key",
    "biblio_fill": f"with {_BY_FILE} select m.doc_id, coalesce(nullif(m.title, ''), f.title) as title, cast(coalesce(m.year, f.year) as varchar) as year, coalesce(nullif(m.doi, ''), f.doi) as doi, coalesce(nullif(m.citekey, ''), f.citekey) as citekey from docmeta m left join by_file f on lower(split_part(m.source, '/', -1)) = f.key",
    "doi_collection": rf"""with {_CORPUS}, {_BY_FILE}, p as (select *, dense_rank() over (partition by doc_id, source order by page nulls first) as n from corpus),
d as (select doc_id, source, string_agg(text, ' ' order by page nulls first, chunk_id) as text from p where n <= 2 group by doc_id, source),
f as (select doc_id, coalesce(nullif(f.doi, ''), nullif(regexp_replace(regexp_extract(d.text, '{C.DOI}'), '[\]).,;]+$', ''), '')) as doi from d left join by_file f on lower(split_part(d.source, '/', -1)) = f.key) select * from f where doi is not null""",
    "doi_cache_upsert": f"with {_LATEST} select doi, crossref is not null as has_crossref, openalex is not null as has_openalex, unpaywall is not null as has_unpaywall, epoch_us(updated_at) as updated_us from latest",
    "doi_cache_fresh": f"with {_LATEST} select doi, coalesce(epoch_us(timestamptz '{NOW}+00') - epoch_us(updated_at) < {200 * 86_400_000_000}, false) as fresh from latest",
    "citekey_propagation": "select doc_id, coalesce(nullif(citekey, ''), first_value(nullif(citekey, '') ignore nulls) over (partition by source order by doc_id rows between unbounded preceding and unbounded following)) as citekey from docmeta",
    "drop_unknown": "select doc_id from docmeta where coalesce(len(authors), 0) > 0 and year is not null",
    "manifest_diff": f"with {_SCANS} select path, change from diff",
    "incremental_merge": f"""with {_HALVES}, stale as (select distinct source from diff where change <> 'unchanged')
select chunk_id, source, 'cached' as origin from chunk where source in (select source from diff where change <> 'new') and source not in (select source from stale) union all select chunk_id, source, 'read' as origin from chunk where source in (select source from diff where change in ('new', 'changed'))""",
    "collections": """with p as (select distinct path from manifest where lower(path) like '%.pdf'), f as (select path, regexp_replace(path, '/[^/]*$', '') as folder from p), g as (select *, regexp_extract(folder, '([^/]*)$', 1) as id from f)
select id, array_to_string(list_transform(string_split(replace(id, '_', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') as name, folder, count(*) as files from g where not starts_with(id, '.') group by id, folder""",
    "file_text_hash": "select source, sha256(cast(sum(cast('0x' || substr(sha256(cast(chunk_id as varchar) || '/' || sha256(text)), 1, 15) as bigint)) as varchar) || ':' || count(*)) as sha256 from chunk where text is not null group by source",
    "corpus_diagnostics": "select count(*) as chunks, count(*) filter (where text is null) as no_text, count(distinct source) as files, count(*) filter (where length(text) < 20) as stubs, cast(sum(length(text)) as bigint) as characters from chunk",
    "api_json_parse": "select doi, crossref.title as title, cast(crossref.year as varchar) as year, cast(crossref.start_page as varchar) as start_page from doi_cache where crossref is not null and doi is not null",
    "final_sort": f"with {_POOL} select query_id, chunk_id, row_number() over (partition by query_id order by score desc, page nulls first, source, coalesce(doi, ''), chunk_id) as rank from pool",
    "vector_topk": "with s as (select q.vec_id as query_id, e.vec_id, list_inner_product(cast(q.embedding as double[]), cast(e.embedding as double[])) as score from embeddings q, embeddings e where q.vec_id % 20 = 0) select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, round(score, 5) as score from s qualify rank <= 10",
    "tfidf_cosine": rf"""with t as (select doc_id as chunk_id, regexp_extract_all(lower(title), '[{WORDCHAR}]+') as t from docmeta where title is not null),
tf as (select chunk_id, term, cast(count(*) as double) / n as tf from (select chunk_id, unnest(t) as term, len(t) as n from t) group by chunk_id, term, n),
df as (select term, count(*) as df from tf group by term),
w as (select chunk_id, term, tf * ln((select count(*) from t) / cast(df as double)) as w from tf join df using (term)),
q as (select term, w as q from w where chunk_id = 1),
p as (select chunk_id, sum(w * coalesce(q, 0)) as dot, sqrt(sum(w * w)) as n from w left join q using (term) group by chunk_id)
select chunk_id, round(case when n * (select sqrt(sum(q * q)) from q) > 0 then dot / (n * (select sqrt(sum(q * q)) from q)) else 0 end, 6) as cosine from p""",
    "normalised_vectors": "select vec_id, round(sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[]))) / sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[]))), 4) as norm from embeddings",
    "metadata_merge": f"with {_LATEST} select doi, crossref.title as title, cast(crossref.year as varchar) as year, openalex.venue as venue, coalesce(nullif(unpaywall.oa_url, ''), openalex.oa_url) as oa_url from latest",
    "enriched_meta": f"with {_LATEST}, asked as (select distinct lower(trim(doi)) as doi from docmeta where trim(doi) <> '') select a.doi, not coalesce({_FRESH}, false) as fetched from asked a left join latest using (doi)",
    "biblio_authors": f"with {_BY_FILE} select key, {_NAMES} as authors from by_file",
    "ingest_documents": rf"""with {_BY_FILE}, {_BY_DOI}, {_LATEST},
t as (select source, string_agg(coalesce(text, ''), ' ' order by page, coalesce(text, '')) as t from chunk where page <= 2 group by source),
docs as (select s.source, nullif(regexp_replace(regexp_extract(t, '{C.DOI}'), '[\]).,;]+$', ''), '') as sniffed from (select distinct source from chunk) s left join t using (source)),
b as (select d.source, case when f.key is not null then 'file' when g.key is not null then 'doi' else 'none' end as matched, case when f.key is not null then f.title else g.title end as title, case when f.key is not null then f.authors else g.authors end as authors, case when f.key is not null then f.year else g.year end as year,
  nullif(case when f.key is not null then coalesce(nullif(f.doi, ''), d.sniffed) else d.sniffed end, '') as doi, nullif(case when f.key is not null then f.citekey else g.citekey end, '') as citekey
  from docs d left join by_file f on lower(split_part(d.source, '/', -1)) = f.key left join by_doi g on lower(d.sniffed) = g.key),
n as (select b.* exclude (authors, title, year), coalesce(nullif(b.title, ''), crossref.title) as title, case when {_NAMES} <> '' then {_NAMES} else array_to_string(crossref.authors, '; ') end as authors, cast(coalesce(b.year, crossref.year) as varchar) as year, openalex.venue as venue, coalesce(nullif(unpaywall.oa_url, ''), nullif(openalex.oa_url, '')) as oa_url from b left join latest l on lower(b.doi) = l.doi),
k as (select source, lower(substr(regexp_split_to_array(regexp_replace(source, '([^.])\.[^.]*$', '\1'), '[ ,_]')[1], 1, 15)) as base from n where citekey is null),
m as (select source, base, row_number() over (partition by base order by source) as n from k)
select source, matched, title, authors, year, doi, coalesce(citekey, base || case when m.n = 1 then '' when m.n <= 27 then '-' || chr(cast(m.n + 95 as integer)) else '-z' || (m.n - 27) end) as citekey, venue, oa_url from n left join m using (source) where authors <> '' and year is not null""",
    "semantic_run": f"""with {_POOL}, head as (select query_id, chunk_id, pool_rank, round(bm25, 6) as bm25 from pool where pool_rank <= 80),
v as (select h.*, coalesce(list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])), 0) as c, min(h.bm25) over (partition by query_id) as lo, max(h.bm25) over (partition by query_id) as hi from head h left join embeddings e on e.vec_id = h.chunk_id left join embeddings q on h.query_id = 'q' || q.vec_id)
select query_id, chunk_id, row_number() over (partition by query_id order by 0.7::double * (case when hi > lo then (bm25 - lo) / (hi - lo) else 1 end) + 0.3::double * c desc, pool_rank) as rank from v""",
    "multi_passage_run": " union all ".join(f"select * from (with {_POOL.replace('qt(query_id', 'qt0(query_id').replace('qs(query_id)', 'qs0(query_id)').replace('from qs cross', 'from qs0 cross').replace('select qs.query_id', 'select qs0.query_id').replace('= qs.query_id', '= qs0.query_id').replace('from qt q join', 'from qt0 q join')}, {_queries([g])}, other as (select q.query_id, p.chunk_id, sum(q.qtf * (case when t.idf < 0 then 0.25 * (select avg(idf) from terms) else t.idf end) * p.tf * {K1 + 1} / (p.tf + {K1} * (1 - {B} + {B} * d.dl / (select avgdl from stats)))) as b from qt q join terms t using (term) join post p using (term) join dls d on d.chunk_id = p.chunk_id group by q.query_id, p.chunk_id) select p.query_id, cast({10 + k} as bigint) as run_id, row_number() over (partition by p.query_id order by coalesce(round(b, 6), 0) desc, pool_rank) as rank, p.chunk_id from pool p join qs using (query_id) left join other o on o.query_id = p.query_id and o.chunk_id = p.chunk_id)" for k, g in enumerate(Query("q1", f"{ALL[0].text} {x}") for x in PASSAGES["q1"])),
}
