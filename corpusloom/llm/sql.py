"""DuckDB SQL for the pN_ queries that SQL can express."""

_LINES = """
lines as (select chunk_id, source, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from chunk where text is not null),
forms as (select chunk_id, source, cast(line_no as integer) as line_no, line, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), '[ \\t]+', ' ', 'g')) as form from lines),
sizes as (select source, count(*) as n from chunk group by source),
frequent as (select source, form from forms join sizes using (source) where length(form) >= 12 group by source, form, n having count(distinct chunk_id) >= 6 and count(distinct chunk_id) >= 0.15 * n)
"""

ORACLE = {
    "p2_found": """
with words as (select chunk_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+')) as term from chunk),
tf as (select chunk_id, term, count(*) as tf from words where length(term) >= 4 group by chunk_id, term),
df as (select term from tf group by term having count(*) between 2 and 9)
select chunk_id, term from tf join df using (term) where tf >= 3""",
    "p6_found": f"with {_LINES} select distinct chunk_id, line_no from forms join frequent using (source, form)",
    "p6_clean": f"""with {_LINES},
kept as (select f.chunk_id, string_agg(f.line, chr(10) order by f.line_no) filter (where q.form is null) as clean_text, count(q.form) as removed from forms f left join frequent q on f.source = q.source and f.form = q.form group by f.chunk_id)
select c.chunk_id, case when c.text is null then null else coalesce(k.clean_text, '') end as clean_text, cast(coalesce(k.removed, 0) as bigint) as removed from chunk c left join kept k using (chunk_id)""",
}
