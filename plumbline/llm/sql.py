"""DuckDB SQL of the queries that SQL can express."""

_BLANK = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"

SQL: dict[str, str] = {}

SQL["op5_line_dedup"] = f"""
with parts as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
lines as (select doc_id, unnest(range(1, len(ls) + 1)) as i, ls from parts),
line as (select doc_id, i, ls[i] as line from lines),
worded as (select doc_id, i, line, row_number() over (partition by doc_id order by i) - 1 as k, count(*) over (partition by doc_id) as n
  from line where regexp_matches(line, '{_WORD}')),
ahead as (select doc_id, k, n, line, lead(line, 1) over w as l1, lead(line, 2) over w as l2 from worded window w as (partition by doc_id order by k)),
win as (select doc_id, k, row_number() over (partition by least(n, 3), line, coalesce(l1, ''), coalesce(l2, '') order by doc_id, k) as seen
  from ahead where k <= greatest(n - 3, 0)),
gone as (select distinct w.doc_id, w.i from worded w join win r on w.doc_id = r.doc_id and r.seen > 1 and w.k between r.k and r.k + 2),
cut as (select l.doc_id, count(g.i) as n_removed, coalesce(string_agg(l.line, chr(10) order by l.i) filter (where g.i is null), '') as rest
  from line l left join gone g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id having count(g.i) > 0)
select d.doc_id, coalesce(c.n_removed, 0)::bigint as n_removed, case when c.doc_id is null then d.text else c.rest end as text
from documents d left join cut c on d.doc_id = c.doc_id
"""

SQL["op8_quality_rules"] = f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, list_filter(regexp_split_to_array(text, '{_BLANK}+'), lambda x: x <> '') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as ls, text from t),
pos as (select doc_id, unnest(range(1, len(words) - 6)) as i, words from w where len(words) >= 8),
win as (select doc_id, i, array_to_string(words[i:i + 7], chr(31)) as s from pos),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as c from win) where c > 1),
cov as (select doc_id, sum(least(8, coalesce(nxt - i, 8))) as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from rep) group by doc_id),
m as (select w.doc_id, len(words) as n_words, length(regexp_replace(text, '{_BLANK}', '', 'g')) as word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
  coalesce(cov.n, 0) as n_repeat_words, len(ls) as n_lines,
  length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as n_capitals,
  length(text) - length(translate(text, '!?', '')) as n_marks,
  len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) as n_doubled
  from w left join cov on w.doc_id = cov.doc_id),
b as (select *, (n_words < 20)::bigint + 2 * (100 * n_repeat_words > 30 * n_words)::bigint + 4 * (10 * n_symbols > 2 * n_words)::bigint
  + 8 * (2 * n_capitals > word_chars)::bigint + 16 * (4 * n_marks > 3 * n_words)::bigint + 32 * (5 * n_dup_lines > 3 * n_lines)::bigint
  + 64 * (10 * n_doubled > 3 * n_words)::bigint + 128 * (word_chars < 2 * n_words or word_chars > 20 * n_words)::bigint as failed_rules from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, failed_rules % 4 > 0 as base_failed, failed_rules = 0 as kept, failed_rules from b
"""

SQL["op13_fill_in_middle"] = """
with t as (select doc_id, coalesce(text, '') as text, sha256(concat('1:', doc_id)) as h from documents),
h as (select *, length(text)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3,
  ('0x' || h[25:32])::bigint as h4 from t),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
  when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substring(text, 1, a) as pre, substring(text, a + 1, b - a) as mid, substring(text, b + 1) as suf from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then concat('<P>', pre, '<S>', suf, '<M>', mid) else concat('<S>', suf, '<P>', pre, '<M>', mid) end)
    as output_sha256, sha256(text) as restored_sha256 from p
"""


def _vector_codes(rounds: int = 4) -> str:
    """Rounds written out one after another; parts as lists of doubles, which hold these whole numbers exactly."""
    near = """near{t} as materialized (select rid, p, min([list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c), e]) as best
  from part join book{t} using (p) group by rid, p)"""
    book = """sum{t} as materialized (select p, e, pos, sum(x)::bigint as s, count(*) as n from (select p, best[2] as e, unnest(v) as x, generate_subscripts(v, 1) as pos
  from part join near{t} using (rid, p)) group by p, e, pos),
mean{t} as (select p, e, list(((s - ((s % n) + n) % n) // n)::double order by pos) as c from sum{t} group by p, e),
book{u} as materialized (select p, e, coalesce(m.c, b.c) as c from book{t} b left join mean{t} m using (p, e))"""
    steps = ",\n".join(near.format(t=t) + ",\n" + book.format(t=t, u=t + 1) for t in range(rounds))
    return f"""
with kept as (select row_number() over (order by vec_id) - 1 as rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
part as materialized (select rid, p::double as p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] as v from kept, range(4) r(p)),
book0 as materialized (select p, rid::double as e, v as c from part where rid < 256),
{steps},
{near.format(t=rounds)},
found as (select rid, string_agg(printf('%02x', best[2]::int), '' order by p) as code, sum(best[1])::bigint as error from near{rounds} group by rid),
flat as (select p, e, unnest(c) as x, generate_subscripts(c, 1) as pos from book{rounds}),
digest as (select sha256(string_agg(x::bigint::varchar, ',' order by p, e, pos)) as codebooks_sha256 from flat)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from kept join found using (rid), digest
"""


SQL["op12_vector_codes"] = _vector_codes()
