"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_QUALITY = r"""
with texts as (
    select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents
), split as (
    select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
    from texts
), windows as (
    select rid, i, array_to_string(list_slice(w, i, i + 7), ' ') as win
    from (select rid, w, unnest(range(1, len(w) - 6)) as i from split)
), twice as (
    select rid, win from windows group by rid, win having count(*) > 1
), covered as (
    select rid, count(distinct j) as n
    from (select w.rid, unnest(range(w.i, w.i + 8)) as j from windows w join twice using (rid, win))
    group by rid
), measured as (
    select s.rid, doc_id, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
        len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
        coalesce(c.n, 0) as n_repeat_words
    from split s left join covered c on s.rid = c.rid
), ruled as (
    select *, n_words < 20 as f1, 100 * n_repeat_words > 30 * n_words as f2, 100 * n_symbols > 20 * word_chars as f3,
        100 * n_dup_lines > 30 * n_lines as f4, word_chars < 2 * n_words or word_chars > 20 * n_words as f5
    from measured
), rates as (
    select source, rule, count(*) as n, sum(failed::int) as k
    from (select source, unnest([1, 2, 3, 4, 5]) as rule, unnest([f1, f2, f3, f4, f5]) as failed from ruled)
    group by source, rule
), moments as (
    select rule, avg(k / n) as m, var_pop(k / n) as v from rates group by rule
), prior as (
    select rule, m, greatest(1.0, least(10000.0, case when v > 0 then m * (1 - m) / v - 1 else 10000.0 end)) as weight
    from moments
), hosts as (
    select source, max((k + m * weight) / (n + weight)) > 0.75 as failed
    from rates join prior using (rule) group by source
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
    n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
    f1 or f2 as base_failed, not (f1 or f2 or h.failed) as kept
from ruled r join hosts h on r.source is not distinct from h.source
"""

_CONTAMINATION = r"""
with docs as (
    select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
), items as (
    select coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark
), item_windows as (
    select distinct item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as win
    from (select item, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i
          from items where len(w) > 0)
), sizes as (
    select distinct n from item_windows
), doc_windows as (
    select rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as win
    from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes)
), hits as (
    select d.rid, d.i, d.n, b.item from doc_windows d join item_windows b on d.win = b.win and d.n = b.n
), words as (
    select rid, count(distinct j) as n from (select rid, unnest(range(i, i + n)) as j from hits) group by rid
), found as (
    select rid, count(*) as n, string_agg(item, ',' order by item) as ids
    from (select distinct rid, item from hits) group by rid
)
select doc_id, len(w)::bigint as n_words, coalesce(words.n, 0)::bigint as n_hit, coalesce(found.n, 0)::bigint as n_items,
    sha256(coalesce(found.ids, '')) as items_sha256, found.n is not null as contaminated
from docs left join words on docs.rid = words.rid left join found on docs.rid = found.rid
"""

_ARCHIVES = """
with payloads as (
    select page_id, coalesce(html, '') as p, min(page_id) over (partition by coalesce(html, '')) as first_id from pages
), kinds as (
    select *, strlen(p) >= 100 and first_id is not null and page_id is distinct from first_id as again from payloads
)
select page_id, case when again then 'revisit' else 'response' end as record_type,
    case when again then first_id end as refers_to, strlen(p)::bigint as payload_bytes, sha256(p) as payload_digest
from kinds
"""


_AUDIT = r"""
with texts as (
    select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part from documents
), least as (
    select t, min(doc_id) as first_id from texts group by t
), words as (
    select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from texts
), labelled as (
    select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id
), failed as (
    select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
        (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int
        + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::int
        + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(d.doc_id > first_id, false)::int as mask
    from words d join least using (t) left join labelled l on d.doc_id = l.doc_id
), masks as (
    select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by part, mask
), f(letter, own) as (
    values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders as (
    select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.own, b.own, c.own, d.own, e.own] as bits
    from f a, f b, f c, f d, f e where (a.own | b.own | c.own | d.own | e.own) = 31
), steps as (
    select filter_order, step, bits[step] as own, coalesce(list_sum(bits[1:step - 1]), 0)::int as earlier
    from (select *, unnest([1, 2, 3, 4, 5]) as step from orders)
), counted as (
    select part, filter_order, step, own,
        coalesce(sum(n) filter (mask & (own | earlier) = 0), 0)::bigint as kept,
        coalesce(sum(n) filter (mask & own > 0 and mask & earlier = 0), 0)::bigint as removed,
        coalesce(sum(n) filter (mask & own > 0 and mask & earlier > 0), 0)::bigint as redundant,
        coalesce(sum(n) filter (mask = own), 0)::bigint as unique_fails,
        coalesce(sum(good) filter (mask & own > 0 and mask & earlier = 0), 0)::bigint as good_lost,
        coalesce(sum(toxic) filter (mask & own > 0 and mask & earlier = 0), 0)::bigint as toxic_lost
    from masks, steps group by part, filter_order, step, own
)
select * exclude (own), (sum(removed) over (partition by part, own))::bigint as shapley from counted
"""


def _vector_codes(parts: int, entries: int, rounds: int) -> str:
    """One common table for each round; ``//`` cuts towards zero, hence the remainder."""
    near = """select rid, part, arg_min(entry, struct_pack(d := d, e := entry)) as entry, min(d) as d from (
            select v.rid, v.part, c.entry, list_sum(list_transform(list_zip(v.x, c.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
            from cut v join book{r} c on v.part = c.part) group by rid, part"""
    text = f"""
with kept as (
    select vec_id, label, embedding, row_number() over (order by vec_id nulls last, embedding) - 1 as rid from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), whole as (
    select rid, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as x from kept
), cut as materialized (
    select rid, part, x[part * (len(x) // {parts}) + 1:(part + 1) * (len(x) // {parts})] as x
    from (select rid, x, unnest(range({parts})) as part from whole)
), book0 as materialized (
    select part, rid as entry, x as y from cut where rid < {entries}
)"""
    for r in range(rounds):
        text += f""", near{r} as materialized ({near.format(r=r)}
), sums{r} as (
    select part, entry, place, sum(value)::bigint as s, count(*) as n
    from (select n.part, n.entry, unnest(range(len(c.x))) as place, unnest(c.x) as value from near{r} n join cut c using (rid, part))
    group by part, entry, place
), book{r + 1} as materialized (
    select b.part, b.entry, coalesce(m.y, b.y) as y from book{r} b left join (
        select part, entry, list((s - ((s % n) + n) % n) // n order by place) as y from sums{r} group by part, entry
    ) m using (part, entry)
)"""
    return text + f""", last as ({near.format(r=rounds)}
), digest as (
    select sha256(string_agg(array_to_string(y, ','), ',' order by part, entry)) as codebooks_sha256 from book{rounds}
), coded as (
    select rid, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from last group by rid
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from coded join kept using (rid), digest
"""


_LINES = r"""
with split as (
    select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), numbered as (
    select rid, unnest(lines) as line, unnest(range(len(lines))) as place from split
), keyed as (
    select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
    from numbered
), shared as (
    select k from keyed where length(k) >= 1 group by k having count(distinct rid) >= 10
), kept as (
    select rid, string_agg(line, chr(10) order by place) as t, count(*) as n from keyed where k not in (select k from shared) group by rid
)
select doc_id, len(lines)::bigint as n_lines, (len(lines) - coalesce(n, 0))::bigint as n_dropped, sha256(coalesce(t, '')) as kept_sha256
from split left join kept using (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_host_quality": _QUALITY,
        "op5_decontamination": _CONTAMINATION,
        "op9_warc": _ARCHIVES,
        "op11_filter_audit": _AUDIT,
        "op12_vector_codes": _vector_codes(parts=8, entries=16, rounds=6),
        "op13_line_dedup": _LINES,
    }
