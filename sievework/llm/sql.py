"""What some of the queries return, in SQL. The others need the consistent form, edit distances, token counts or searches that SQL
lacks; tests hold them against brute force."""

from __future__ import annotations

_RECORDS = """r as (select 'item' table_name, id rec_id, min(text) text from item where id is not null and text is not null group by id
  union all select 'quoting_dev', id, min(text) from quoting_dev where id is not null and text is not null group by id),
w as (select table_name, rec_id, p, substr(text, p + 1, 100) s from (select table_name, rec_id, text, unnest(range(0, length(text) - 99)) p from r)),
shared as (select s from w group by s having count(distinct rec_id) > 1),
hit as (select table_name, rec_id, p, coalesce(p > lag(p) over (partition by table_name, rec_id order by p) + 100, true) fresh from w semi join shared using (s)),
island as (select *, sum(fresh::int) over (partition by table_name, rec_id order by p) n from hit),
span as (select table_name, rec_id, min(p) span_start, max(p) + 100 span_end from island group by table_name, rec_id, n)"""

SQL = {
    "p5_found": f"with {_RECORDS} select * from span",
    "p5_shared_amounts": f"""with {_RECORDS}, t as (select table_name, rec_id, sum(span_end - span_start)::bigint c, count(*) n from span group by all)
select table_name, rec_id, length(text)::bigint chars, coalesce(c, 0) shared_chars, coalesce(n, 0) spans, case when length(text) > 0 then coalesce(c, 0) / length(text) else 0 end share from r left join t using (table_name, rec_id)""",
}
