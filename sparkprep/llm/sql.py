"""The conversation operators' results said in DuckDB SQL."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit (3988292384 is the reversed polynomial)."""
    bit = "case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
    octets = f"list_transform(range(1, length({text}) + 1), lambda i: cast(ord(substr({text}, cast(i as integer), 1)) as bigint))"
    fold = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: {bit})"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {octets}), lambda c, b: {fold}), 4294967295)"


_ESCAPED = {"role": r"(\\|### |</turn>|: )", "text": r"(\\|### |</turn>)"}
_chars = " + ".join(rf"length(regexp_replace({c}, '{p}', '\\\1', 'g'))" for c, p in _ESCAPED.items())

CHAT_EVENTS = rf"""with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('### : </turn>') + 1 + {_chars}) as bigint) as formatted_chars
from turns group by conv_id"""

PREFIX_TRIE = f"""with ranked as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as nth
  from conversations where conv_id is not null),
convs as (select conv_id, count(*) as n, conv_id - conv_id % 5 as base,
  {crc32_sql('cast(conv_id as varchar)')} % 9 as shared from ranked group by conv_id),
plan as (select c.*, least(c.shared, coalesce(b.n, 0)) as head from convs c left join convs b on b.conv_id = c.base),
turns as (
  select p.conv_id, r.nth as depth, role, text from plan p join ranked r on r.conv_id = p.base and r.nth <= p.head
  union all
  select p.conv_id, r.nth - p.shared + p.head as depth, role, text from plan p join ranked r on r.conv_id = p.conv_id and r.nth > p.shared),
paths as (
  select conv_id, depth, strlen(text) as bytes, list({{'r': role, 't': text}}) over (partition by conv_id order by depth) as name from turns
  union all select conv_id, 0, 0, [] from convs),
lengths as (select conv_id, max(depth) as length from paths group by conv_id),
nodes as (
  select name, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (depth = length), '')) as ends_sha256
  from paths join lengths using (conv_id) group by name, depth),
members as (select n.conv_id, n.depth, p.conv_id as member from nodes n join paths p on p.name = n.name and p.depth = n.depth),
ups as (select n.conv_id, n.depth, u.conv_id as parent_conv_id from nodes n
  join members m on m.member = n.conv_id and m.depth = n.depth - 1 join nodes u on u.conv_id = m.conv_id and u.depth = m.depth),
kids as (select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n_children from ups group by all),
below as (
  select a.conv_id, a.depth, count(*) filter (k.conv_id is null) as n_leaves, sum((d.n_convs - 1) * d.bytes) as saved_tokens
  from nodes d left join kids k on k.conv_id = d.conv_id and k.depth = d.depth
  join members m on m.member = d.conv_id and m.depth <= d.depth
  join nodes a on a.conv_id = m.conv_id and a.depth = m.depth group by a.conv_id, a.depth)
select n.conv_id, n.depth, u.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, b.n_leaves,
  cast(b.saved_tokens as bigint) as saved_tokens, n.ends_sha256
from nodes n left join ups u using (conv_id, depth) left join kids k using (conv_id, depth) join below b using (conv_id, depth)"""

_TEXT = r"[^\x20\x09-\x0D]"

STRUCTURE_REPAIR = rf"""with recursive hashed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    cast(conv_id as varchar) || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations where conv_id is not null),
picked as (select *, {crc32_sql('key')} % 20 as planted from hashed),
damaged as (
  select conv_id, turn, case when planted = 4 then 'user' else role end as role,
    case planted when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from picked, range(case when planted = 3 then 2 else 1 end) where planted <> 0),
ranked as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as nth from damaged),
faulty as (select *, left(role, 1) as initial, case when not regexp_matches(text, '{_TEXT}') then 'blank'
    when row_number() over (partition by conv_id, role, text order by nth) > 1 then 'duplicate'
    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' end as fault from ranked),
turned as (select *, lag(initial) over (partition by conv_id order by nth) || initial as two from faulty),
kept(state, initial, next) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
made(state, role, next) as (values (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
added(state, next, cost, letters, lines) as (
  select next, next, 0, '', '' from (select distinct next from made union values (0), (1))
  union all select state, next, 2, 'I', chr(10) || role || ':' from made
  union all select a.state, b.next, 4, 'II', chr(10) || a.role || ':' || chr(10) || b.role || ':' from made a join made b on b.state = a.next),
walk(conv_id, nth, state, best) as (
  select conv_id, 0, next, printf('%09d', cost) || letters || chr(1) || lines
  from (select distinct conv_id from faulty), added where state = 0
  union all
  select conv_id, nth, next, min(printf('%09d', cost) || audit || chr(1) || lines) from (
    select o.conv_id, o.nth, a.next, o.cost + a.cost as cost, o.audit || a.letters as audit, o.lines || a.lines as lines from (
      select w.conv_id, f.nth, e.next as state,
        cast(left(best, 9) as integer) + case e.edit when 'D' then 3 when 'R' then 2 else 0 end
          + case when e.edit <> 'D' and f.fault = 'truncated' then 1 else 0 end as cost,
        substr(split_part(best, chr(1), 1), 10) || e.edit as audit,
        split_part(best, chr(1), 2) || case when e.edit = 'D' then '' else chr(10) || coalesce(e.role, f.role) || ':' || f.text end as lines
      from walk w join faulty f on f.conv_id = w.conv_id and f.nth = w.nth + 1
      join (select 'K' as edit, state, initial, next, null as role from kept union all select 'R', state, null, next, role from made
        union all select 'D', next, null, next, null from (select distinct next from made union values (0), (1))) e
        on e.state = w.state and (e.edit <> 'K' or e.initial = f.initial) and (e.edit = 'D' or coalesce(f.fault, '') not in ('blank', 'duplicate'))
    ) o join added a on a.state = o.state) group by conv_id, nth, next),
ends as (select conv_id, max(nth) as nth from faulty group by conv_id),
best as (select conv_id, min(best) as best from walk join ends using (conv_id, nth) where state in (0, 3) group by conv_id),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
  count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
  count(*) filter (two is not null and two not in ('su', 'ua', 'au')) as illegal from turned group by conv_id)
select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(coalesce(left(best, 9), '0') as bigint) as cost,
  coalesce(substr(split_part(best, chr(1), 1), 10), '') as audit, sha256(coalesce(substr(split_part(best, chr(1), 2), 2), '')) as repaired_sha256
from (select distinct conv_id from hashed) left join counts using (conv_id) left join best using (conv_id)"""
