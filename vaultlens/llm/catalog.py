"""Named queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from vaultlens.llm import components, consensus, nearcopies, overlap, packing, splitting, tokenize, truncation
from vaultlens.plans import sql as S


def queries() -> dict:
    return {
        "p1_found": components.p1_found,
        "p2_found": consensus.p2_found,
        "p2_consensus": consensus.p2_consensus,
        "p2_records": consensus.p2_records,
        "p3_found": overlap.p3_found,
        "p4_found": nearcopies.p4_found,
        "p4_groups": nearcopies.p4_groups,
        "p5_found": splitting.p5_found,
        "p5_pieces": splitting.p5_pieces,
        "p5_whole": splitting.p5_whole,
        "p7_ids": tokenize.p7_ids,
        "p7_tokens": tokenize.p7_tokens,
        "p7_roundtrip": tokenize.p7_roundtrip,
        "p8_containers": packing.p8_containers,
        "p8_fill": packing.p8_fill,
        "p8_checked": packing.p8_checked,
        "p9_found": truncation.p9_found,
        "p9_sources": truncation.p9_sources,
    }


_CONFIRMED = f"select * from {S.counting('candidate_groups', 'group_id', 'verified_at')} where is_duplicate"


#: Written out here, so that a stand-in missing from the operator's lists shows.
_NO_TITLE = "'untitled', 'untitled note', 'no title', 'new note', 'n/a', 'na', 'tbd', 'todo', 'none', 'null', 'unknown', 'без названия', 'новая заметка', 'ohne titel', 'unbenannt', 'neue notiz', 'sin título', 'sin titulo', 'nueva nota', 'sans titre', 'nouvelle note'"
_NO_TAG = "'untagged', 'no tag', 'no tags', 'none', 'null', 'n/a', 'na', 'tbd', 'todo', 'unknown', 'uncategorized', 'uncategorised'"

_NEAR = f"""
with n as {S.counting('vault_notes', 'note_id', 'updated_at')},
w as (select note_id, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') ws from n),
r as (select note_id, ws, unnest(range(1, len(ws) - 1)) i from w where len(ws) >= 25),
s as (select distinct note_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] x from r),
t as (select *, count(*) over (partition by note_id) m from s),
c as (select a.note_id note_id_a, b.note_id note_id_b, a.m ma, b.m mb, count(*) o from t a join t b on a.x = b.x and a.note_id < b.note_id group by all)
"""


_BEST = f"""
with g as ({_CONFIRMED}),
m as (select distinct group_id, unnest(notes) note_id from g),
m2 as (select * from m where note_id is not null qualify count(*) over (partition by group_id) > 1),
t as (select lower({S.strip('source_doc')}) s, max(trust) trust from source_registry group by 1),
n as (select n.*, coalesce(trust, 0) trust from {S.counting('vault_notes', 'note_id', 'updated_at')} n left join t on t.s = lower({S.strip('source_doc')})),
c as (
  select group_id, m2.note_id, trust, updated_at,
    regexp_matches(title, '[\\p{{L}}\\p{{N}}]') and regexp_replace({S.title_key('title')}, ' ?(?:\\(\\d+\\)|\\d+)$', '') not in ({_NO_TITLE}) has_title,
    len(list_filter(list_transform(tags, lambda x: lower(regexp_replace(x, '^(?:{S.WS}|#)+|{S.WS}+$', '', 'g'))), lambda x: x is not null and regexp_matches(x, '[\\p{{L}}\\p{{N}}]') and x not in ({_NO_TAG}))) > 0 has_tags,
    len(regexp_extract_all(array_to_string(list_distinct(list_transform(regexp_split_to_array(body, '\\n{S.WS}*\\n'), lambda x: {S.strip('x')})), ' '), '{S.NOT_WS}+')) words
  from m2 join n on n.note_id = m2.note_id)
select group_id, 'title' field, note_id from c where has_title qualify row_number() over (partition by group_id order by trust desc, updated_at desc, note_id) = 1
union all
select group_id, 'tags', note_id from c where has_tags qualify row_number() over (partition by group_id order by updated_at desc, note_id) = 1
union all
select group_id, 'body', note_id from c where words > 0 qualify row_number() over (partition by group_id order by words desc, note_id) = 1"""
_ITEMS = f"""
with s as {S.counting('doc_sections', 'section_id', 'parsed_at')},
p as {S.counting('plan_notes', 'plan_note_id', 'proposed_at')},
i as (
  select 'section' item_kind, section_id item_id, array_to_string(list_filter(list_transform(paragraphs, lambda x: {S.strip('x')}), lambda x: x is not null and x <> ''), chr(10) || chr(10)) t from s
  union all select 'plan', plan_note_id, body from p)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""
with recursive g as ({_CONFIRMED}),
p as (select unnest(pairs) x from g),
e as (select distinct x.a a, x.b b from p where x.a <> x.b),
s as (select a, b from e union select b, a from e),
n as (select distinct unnest(notes) i from g union select x.a from p union select x.b from p),
reach as (select i note_id, i c from n where i is not null union select s.b, reach.c from reach join s on s.a = reach.note_id)
select note_id, min(c) component_id from reach group by note_id""",
        "p2_found": _BEST,
        "p2_records": f"""with won as ({_BEST}), n as {S.counting('vault_notes', 'note_id', 'updated_at')}
select group_id, max(case when field = 'title' then title end) canonical_title, max(case when field = 'tags' then tags end) canonical_tags, max(case when field = 'body' then body end) canonical_body
from won join n on n.note_id = won.note_id group by group_id""",
        "p3_found": f"""
with n as {S.counting('note_records', 'note_id', 'scanned_at')},
v as (
  select distinct note_id, 't:' || lower(regexp_replace(x, '^(?:{S.WS}|#)+|{S.WS}+$', '', 'g')) x from (select note_id, unnest(tags) x from n)
  union select distinct note_id, 'l:' || {S.target_key('x')} from (select note_id, unnest(links) x from n)),
w as (select *, count(*) over (partition by note_id) m from v where x not in ('t:', 'l:')),
c as (select a.note_id note_id_a, b.note_id note_id_b, a.m ma, b.m mb, count(*) o from w a join w b on a.x = b.x and a.note_id < b.note_id where a.m > 3 and b.m > 3 group by all)
select note_id_a, note_id_b from c where 10 * o >= 7 * (ma + mb - o)""",
        "p4_found": _NEAR + "select note_id_a, note_id_b from c where 2 * o >= ma + mb - o",
        "p4_groups": _NEAR.replace("with n as", "with recursive n as", 1).rstrip() + """,
e as (select note_id_a a, note_id_b b from c where 2 * o >= ma + mb - o),
s2 as (select a, b from e union all select b, a from e),
reach as (select a note_id, a r from s2 union select s2.b, reach.r from reach join s2 on s2.a = reach.note_id)
select note_id, min(r) group_id, (select count(*) from s2 where s2.a = reach.note_id) links from reach group by note_id""",
        "p5_found": _ITEMS + "select i.item_kind, i.item_id from i join piece_limits l on l.item_kind = i.item_kind where length(t) > l.max_chars",
        "p5_whole": _ITEMS + "select i.item_kind, i.item_id, md5(t) digest, true fits, true shared from i join piece_limits l on l.item_kind = i.item_kind where t <> ''",
        "p7_roundtrip": "select doc_id, md5(coalesce(text, '')) digest from documents",
        "p8_checked": "select container_kind, (select count(*) from documents) docs, 0::bigint overfull, 0::bigint torn, 0::bigint lost from container_sizes",
    }
