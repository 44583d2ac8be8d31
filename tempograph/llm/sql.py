"""DuckDB SQL for the queries of this subpackage that SQL can express; patterns and constants come from the operators."""

from __future__ import annotations

from . import chat_format, secret_scan, url_filter


def either_case(pattern: str) -> str:
    """Letters outside brackets in either case, ASCII only; SQL's own flag would fold other scripts too."""
    out, inside = [], False
    for c in pattern:
        inside = c == "[" or inside and c != "]"
        out.append(f"[{c.upper()}{c}]" if c.isalpha() and not inside else c)
    return "".join(out)


def secret_scan_sql() -> str:
    """Places of matches from the lengths of what lies between them: text is split at the matches, and both lists are summed up."""
    kinds = []
    for order, (kind, rule, group, least, _) in enumerate(secret_scan.RULES):
        pattern = rule.pattern.replace(r"\x20", " ")
        if group:
            key, rest = pattern.split(")", 1)
            pattern = f"({either_case(key[1:])}){rest}"
        pattern = pattern.replace("'", "''")
        kinds.append(f"""select doc_id, {order} as o, '{kind}' as kind, string_split_regex(t, '{pattern}') as gaps, regexp_extract_all(t, '{pattern}') as hits,
            {f"regexp_extract_all(t, '{pattern}', {group})" if group else f"regexp_extract_all(t, '{pattern}')"} as own, {least} as least from d where regexp_matches(t, '{pattern}')""")
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
k as ({" union all ".join(kinds)}),
m as (select doc_id, o, kind, least, unnest(gaps[:len(hits)]) as gap, unnest(hits) as hit, unnest(own) as own, unnest(range(len(hits))) as place from k),
p as (select *, sum(length(gap) + length(hit)) over (partition by doc_id, o order by place) as stop from m),
s as (select doc_id, o, kind, cast(stop - length(hit) as bigint) as start, kind || ':' || cast(stop - length(hit) as bigint) || ':' || cast(stop as bigint) as span from p where length(own) >= least)
select d.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  sha256(coalesce(string_agg(span, ',' order by start, o) filter (o < {len(secret_scan.BASE)}), '')) as base_sha256, coalesce(string_agg(span, ',' order by start, o) filter (span is not null), '') as spans
from d left join s on s.doc_id = d.doc_id group by d.doc_id"""


def chat_format_sql() -> str:
    """The lengths of the template's parts and of escapes, and digests of the plain turns."""
    marks = "".join(f"\\{c}" for c in chat_format.MARKS)
    escaped = f"length({{0}}) + length(regexp_replace({{0}}, '[^{marks}]', '', 'g'))".format
    frame = len('<turn role="') + len('">\n') + len("\n</turn>\n")
    said = "\\### Assistant: </turn> ok"
    return f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations union all select -7, 0, 'user', '{said}' union all select -7, 1, 'assistant', '{said}')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn, role, t)) as turns_sha256,
  cast(coalesce(sum(length(t)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(t, '' order by turn, role, t) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum({frame} + {escaped("role")} + {escaped("t")}) as bigint) as formatted_chars
from c group by conv_id"""


def near_dedup_sql(least: int = 75, words: int = 5) -> str:
    """Sets joined on their shingles, and components by what reaches what."""
    upper, lower = ("".join(map(chr, range(a, a + 26))) for a in (65, 97))
    return f"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, case when len(w) < {words} then array_to_string(w, ' ') else array_to_string(w[i : i + {words - 1}], ' ') end as s
      from (select doc_id, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {least} * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
r as (select a, b from e union select r.a, e.b from r join e on e.a = r.b),
m as (select a, min(b) as low from r group by a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) as component_id, w.doc_id = least(w.doc_id, coalesce(m.low, w.doc_id)) as kept
from w left join n on n.doc_id = w.doc_id left join m on m.a = w.doc_id"""


def all_() -> dict[str, str]:
    return {"op1_secret_scan": secret_scan_sql(), "op6_url_filter": url_filter.sql(), "op8_chat_format": chat_format_sql(), "op10_near_dedup": near_dedup_sql()}
