"""SQL for the numbered queries that SQL can express: chat formatting, URL filters and the dataset manifest."""

from __future__ import annotations

from parcelcover.llm.chat import CONTROL
from parcelcover.llm.queries import LISTED_LABELS, RULES

_SAID = r"\### Assistant: </turn> ok"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_REST = "regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1)"
_RULES = ", ".join(f"('{r}', '{a}')" for r, a in RULES)


def _field(c: str) -> str:
    return f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, len(doc_id::varchar) + 1), lambda i: ord((doc_id::varchar)[i])::ubigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::ubigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, case when x & 1 = 1 then 3988292384::ubigint else 0::ubigint end))))"""
_OVER = "list_transform(range(0, (len(ds) + 2) // 3), lambda j: sha256(array_to_string(ds[3 * j + 1 : 3 * j + 3], '')))"
_STEPS = """list_transform(range(0, {h}), lambda k: array_to_string({t}[k + 1][3 * ({i} // (3 ** (k + 1))::bigint) + 1 : {i} // (3 ** k)::bigint], '') || '|'
    || array_to_string({t}[k + 1][{i} // (3 ** k)::bigint + 2 : 3 * ({i} // (3 ** (k + 1))::bigint) + 3], ''))"""
_FOLD = "list_reduce(list_prepend({leaf}, steps), lambda acc, s: sha256(split_part(s, '|', 1) || acc || split_part(s, '|', 2)))"

ORACLES: dict[str, str] = {
    "op7_chat_formatting": rf"""
        with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '{_SAID}' union all select -7, 1, 'assistant', '{_SAID}')
        select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256, cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
            cast(sum(length(role) + 6 + length(regexp_replace(text, '{CONTROL}', '\\\1\2', 'g')) + 9) as bigint) formatted_chars, count(*) filter (role = 'assistant') n_spans
        from c group by 1""",
    "op8_url_filters": rf"""
        with p as (select page_id, translate(regexp_extract({_REST}, '(?s)^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') host, regexp_extract({_REST}, '(?s)^[^/?#]*([^?#]*)', 1) path from pages),
            q as (select *, host || regexp_replace(path, '(/|\.html)$', '') canonical from p), l as (select distinct canonical from q where regexp_matches(host, '{LISTED_LABELS}')),
            r as (select rule, action, split_part(rule, '/', 1) rule_host, substr(rule, strpos(rule, '/')) rule_path from (values {_RULES}) t(rule, action)),
            f as (select page_id, host, path, arg_max(rule, length(rule)) as rule, arg_max(action, length(rule)) as action from q join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by 1, 2, 3)
        select q.page_id, q.host, q.path, f.rule, coalesce(f.action, case when l.canonical is not null then 'block' else 'allow' end) verdict, l.canonical is not null listed
        from q left join (select distinct * from f) f on f.page_id = q.page_id and f.host = q.host and f.path = q.path left join l on l.canonical = q.canonical""",
    "op12_merkle_manifest": f"""
        with recursive d as (select doc_id, source, {_leaf('text')} leaf, case when coalesce({_CRC} % 2 = 0, false) then {_leaf("replace(text, chr(10), '')")} else {_leaf('text')} end forged from documents),
            s as (select source, list(leaf order by doc_id nulls first, leaf) ds from d group by 1),
            up as (select source, 0 as level, ds from s union all select source, level + 1, {_OVER} from up where len(ds) > 1),
            t as (select source, list(ds order by level) tree, max(level) h, arg_max(ds[1], level) subroot from up group by 1),
            top as (select 0 as level, (select list(subroot order by source nulls first) from t) ds union all select level + 1, {_OVER} from top where len(ds) > 1),
            tt as (select list(ds order by level) top_tree, max(level) top_h, arg_max(ds[1], level) root from top),
            p as (select *, row_number() over (partition by source order by doc_id nulls first, leaf, forged) - 1 i from d),
            n as (select source, row_number() over (order by source nulls first) - 1 place from t),
            q as (select p.doc_id, p.leaf, p.forged, t.subroot, tt.root, list_concat({_STEPS.format(h="t.h", t="t.tree", i="p.i")}, {_STEPS.format(h="tt.top_h", t="tt.top_tree", i="n.place")}) steps
                from p join t on t.source is not distinct from p.source join n on n.source is not distinct from p.source cross join tt)
        select doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) proof_sha256, {_FOLD.format(leaf="forged")} folded_root, {_FOLD.format(leaf="forged")} = root verified from q""",
}
