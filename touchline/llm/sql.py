"""DuckDB SQL of the text queries that SQL can express."""

from __future__ import annotations

from .quality_rules import LEAST, MIN_ROWS, REACH, SIGNALS

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _bucket(v: str) -> str:
    e = f"(length(bin({v})) - 1)"
    return f"case when {v} < 64 then {v} else 64 + ({e} - 6) * 32 + (({v} >> ({e} - 5)) - 32) end"


def _value(b: str) -> str:
    return f"case when {b} < 64 then {b} else (32 + ({b} - 64) % 32) << (6 + ({b} - 64) // 32 - 5) end"


def _fences(keys: str, name: str) -> str:
    by = f"{keys}, " if keys else ""
    least = "case signal " + " ".join(f"when '{s}' then {v}" for s, v in LEAST.items()) + " end"
    picked = ", ".join(f"max(q{'1' if side == 'low' else '3'} {'-' if side == 'low' else '+'} {REACH} * greatest(q3 - q1, {least})) filter (where signal = '{s}') as {side}_{s}" for s in SIGNALS for side in ("low", "high"))
    return f"""
{name}_ranked as (select *, sum(n) over (partition by {by}signal) as total, sum(n) over (partition by {by}signal order by bucket) as upto from (select {by}signal, bucket, sum(n) as n from sketch group by all)),
{name}_quartiles as (select *, {_value("b1")} as q1, {_value("b3")} as q3 from (select {by}signal, max(total) as total, min(bucket) filter (where 4 * upto >= total) as b1, min(bucket) filter (where 4 * upto >= 3 * total) as b3 from {name}_ranked group by all)),
{name} as (select {by}max(total) as group_rows, {picked} from {name}_quartiles group by all)"""


def quality() -> str:
    bounds = [f"{side}_{s}" for s in SIGNALS for side in ("low", "high")]
    chosen = ", ".join(f"case when o.group_rows >= {MIN_ROWS} then o.{b} when l.group_rows >= {MIN_ROWS} then l.{b} else a.{b} end as {b}" for b in bounds)
    within = " and ".join([f"{s} <= high_{s}" for s in SIGNALS] + ["mean_length >= low_mean_length"])
    sketch = " union all ".join(f"select lang, source, '{s}' as signal, {_bucket(s)} as bucket from base where not base_failed" for s in SIGNALS)
    return rf"""with w as (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
lines as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(text, chr(10))) as line from w) where regexp_matches(line, '[^\x20\x09-\x0D]') group by all),
windows as (select doc_id, i, words[i:i + 4] as g from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w)),
repeated as (select doc_id, count(distinct place) as n_repeat_words from (select doc_id, unnest(range(i, i + 5)) as place from (select *, count(*) over (partition by doc_id, g) as n from windows) where n > 1) group by all),
counts as (select doc_id, lang, source, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars, cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
  coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from w left join lines using (doc_id) left join repeated using (doc_id)),
base as (select *, coalesce(1000 * n_symbols // nullif(n_words, 0), 0) as symbols, coalesce(100 * word_chars // nullif(n_words, 0), 0) as mean_length, coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) as dup_lines,
  coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) as repeats, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counts),
sketch as (select lang, source, signal, bucket, count(*) as n from ({sketch}) group by all),{_fences("lang, source", "own")},{_fences("lang", "by_lang")},{_fences("", "by_all")},
limits as (select o.lang, o.source, {chosen} from own o join by_lang l on o.lang is not distinct from l.lang cross join by_all a)
select doc_id, b.lang, b.source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {", ".join(SIGNALS)}, not base_failed and coalesce({within}, true) as kept
from base b left join limits t on b.lang is not distinct from t.lang and b.source is not distinct from t.source"""


HITS = rf"""with d as (select doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
items as (select item_id, words, least(13, len(words)) as n from (select item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark) where len(words) > 0),
item_windows as (select distinct item_id, n, array_to_string(words[i:i + n - 1], ' ') as g from (select *, unnest(range(1, len(words) - n + 2)) as i from items)),
doc_windows as (select doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') as g from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as i from d, (select distinct n from items))),
met as (select doc_id, item_id, doc_windows.n, i from doc_windows join item_windows using (n, g)),
hit as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + n)) as place from met) group by all),
named as (select doc_id, list_sort(list_distinct(list(cast(item_id as varchar)))) as ids from met group by all)
select doc_id, n_words, n_hit, n_items, items_sha256, n_hit > 0 and 20 * n_hit >= n_words as contaminated from (select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, cast(coalesce(len(ids), 0) as bigint) as n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256 from d left join hit using (doc_id) left join named using (doc_id))"""

LINKS = rf"""with recursive d as (select doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') as words from documents),
s as (select distinct doc_id, g from (select doc_id, array_to_string(words, ' ') as g from d where len(words) between 1 and 4 union all select doc_id, array_to_string(words[i:i + 4], ' ') from (select *, unnest(range(1, len(words) - 3)) as i from d where len(words) >= 5))),
sizes as (select doc_id, count(*) as n from s group by all),
links as (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as both_ from s x join s y using (g) where x.doc_id <> y.doc_id group by all) join sizes p on a = p.doc_id join sizes q on b = q.doc_id where 100 * both_ >= 80 * (p.n + q.n - both_)),
reach as (select doc_id, doc_id as label from documents union select l.b, r.label from reach r join links l on r.doc_id = l.a)
select doc_id, coalesce(n, 0) as n_shingles, component_id from (select doc_id, min(label) as component_id from reach group by all) left join sizes using (doc_id)"""

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINES = rf"""with k as (select doc_id, place, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UP}', '{LOW}') as key
  from (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as place from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents))),
many as (select key, max(doc_id) as keep from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select doc_id, place, line, many.keep is not null and doc_id <> keep as gone from k left join many using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256 from m group by doc_id"""

AUDIT = r"""with w as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
f as (select part, coalesce(quality = 1, false) as good, coalesce(l.toxic = 1, false) as toxic, case when len(words) < 100 then 'A' else '' end || case when 100 * len(list_distinct(words)) < 80 * len(words) then 'B' else '' end
  || case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) then 'C' else '' end || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end
  || case when w.doc_id > min(w.doc_id) over (partition by text) then 'E' else '' end as failed from w left join labels l using (doc_id)),
cells as (select part, good, toxic, failed, count(*) as n from f group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select filter_order, step, filter_order[step] as letter, filter_order[1:step - 1] as earlier from orders, (select unnest(range(1, 6)) as step)),
m as (select part, filter_order, step, letter, n, good, toxic, failed = letter as alone, contains(failed, letter) as own, len(list_intersect(string_split(failed, ''), string_split(earlier, ''))) > 0 and failed <> '' and earlier <> '' as before from cells, steps),
counted as (select part, filter_order, cast(step as integer) as step, letter, coalesce(sum(n) filter (where not own and not before), 0) as kept, coalesce(sum(n) filter (where own and not before), 0) as removed,
  coalesce(sum(n) filter (where own and before), 0) as redundant, coalesce(sum(n) filter (where alone), 0) as unique_fails, coalesce(sum(n) filter (where own and not before and good), 0) as good_lost,
  coalesce(sum(n) filter (where own and not before and toxic), 0) as toxic_lost from m group by all)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, letter) as bigint) as shapley from counted"""


def _tree(name: str, levels: int) -> str:
    """Levels of a tree over the CTE {name}0 (grp, idx, n, hash); {name}p<k> has each parent's run."""
    parts = []
    for k in range(1, levels + 1):
        parts.append(f"{name}{k} as (select grp, idx // 16 as idx, (max(n) + 15) // 16 as n, sha256(string_agg(hash, '' order by idx)) as hash, list(hash order by idx) as run from {name}{k - 1} where n > 1 group by grp, idx // 16)")
    roots = " union all ".join(f"select grp, hash as root from {name}{k} where n = 1" for k in range(levels + 1))
    return ",\n".join([*parts, f"{name}_roots as ({roots})"])


def _climb(name: str, of: str, levels: int, columns: str, start: str) -> str:
    """From the CTE ``of`` (grp, place, h, proof and columns) up the tree ``name``: the folded hash and the proof's text."""
    parts = [f"{start}0 as (select grp, place, h, proof, {columns} from {of})"]
    for k in range(1, levels + 1):
        left, right = "array_to_string(run[1:place % 16], '')", "array_to_string(run[place % 16 + 2:], '')"
        step = lambda yes, no: f"case when run is null then {no} else {yes} end"
        parts.append(
            f"{start}{k} as (select c.grp, {step('place // 16', 'place')} as place, {step(f'sha256({left} || h || {right})', 'h')} as h, {step(f'proof || {left} || {right}', 'proof')} as proof, {columns} "
            f"from {start}{k - 1} c left join {name}{k} p on c.grp = p.grp and c.place // 16 = p.idx)"
        )
    return ",\n".join(parts)


def merkle(levels: int = 6, source_levels: int = 3) -> str:
    """Trees of at most 16 ** levels leaves a source and 16 ** source_levels sources."""
    framed = lambda x: f"case when {x} is null then '-' else strlen(cast({x} as varchar)) || ':' || {x} end"
    head = " || ".join(framed(x) for x in ("doc_id", "source", "lang", "n_chars"))
    changed = f"translate(text, '{UP}', '{LOW}')"
    # crc32 with the reflected polynomial, bit by bit over the decimal's digits.
    bit = "case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
    crc = f"xor(list_reduce([cast(4294967295 as bigint)] || list_transform(string_split(cast(doc_id as varchar), ''), lambda d: cast(ascii(d) as bigint)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {bit})), 4294967295)"
    return f"""with hashed as (select doc_id, case when source is null then '-' else 's' || source end as grp, sha256({head} || {framed("text")}) as leaf,
  case when {crc} % 5 = 0 then sha256({head} || {framed(changed)}) else sha256({head} || {framed("text")}) end as changed from documents),
d0 as (select *, leaf as hash, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by grp) as n from hashed),
{_tree("d", levels)},
s0 as (select '' as grp, grp as of, root as hash, row_number() over (order by grp) - 1 as idx, count(*) over () as n from d_roots),
{_tree("s", source_levels)},
leaves as (select grp, idx as place, changed as h, '' as proof, doc_id, leaf from d0),
{_climb("d", "leaves", levels, "doc_id, leaf", "u")},
subs as (select '' as grp, s0.idx as place, h, proof, doc_id, leaf, s0.hash as subroot from u{levels} u join s0 on u.grp = s0.of),
{_climb("s", "subs", source_levels, "doc_id, leaf, subroot", "v")}
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, h as folded_root, h = root as verified from v{source_levels} v join s_roots r on v.grp = r.grp"""
