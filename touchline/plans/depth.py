"""Queries of paging, captures, registries, semi-structured values, live checks and order rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import half_up
from ..operators import assembly
from ..operators import calibration as cal
from ..operators import variants as v
from ..operators.ordered import Pages
from ..sources import playbyplay as pbp
from ..sources import registry
from ..sources.shared import shared_folder, written
from ..sources.tables import SQL_LEDGER as L
from ..sources.tables import SQL_MATCHES as M
from ..sources.tables import SQL_TEAM_MATCH as TM
from ..sources.tables import ledger, matches, sql, table
from ..streaming import reconcile, upsert
from .models import STRENGTH, judged

c = F.col
key = lambda x, n: F.col(x) % n


def paged(s, d):
    orders = table(s, d, "orders").select("o_totalprice", "o_orderkey")
    return Pages(orders, ["o_totalprice", "o_orderkey"]).placed().select("o_orderkey", F.floor(c("place") / 100).alias("page"), (c("place") % 100).alias("at"))


def two_pages(s, d):
    """A page by its number, and the rows behind a key."""
    pages = Pages(table(s, d, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"])
    return pages.page(3, 40).select(F.lit("page").alias("by"), "o_orderkey").unionByName(pages.after((150_000.0, 0), 40).select(F.lit("cursor").alias("by"), "o_orderkey"))


#: Texts that the captures below tell: all known ones, and some that aren't listed.
TEXTS = [*pbp.PLAYS, "Goal - Overhead kick", "VAR - Review", "Start Delay", "Own Mystery"]
FEET = ["Left Foot", "Right Foot", "Head", "Other"]


def captures(s, d):
    """Play-by-play captures in JSON, one for each order; a quarter of them on the 0 to 1 scale."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(s, d, "lineitem").withColumn("number", F.row_number().over(order))
    scale = F.when(key("l_orderkey", 4) == 0, 100.0).otherwise(1.0)
    pick = lambda values, at: F.element_at(F.array(*[F.lit(x) for x in values]), (at + 1).cast("int"))
    ref = lambda kind, number: F.struct(F.concat(F.lit(f"http://core.example/{kind}/"), number.cast("string"), F.lit("?lang=en")).alias("$ref"))
    x, y = c("l_quantity").cast("double") * 2 / scale, key("l_partkey", 101).cast("double") / scale
    flag = lambda n: F.when(key("l_partkey", n) == 0, True)
    play = F.struct(
        c("number").cast("string").alias("id"), F.when(key("l_partkey", 37) == 0, False).alias("valid"), F.struct(pick(TEXTS, key("l_partkey", len(TEXTS))).alias("text")).alias("type"),
        F.struct(F.when(key("l_partkey", 90) >= 45, 2).otherwise(1).alias("number")).alias("period"), F.struct((key("l_partkey", 90) * 60 + c("l_linenumber")).cast("double").alias("value")).alias("clock"), ref("teams", key("l_suppkey", 25)).alias("team"),
        F.array(F.struct(F.lit(2).alias("order"), ref("athletes", c("l_partkey")).alias("athlete")), F.struct(F.lit(1).alias("order"), ref("athletes", c("l_suppkey")).alias("athlete"))).alias("participants"),
        x.alias("fieldPositionX"), y.alias("fieldPositionY"), y.alias("fieldPosition2X"), x.alias("fieldPosition2Y"), flag(53).alias("ownGoal"), F.when(key("l_partkey", 59) == 0, False).alias("scoringPlay"), flag(43).alias("yellowCard"),
        F.struct(pick(FEET, key("l_suppkey", 4)).alias("text")).alias("contactType"),
    )
    return li.groupBy(c("l_orderkey").alias("match_id")).agg(F.to_json(F.struct(F.collect_list(play).alias("items"))).alias("body"))


_text = lambda s: s.replace("'", "''")
_field = lambda k, other: f"case text {' '.join(f'''when '{_text(t)}' then {chr(39) + v[k] + chr(39) if len(v) > k and v[k] else 'null'}''' for t, v in pbp.PLAYS.items())} else {other} end"
_slug = "'espn_' || regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g')"
_is_goal, _is_break = "regexp_matches(text, '^Goal( - |$)')", "regexp_matches(text, '^(Start|End) |Delay|VAR|Deleted After Review|Half|Regular Time|Extra Time')"
PLAYS_SQL = f"""with raw as (select l_orderkey as match_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as id, {[_text(t) for t in TEXTS]}[l_partkey % {len(TEXTS)} + 1] as text, case when l_partkey % 90 >= 45 then 2 else 1 end as period, l_partkey % 90 * 60 + l_linenumber as clock,
  l_quantity * 2.0e0 / case when l_orderkey % 4 = 0 then 100 else 1 end as x, l_partkey % 101 * 1.0e0 / case when l_orderkey % 4 = 0 then 100 else 1 end as y, l_partkey % 53 = 0 as own, l_partkey as k, l_suppkey as p from lineitem),
t as (select *, row_number() over (partition by match_id order by period, clock, id) as sequence, count(*) over w >= 5 and max(x) over w <= 1 and max(y) over w <= 1 as small from raw where k % 37 <> 0 window w as (partition by match_id)),
m as (select *, {_field(0, f"case when {_is_goal} then 'shot' when {_is_break} then 'interruption' else 'unmapped' end")} as kind, {_field(1, f"case when {_is_goal} then 'open_play' else {_slug} end")} as sub, {_field(2, f"case when {_is_goal} then 'goal' end")} as become,
  {_field(3, "null")} as piece, {_field(4, "null")} as shown from t)
select match_id, cast(sequence as int) as sequence, cast(id as varchar) as source_event_id, cast(p % 25 as varchar) as team, cast(p as varchar) as player, case period when 1 then '1H' else '2H' end as period, greatest(clock - case period when 1 then 0 else 2700 end, 0) * 1.0e0 as clock_seconds, cast(clock // 60 + 1 as int) as minute,
  case when own then 'touch' else kind end as event_type, case when own then 'own_goal' else sub end as subtype, piece as set_piece, case when own then 'goal' else become end as outcome, case p % 4 when 0 then 'left_foot' when 1 then 'right_foot' when 2 then 'head' end as body_part,
  coalesce(become = 'goal', false) and not own and k % 59 <> 0 as is_goal, own as is_own_goal, coalesce(shown, case when k % 43 = 0 then 'yellow' end) as card, x as source_x, y as source_y, case when small then 'unit' else 'percent' end as coordinates,
  case when not small and x <= 100 and y <= 100 then floor(x / 100 * 105 * 100 + 0.5) / 100 end as x_m, case when not small and x <= 100 and y <= 100 then floor((100 - y) / 100 * 68 * 100 + 0.5) / 100 end as y_m,
  case when not small and kind = 'pass' and x <= 100 and y <= 100 then floor(y / 100 * 105 * 100 + 0.5) / 100 end as end_x_m, case when not small and kind = 'pass' and x <= 100 and y <= 100 then floor((100 - x) / 100 * 68 * 100 + 0.5) / 100 end as end_y_m from m"""


def registry_rows(s, d):
    """Suppliers as reviewed entries, a document for each nation: some lack a field, don't fit or repeat a key; some documents are cut short."""
    k = c("s_suppkey")
    entry = F.when(k % 31 == 0, F.lit('{"provider": {"not": "a name"}, "external_id": 5')).otherwise(F.to_json(F.struct(
        F.lit("p").alias("provider"), F.when(k % 7 != 0, (k - (k % 11 == 0).cast("int") * 25).cast("string")).alias("external_id"), F.struct(F.lit("p").alias("provider"), (k + 1000).cast("string").alias("external_id")).alias("same_as"),
        F.lit("r").alias("reviewer"), F.when(k % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("seen"))).alias("evidence"),
    )))
    sound = table(s, d, "supplier").where("s_suppkey % 31 <> 0").withColumn("of", F.format_string("%02d", k % 25))
    body = F.concat(F.lit('{"registry_version": "2026-'), c("of"), F.lit('",\n "entries": [\n'), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), entry.alias("e")))), lambda x: x["e"]), ",\n"), F.when(c("of") == "24", "").otherwise("\n]}"))
    path = shared_folder(s, "registry")
    sound.groupBy("of").agg(body.alias("body")).repartition(25, "of").write.partitionBy("of").text(path)
    loaded = registry.load(s, f"{path}/*/*.txt")
    return loaded.groupBy("registry_version", "problem").agg(F.count("*").alias("n"), F.min(c("external_id").cast("long")).alias("least"))


REGISTRY_SQL = """with e as (select s_suppkey as k, s_suppkey % 25 as doc, case when s_suppkey % 7 <> 0 then s_suppkey - case when s_suppkey % 11 = 0 then 25 else 0 end end as id, s_suppkey % 13 = 0 as bare from supplier where s_suppkey % 31 <> 0 and s_suppkey % 25 <> 24),
j as (select *, nullif(concat_ws(',', case when id is null then 'external_id' end, case when bare then 'evidence' end), '') as lacks from e),
u as (select *, row_number() over (partition by id, lacks is null order by doc desc, k) as place from j)
select '2026-' || lpad(cast(doc as varchar), 2, '0') as registry_version, coalesce('lacks ' || lacks, case when place > 1 then 'duplicate' end) as problem, count(*) as n, min(id) as least from u group by all
union all select null, 'broken document', 1, null from (select 1 from supplier where s_suppkey % 25 = 24 and s_suppkey % 31 <> 0 limit 1)"""


def packets(s, d):
    """Events as packets in JSON: lists and objects of their own shape, some with names that a model must not see."""
    e = table(s, d, "events")
    k = c("event_id")
    inner = F.when(k % 10 == 0, F.format_string('{"closing_line": %d}', k)).when(k % 10 == 1, F.format_string('[1, {"deep": {"matchOdds": [{"price": %d}]}}]', k)).otherwise(F.format_string('{"k": %d, "note": "the odds are in a text"}', k))
    return e.select("event_id", v.parsed(F.concat(F.lit('{"props": '), c("props"), F.lit(', "inner": '), inner, F.lit("}"))).alias("packet"))


def states(s, d, new):
    """Customers as JSON: the later state has other names first, numbers as texts, and some changes."""
    t = table(s, d, "customer")
    k = c("c_custkey")
    late = F.format_string('{"tags": {"b": [1, 2], "a": %d}, "nation": "%d", "seen": "2024-05-01T12:00:00Z", "gone": null, "segment": "%s"}', k + (k % 9 == 0).cast("int"), c("c_nationkey"), F.when(k % 5 == 0, "NEW").otherwise(c("c_mktsegment")))
    early = F.format_string('{"segment": "%s", "nation": %d, "seen": "2024-05-01T14:00:00+02:00", "tags": {"a": %d, "b": [1, 2]}}', c("c_mktsegment"), c("c_nationkey"), k)
    return t.select(k.alias("key"), v.parsed(late if new else early).alias("body"))


def finals(s, d):
    m = matches(s, d).where("status = 'finished'").select("match_id", (c("kickoff_at") + F.expr("interval 2 hours")).alias("finished_at"), c("home_score").alias("home"), c("away_score").alias("away"))
    at = F.expr("make_interval(0, 0, 0, 0, 0, l_partkey % 400 - 200)")
    reads = table(s, d, "lineitem").select(c("l_orderkey").alias("match_id"), "l_partkey", "l_suppkey").join(m.select("match_id", "finished_at", "home", "away"), "match_id")
    reads = reads.select("match_id", (c("finished_at") + at).alias("read_at"), (c("home") + F.when(key("l_suppkey", 5) == 0, 1).otherwise(0)).alias("home"), "away")
    return reconcile.final_checks(m, reads).select("match_id", "reads", "result")


READS = 6


def ledger_reads(s, d):
    """Complete reads of each user's events as a match's plays: some withdrawn, some moved, and glitches that last or don't."""
    plays = table(s, d, "events").groupBy(c("user_id").alias("match_id")).agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    each = plays.select("match_id", "ids", F.explode(F.sequence(F.lit(0), F.lit(READS - 1))).alias("r"))
    glitch = (key("match_id", 4) == 0) & ((c("r") == 3) | ((key("match_id", 8) == 0) & (c("r") > 3)))
    read = F.filter("ids", lambda e: F.when(glitch, e % 5 == 0).otherwise((e % 17 != 3) | (c("r") < 2)))
    moved = F.concat(F.filter(read, lambda e: e % 2 == 0), F.filter(read, lambda e: e % 2 == 1))
    shown = F.when((key("match_id", 3) == 1) & (c("r") >= 1), moved).otherwise(read)
    return each.select("match_id", c("r").cast("long").alias("at"), F.transform(shown, lambda e: e.cast("string")).alias("plays"))


LEDGER_SQL = f"""with recursive reads as (select user_id as match_id, cast(r as bigint) as "at", coalesce(list(cast(event_id as varchar) order by case when user_id % 3 = 1 and r >= 1 then event_id % 2 else 0 end, event_id)
    filter (where case when user_id % 4 = 0 and (r = 3 or (user_id % 8 = 0 and r > 3)) then event_id % 5 = 0 else event_id % 17 <> 3 or r < 2 end), cast([] as varchar[])) as plays from events, (select unnest(range({READS})) as r) group by all),
f as (select distinct match_id, cast(-1 as bigint) as "at", cast([] as varchar[]) as old, cast([] as varchar[]) as ledger, '' as sig, 0 as held, cast([] as varchar[]) as gone, false as suspect, false as hold from reads
  union all select match_id, "at", ledger, case when hold then ledger else plays end, case when hold then missing else '' end, case when hold then n else 0 end, gone, suspect, hold from (
    select *, suspect and n < 3 as hold from (select *, case when suspect then case when missing = sig then held + 1 else 1 end else 0 end as n from (
      select *, array_to_string(gone, ',') as missing, len(gone) > len(ledger) * 0.5 as suspect from (select f.match_id, r."at", f.ledger, f.sig, f.held, r.plays, list_sort(list_filter(f.ledger, lambda p: not list_contains(r.plays, p))) as gone from f join reads r on r.match_id = f.match_id and r."at" = f."at" + 1))))),
facts as (select match_id, "at", 'held' as action, null as play_id, len(gone) as sequence, 'provider_glitch_suspected' as reason from f where hold
  union all select match_id, "at", 'withdrawn', p, list_position(old, p), case when suspect then 'withdrawn_after_hold' else 'not_in_complete_read' end from (select *, unnest(gone) as p from f where not hold)
  union all select match_id, "at", case when list_contains(old, p) then 'resequenced' else 'added' end, p, list_position(ledger, p), null from (select *, unnest(ledger) as p from f where not hold) where not list_contains(old, p) or list_position(old, p) <> list_position(ledger, p))
select match_id, "at", action, play_id, cast(sequence as int) as sequence, reason from facts"""


def tracked(s, d):
    """Users' last events, kept by a stream of the table into a tracked table, exactly once."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    stream = s.readStream.schema(schema).parquet(f"{d}/events.parquet*").select("user_id", F.unix_micros(c("ts").cast("timestamp")).alias("at"), "event_id", "event_type")
    kept = upsert.TrackedTable(s, shared_folder(s, "tracked"), stream.schema, ["user_id"], "at")
    upsert.follow(stream, kept, shared_folder(s, "tracked-at"))
    return kept.rows()


def calibrated(s, d):
    """Forecasts beside what three plain calibrators make of them."""
    j = written(judged(s, d).select("match_id", "y", *[half_up(c(x), 6).alias(x) for x in cal.CLASSES]), "forecasts")  # read many times
    weighed = {"softer": [F.pow(c(x), F.lit(0.8)) for x in cal.CLASSES], "skewed": [c("home"), c("draw") * 1.9, c("away") * 0.7], "same": [c(x) for x in cal.CLASSES]}
    out = {}
    for name, w in weighed.items():
        whole = w[0] + w[1] + w[2]
        out[name] = j.select("match_id", "y", *[c(x).alias(f"raw_{x}") for x in cal.CLASSES], *[half_up(v / whole, 6).alias(f"cal_{x}") for x, v in zip(cal.CLASSES, w)])
    return out


def order_rules(s, d):
    each = [cal.order_kept(df).withColumn("method", F.lit(name)) for name, df in calibrated(s, d).items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


_r = lambda x, n=6: f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"
_fav = lambda t: f"case when {t}0 >= greatest({t}1, {t}2) then 0 when {t}1 >= {t}2 then 1 else 2 end"
ORDER_SQL = f"""select * from (with j as (select match_id, y, {_r("home")} as r0, {_r("draw")} as r1, {_r("away")} as r2 from judged),
w as (select j.*, method, case method when 'softer' then pow(r0, 0.8) else r0 end as w0, case method when 'softer' then pow(r1, 0.8) when 'skewed' then r1 * 1.9 else r1 end as w1, case method when 'softer' then pow(r2, 0.8) when 'skewed' then r2 * 0.7 else r2 end as w2 from j, (select unnest(['softer', 'skewed', 'same']) as method)),
x as (select method, match_id, y, r0, r1, r2, {", ".join(f"{_r(f'w{k} / (w0 + w1 + w2)')} as k{k}" for k in range(3))} from w),
long as (select method, k as class, match_id, y = k as hit, [r0, r1, r2][k + 1] as raw, [k0, k1, k2][k + 1] as cal from x, (select unnest([0, 1, 2]) as k)),
ranked as (select *, rank() over (partition by method, class order by raw) + (count(*) over (partition by method, class, raw) - 1) / 2 as rr, rank() over (partition by method, class order by cal) + (count(*) over (partition by method, class, cal) - 1) / 2 as rc from long),
by_class as (select method, class, {_r("(sum(rc) filter (where hit) - sum(rr) filter (where hit)) * 1.0e0 / count(*) filter (where hit) / count(*) filter (where not hit)", 5)} as d, {_r("corr(rr, rc)", 5)} as s from ranked group by all),
named as (select *, {_fav("r")} as rf, {_fav("k")} as kf, row_number() over (partition by method order by greatest(r0, r1, r2) desc, match_id) as rn, row_number() over (partition by method order by greatest(k0, k1, k2) desc, match_id) as kn, count(*) over (partition by method) as n from x),
o as (select method, count(*) as n, count(*) filter (where rf <> kf) as changes, {_r("avg((kf = y)::int) - avg((rf = y)::int)")} as d_favourite,
  {", ".join(f"{_r(_r(f'avg((kf = y)::int) filter (where kn <= floor(n * {s}))') + ' - ' + _r(f'avg((rf = y)::int) filter (where rn <= floor(n * {s}))'))} as d_top{int(s * 100)}" for s in cal.SHARES)} from named group by method),
both_ as (select o.*, most_d_auc, least_spearman from o join (select method, max(abs(d)) as most_d_auc, min(s) as least_spearman from by_class group by all) using (method))
select *, most_d_auc < 0.005 and least_spearman >= 0.99 as k5, changes <= 0.02 * n and abs(d_favourite) < 0.01 and d_top10 >= -0.02 and d_top20 >= -0.02 as k6 from both_)"""


CUTOFF = 10200


def lists(s, d):
    """Each order's parts in line order, and what the array helpers say of them."""
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_partkey"] % 7).alias("a"), F.array_sort(F.collect_set(key("l_suppkey", 7))).alias("b"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return lines.select(
        "l_orderkey", text(F.array_distinct("a")).alias("distinct"), F.array_contains("a", 3).alias("has_three"), text(F.slice("a", 1, 2)).alias("first_two"), F.try_element_at("a", F.lit(-1)).alias("last"), text(F.array_sort(F.array_intersect("a", "b"))).alias("shared"),
        text(F.array_sort(F.array_except("a", "b"))).alias("only_a"), F.arrays_overlap("a", "b").alias("overlap"), F.size(F.array_union("a", "b")).alias("n_either"), F.array_position("a", 3).alias("at_three"), F.forall("a", lambda x: x < 6).alias("all_small"), F.exists("a", lambda x: x == 6).alias("any_six"),
    )


_csv = lambda x: f"array_to_string(list_transform({x}, lambda v: cast(v as varchar)), ',')"
LISTS_SQL = f"""with l as (select l_orderkey, list(l_partkey % 7 order by l_linenumber, l_partkey, l_suppkey) as a, list_sort(list_distinct(list(l_suppkey % 7))) as b from lineitem group by all)
select l_orderkey, {_csv("list_filter(a, lambda x, i: list_position(a, x) = i)")} as "distinct", list_contains(a, 3) as has_three, {_csv("a[1:2]")} as first_two, a[-1] as last, {_csv("list_sort(list_distinct(list_filter(a, lambda x: list_contains(b, x))))")} as shared,
  {_csv("list_sort(list_distinct(list_filter(a, lambda x: not list_contains(b, x))))")} as only_a, len(list_filter(a, lambda x: list_contains(b, x))) > 0 as overlap, cast(len(list_distinct(list_concat(a, b))) as int) as n_either, cast(coalesce(list_position(a, 3), 0) as bigint) as at_three,
  len(list_filter(a, lambda x: x >= 6)) = 0 as all_small, len(list_filter(a, lambda x: x = 6)) > 0 as any_six from l"""

QUERIES = {
    "fn33_array_helpers": (lists, LISTS_SQL),
    "pr1_season_inputs": (
        lambda s, d: assembly.season_inputs(matches(s, d), ledger(s, d), CUTOFF),
        sql(f"""select competition_id, season, count(*) as matches, min(day) as first_day, max(day) as cutoff, count(goals) as with_events, cast(coalesce(sum(goals), 0) as bigint) as goals, cast(coalesce(sum(own_goals), 0) as bigint) as own_goals, cast(coalesce(sum(shots), 0) as bigint) as shots, cast(coalesce(sum(cards), 0) as bigint) as cards
  from matches left join (select match_id, count(*) filter (where is_goal) as goals, count(*) filter (where is_own_goal) as own_goals, count(*) filter (where event_type = 'shot') as shots, count(card) as cards from ledger where is_goal or is_own_goal or event_type = 'shot' or card is not null group by all) using (match_id)
  where status = 'finished' and day < {CUTOFF} group by all""", M, L),  # a match of this ledger has one family; tests/test_depth.py mixes them
    ),
    "src2_keyset_pages": (paged, "select o_orderkey, p // 100 as page, p % 100 as at from (select o_orderkey, row_number() over (order by o_totalprice nulls first, o_orderkey) - 1 as p from orders)"),
    "src2_page_and_cursor": (
        two_pages,
        "select 'page' as by, o_orderkey from (from orders order by o_totalprice nulls first, o_orderkey limit 40 offset 120) union all select 'cursor', o_orderkey from (from orders where o_totalprice > 150000 or (o_totalprice = 150000 and o_orderkey > 0) order by o_totalprice, o_orderkey limit 40)",
    ),
    "src9_play_by_play": (lambda s, d: pbp.play_rows(captures(s, d)), PLAYS_SQL),
    "src18_registry": (registry_rows, REGISTRY_SQL),
    "fn30_variant_leaks": (
        lambda s, d: v.denied(packets(s, d), "event_id", "packet"),
        "select event_id as key, '$.inner.closing_line' as path from events where event_id % 10 = 0 union all select event_id, unnest(['$.inner[1].deep.matchOdds', '$.inner[1].deep.matchOdds[0].price']) from events where event_id % 10 = 1",
    ),
    "fn32_variant_paths": (
        lambda s, d: packets(s, d).select("event_id", v.at(c("packet"), "$.props.k", "long").alias("k"), v.at(c("packet"), "$.inner[1].deep.matchOdds[0].price", "int").alias("price"), v.at(c("packet"), "$.inner.note", "string").alias("note")),
        "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, case when event_id % 10 = 1 then cast(event_id as int) end as price, case when event_id % 10 > 1 then 'the odds are in a text' end as note from events",
    ),
    "ing4_variant_changes": (
        lambda s, d: v.changed(states(s, d, False), states(s, d, True), "key", "body"),
        """select c_custkey as key, 'segment' as name, '"' || c_mktsegment || '"' as old_value, '"NEW"' as new_value from customer where c_custkey % 5 = 0
  union all select c_custkey, 'tags', '{"a":' || c_custkey || ',"b":[1,2]}', '{"a":' || (c_custkey + 1) || ',"b":[1,2]}' from customer where c_custkey % 9 = 0""",
    ),
    "str7_final_checks": (
        finals,
        sql("""select match_id, count(p) as reads, case when count(p) = 0 then 'missing' when arg_max(home, (p, home)) = max(h0) then 'agrees' else 'differs' end as result from (
  select m.match_id, m.home_score as h0, l_partkey % 400 - 200 as p, m.home_score + case when l_suppkey % 5 = 0 then 1 else 0 end as home from matches m left join lineitem on l_orderkey = match_id and l_partkey % 400 - 200 between -180 and 180 where status = 'finished') group by match_id""", M),  # fmt: skip
    ),
    "str8_glitch_hold": (lambda s, d: reconcile.folded_corrections(ledger_reads(s, d)), LEDGER_SQL),
    "src14_tracked_stream": (
        tracked,
        "select user_id, epoch_us(ts) as at, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1",
    ),
    "xt18_order_rules": (order_rules, sql(ORDER_SQL, M, TM, STRENGTH)),
}
