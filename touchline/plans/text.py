"""Queries of functions, text gates, quality rules and live windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as x
from ..operators import gates as g
from ..operators import quality as q
from ..operators import results as r
from ..operators import text as t
from ..sources.tables import SQL_LEDGER as L
from ..sources.tables import SQL_MATCHES as M
from ..sources.tables import SQL_TEAM_MATCH as TM
from ..sources.tables import ledger, matches, sql, table
from ..streaming import live

c = F.col


def geometry(s, d):
    e = ledger(s, d).where("x_m is not null")
    home = c("team_id") == c("home_team_id")
    ax, ay = x.attacking(c("x_m"), c("y_m"), home)
    return e.select("match_id", "sequence", ax.alias("ax"), ay.alias("ay"), x.goal_distance(ax, ay).alias("distance"), x.in_area(ax, ay).alias("in_area"), x.third(ax).alias("third"), x.channel(ay).alias("channel"))


def provider_places(s, d):
    p = table(s, d, "part").select("p_partkey", (c("p_size") * 3.0 - 5).alias("px"), (c("p_partkey") % 120).cast("double").alias("py"))
    fx, fy = x.to_pitch(c("px"), c("py"), 100.0, 100.0)
    bx, by = x.from_pitch(c("cx"), c("cy"), 100.0, 100.0)
    return p.select("p_partkey", fx.alias("cx"), fy.alias("cy")).select("p_partkey", x.half_up(c("cx"), 4).alias("cx"), x.half_up(c("cy"), 4).alias("cy"), x.half_up(bx, 4).alias("bx"), x.half_up(by, 4).alias("by"))


def clocks(s, d):
    p = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (c("l_partkey") * 7 % 3200).alias("sec"), F.when(c("l_suppkey") % 2 == 0, 45).otherwise(0).alias("start"))
    minute = x.football_minute(c("sec"), c("start"))
    return p.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", minute.alias("minute"), x.shown_minute(minute, (c("start") + 45).cast("int")).alias("shown"), x.phase(minute).alias("phase"))


def labels(s, d):
    m = matches(s, d)
    day = c("kickoff_at").cast("date")
    return m.select("match_id", x.iso_week(day).alias("week"), x.season_label(c("season"), c("season") + c("match_id").cast("int") % 2).alias("label"), x.winner(c("home_team_id"), c("away_team_id"), c("home_score"), c("away_score")).alias("winner"))


def ids(s, d):
    n = table(s, d, "customer")
    return n.select("c_custkey", x.uuid5("6ba7b8109dad11d180b400c04fd430c8", c("c_name")).alias("uuid"), x.slug(F.concat(c("c_name"), F.lit(" Müller & Söhne!"))).alias("slug"), F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256).alias("hash"))


def urls(s, d):
    return table(s, d, "pages").select("page_id", x.normal_url(F.concat("url", F.lit("#top"))).alias("url"))


def articles(s, d):
    return table(s, d, "documents").select(c("doc_id").alias("id"), "text")


def written(s, d):
    """Texts with a phrase of each rule put at the end of some."""
    ends = ["", " he Said so", " a Hamstring", " rumoured", " the odds", " HISTORICAL", " frustration", " an xG of one", " possession", " a game of two halves", " saidso unsaid"]
    return articles(s, d).select("id", F.concat("text", F.element_at(F.array(*[F.lit(e) for e in ends]), (c("id") % 11 + 1).cast("int"))).alias("text"))


#: Ends of texts, of which some break a rule of a kind or profile.
ENDS = ["", "who will win the cup", "top four", "a relegation fight", "the Western Conference", "playoff spots", "in the standings", "through to the last 16", "European places", "promoted at last", "top of their group", "quarter-final hopes", "a club", "possession", "play-offs ahead", "team news"]
ZONES = ["Promotion to League A", "Quarter-finals", "Relegation play-off"]


def gate_articles(s, d):
    k = c("id")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    ended = articles(s, d).select("id", F.concat_ws(" ", "text", pick(ENDS, k % len(ENDS))).alias("text"))
    return ended.select(
        "id", "text", F.when(k % 3 == 0, "match_preview").otherwise("match_recap").alias("kind"), pick(list(g.PROFILES), F.floor(k / 2) % len(g.PROFILES)).alias("profile"), (k % 5 < 2).alias("verified"),
        F.array(pick(ZONES, k % len(ZONES))).alias("zones"), (k % 7 == 0).alias("possession"),
    )


GATE_ARTICLES = f"""select doc_id as id, concat_ws(' ', text, {ENDS}[doc_id % {len(ENDS)} + 1]) as text, doc_id % 3 = 0 as preview, {list(g.PROFILES)}[doc_id // 2 % {len(g.PROFILES)} + 1] as profile, doc_id % 5 < 2 as verified, {ZONES}[doc_id % {len(ZONES)} + 1] as zone, doc_id % 7 = 0 as possession from documents"""
_said = lambda pattern, of="text": f"regexp_matches({of}, '{pattern}')"
_gate = lambda name, when: f"case when {when} then '{name}' end"
_gate_rules = [_gate(k, _said(v) + (" and not possession" if k == "unsupported_possession" else "")) for k, v in t.BANNED.items()]
_gate_rules += [_gate(k, f"profile = '{of}' and {_said(v)}" + (" and not verified" if k in g.LIFTED else "")) for of, rules in g.PROFILES.items() for k, v in rules.items()]
_gate_rules += [_gate(k, f"preview and {_said(v)}") for k, v in g.PREVIEW.items()]
_gate_rules += [_gate(k, f"profile = '{of}' and {_said(v)} and not (verified" + (f" and {_said(z, 'zone')})" if z else ")")) for of, rules in g.CLAIMS.items() for k, (v, z) in rules.items()]


def grounded(s, d):
    packets = articles(s, d).where("id % 2 = 0").select((c("id") + 1).alias("id"), "text").unionByName(articles(s, d).where("id % 10 = 0"))
    return t.ungrounded_numbers(articles(s, d), packets)


def articles_of_events(s, d):
    """Articles of five events each, with a desk and a day, and what they name."""
    e = table(s, d, "events").withColumn("id", F.floor(c("event_id") / 5))
    meta = e.groupBy("id").agg(F.min("event_type").alias("desk"), F.max(F.datediff(c("ts").cast("date"), F.lit("2024-01-01").cast("date"))).cast("long").alias("day"))
    kinds = F.array(*[F.struct(F.lit(k).alias("type"), v.cast("long").alias("entity")) for k, v in (("Person", c("user_id")), ("SportsEvent", F.floor(c("value"))), ("SportsTeam", c("user_id") % 20))])
    return meta, e.select("id", F.explode(kinds).alias("k")).select("id", "k.*")


def calls(s, d):
    return table(s, d, "events").select(c("event_type").alias("trigger"), (c("user_id") % 3).cast("string").alias("lane"), (c("user_id") % 2).cast("string").alias("model"), F.when(c("event_id") % 5 == 0, "premium").otherwise("shared").alias("pool"), (c("event_id") % 97).cast("string").alias("story"), F.floor(c("value")).cast("long").alias("tokens_in"), F.floor(c("value") * 2).cast("long").alias("tokens_out"))


def finished_halves(s, d):
    """All finished matches, with half-time scores made of their ids."""
    m = matches(s, d).where("status = 'finished'")
    return m.withColumn("home_score_ht", F.when(c("match_id") % 3 == 0, F.lit(0))).withColumn("away_score_ht", F.when(c("match_id") % 3 == 0, F.least(F.lit(1), c("away_score"))))


def scorers(s, d):
    return ledger(s, d).where("is_goal").groupBy("match_id", "player_id").agg(F.count("*").alias("goals"))


def material(s, d):
    return t.materiality(finished_halves(s, d), r.team_match(matches(s, d)), scorers(s, d))


MATERIAL = """
dayrows as (select competition_id, season, team_id, day, sum(points) as p, sum(gf - ga) as d, sum(gf) as g, count(*) as n from team_match group by all),
totals as (select competition_id, season, team_id, day as since, lead(day) over w as until, sum(p) over u as p, sum(d) over u as d, sum(g) over u as g, sum(n) over u as n from dayrows window w as (partition by competition_id, season, team_id order by day), u as (partition by competition_id, season, team_id order by day rows unbounded preceding)),
games as (select match_id, competition_id, season, day, home_team_id as h, away_team_id as w, home_score as hs, away_score as ws, case when match_id % 3 = 0 then 0 end as hht, case when match_id % 3 = 0 then least(1, away_score) end as wht from matches where status = 'finished'),
known as (select match_id, h, w, hs, ws, team_id, p, d, g, n from games join totals using (competition_id, season) where day > since and (until is null or day <= until)),
every_ as (select * from known union all select match_id, h, w, hs, ws, team, 0, 0, 0, 0 from (select *, unnest([h, w]) as team from games) x where not exists (select 1 from known k where k.match_id = x.match_id and k.team_id = team)),
after_ as (select *, case when team_id = h then hs - ws when team_id = w then ws - hs end as dm from every_),
placed as (select *, p + case when dm > 0 then 3 when dm = 0 then 1 else 0 end as p2, case when n > 0 then row_number() over (partition by match_id order by n > 0 desc, p desc, d desc, g desc, team_id) end as b,
  row_number() over (partition by match_id order by p + case when dm > 0 then 3 when dm = 0 then 1 else 0 end desc, d + coalesce(dm, 0) desc, g + case when team_id = h then hs when team_id = w then ws else 0 end desc, team_id) as a from after_),
tables as (select match_id, count(*) as teams, max(team_id) filter (where b = 1) as t1b, max(team_id) filter (where b = 2) as t2b, max(team_id) filter (where a = 1) as t1a, max(team_id) filter (where a = 2) as t2a, max(p) filter (where b = 1) as p1b, max(p) filter (where b = 2) as p2b, max(p2) filter (where a = 1) as p1a, max(p2) filter (where a = 2) as p2a,
  max(b) filter (where team_id = h) as hb, max(a) filter (where team_id = h) as ha, max(n) filter (where team_id = h) as hn, max(b) filter (where team_id = w) as wb, max(a) filter (where team_id = w) as wa, max(n) filter (where team_id = w) as wn from placed group by all),
numbered as (select *, row_number() over (partition by competition_id, season, team_id order by day, match_id) as k from team_match),
runs as (select match_id, team_id, count(*) over e - coalesce(max(case when points < 3 then k end) over e, 0) as wins, count(*) over e - coalesce(max(case when points = 0 then k end) over e, 0) as unb from numbered window e as (partition by competition_id, season, team_id order by day range between unbounded preceding and 1 preceding)),
scored as (select match_id, list_sort(list(goals)) as many from (select match_id, player_id, count(*) as goals from ledger where is_goal group by all) where goals >= 2 group by all),
whole as (select g.*, t.* exclude (match_id), greatest(hn, wn) + 1 as md, many, x.wins as hwins, y.wins as wwins, x.unb as hunb, y.unb as wunb from games g join tables t using (match_id) left join scored using (match_id) left join runs x on x.match_id = g.match_id and x.team_id = h left join runs y on y.match_id = g.match_id and y.team_id = w)"""
RULES = {"positive quantity": "l_quantity > 0", "discount range": "l_discount between 0 and 0.05", "known flag": "l_returnflag in ('A', 'N', 'R')", "line number": "l_linenumber between 1 and 6", "tax": "l_tax <= 0.08"}
AT = "2024-01-15 00:00:00"


def references(s, d):
    get = lambda n: table(s, d, n)
    return q.references({
        "lineitem to orders": (get("lineitem"), get("orders"), "l_orderkey", "o_orderkey"),
        "orders to customer": (get("orders"), get("customer"), "o_custkey", "c_custkey"),
        "labels to documents": (get("labels"), get("documents").where("doc_id % 5 <> 0"), "doc_id", "doc_id"),
    })


def freeze(s, d):
    old = matches(s, d).select("match_id", "day", "home_score")
    new = old.where("match_id % 101 <> 0").withColumn("day", F.when(c("match_id") % 103 == 0, c("day") + 1).otherwise(c("day"))).withColumn("home_score", F.when(c("match_id") % 107 == 0, F.lit(9)).otherwise(c("home_score")))
    return q.frozen(old, new, "match_id", ["day"], ["home_score"])


def events(s, d):
    return table(s, d, "events")


S = lambda body: sql(body, M, TM)
AX, AY = "case when team_id = home_team_id then x_m else 105.0 - x_m end", "case when team_id = home_team_id then y_m else 68.0 - y_m end"


def micros(df, *names):
    """Timestamps as microseconds, the same in any engine."""
    return df.select(*[F.unix_micros(c(n).cast("timestamp")).alias(n) if n in names else c(n) for n in df.columns])


QUERIES = {
    "fn2_fn4_provider_places": (
        provider_places,
        """select p_partkey, floor(cx * 1e4 + 0.5) / 1e4 as cx, floor(cy * 1e4 + 0.5) / 1e4 as cy, floor(cx / 105.0 * 100.0 * 1e4 + 0.5) / 1e4 as bx, floor(cy / 68.0 * 100.0 * 1e4 + 0.5) / 1e4 as by from (select p_partkey,
  case when ok then px / 100.0e0 * 105.0e0 end as cx, case when ok then py / 100.0e0 * 68.0e0 end as cy from (select *, px between 0 and 100 and py between 0 and 100 as ok from (select p_partkey, cast(p_size * 3.0 - 5 as double) as px, cast(p_partkey % 120 as double) as py from part)))""",
    ),
    "fn3_fn6_fn7_fn8_geometry": (
        geometry,
        sql(f"""select match_id, sequence, ax, ay, floor(sqrt((105.0 - ax) * (105.0 - ax) + (34.0 - ay) * (34.0 - ay)) * 10 + 0.5) / 10 as distance, ax >= 88.5 and abs(ay - 34.0) <= 20.16 as in_area, case when ax < 35 then 'defensive' when ax < 70 then 'middle' else 'final' end as third,
  case when ay < 22.67 then 'right' when ay > 45.33 then 'left' else 'centre' end as channel from (select match_id, sequence, cast({AX} as double) as ax, cast({AY} as double) as ay from ledger where x_m is not null)""", M, L),  # fmt: skip
    ),
    "fn9_fn10_clock": (
        clocks,
        """select l_orderkey, l_linenumber, l_partkey, l_suppkey, minute, case when minute > start + 45 then (start + 45) || '+' || (minute - start - 45) || '''' else minute || '''' end as shown, case when minute <= 15 then '01-15' when minute <= 30 then '16-30'
  when minute <= 45 then '31-45' when minute <= 60 then '46-60' when minute <= 75 then '61-75' else '76-90' end as phase from (select *, cast(l_partkey * 7 % 3200 // 60 + 1 + start as int) as minute from (select *, case when l_suppkey % 2 = 0 then 45 else 0 end as start from lineitem))""",
    ),
    "fn15_fn17_fn20_labels": (
        labels,
        S("""select match_id, isoyear(kickoff_at) || '-W' || lpad(cast(week(kickoff_at) as varchar), 2, '0') as week, case when match_id % 2 = 0 then cast(season as varchar) else season || '/' || lpad(cast((season + 1) % 100 as varchar), 2, '0') end as label,
  case when home_score > away_score then home_team_id when away_score > home_score then away_team_id end as winner from matches"""),
    ),
    "ing8_ing9_ing11_ids": (ids, None),
    "src13_urls": (urls, "select page_id, split_part(u, '?', 1) || case when contains(u, '?') then '?' || array_to_string(list_sort(string_split(split_part(u, '?', 2), '&')), '&') else '' end as url from (select page_id, split_part(url, '#', 1) as u from pages)"),
    "fn27_tx8_grounding": (
        grounded,
        r"""with n as (select doc_id as id, list_distinct(regexp_extract_all(text, '\d+(?:\.\d+)?')) as l from documents), p as (select id + 1 as id, l from n where id % 2 = 0 union all select id, l from n where id % 10 = 0)
select n.id, len(n.l) as stated, len(list_filter(n.l, lambda x: not list_contains(coalesce(p.l, []), x))) as missing, len(list_filter(n.l, lambda x: not list_contains(coalesce(p.l, []), x))) = 0 as passes from n left join p using (id)""",
    ),
    "fn28_tx10_phrases": (
        lambda s, d: t.phrase_hits(written(s, d)),
        "select id, array_to_string(l, ',') as rules, len(l) as n from (select id, list_filter([" + ", ".join(f"case when regexp_matches(text, '{p}') then '{name}' end" for name, p in t.BANNED.items())
        + "], lambda x: x is not null) as l from (select doc_id as id, text || list_extract(['', ' he Said so', ' a Hamstring', ' rumoured', ' the odds', ' HISTORICAL', ' frustration', ' an xG of one', ' possession', ' a game of two halves', ' saidso unsaid'], cast(doc_id % 11 + 1 as int)) as text from documents)) where len(l) > 0",
    ),
    "fn28_tx10_profile_gates": (
        lambda s, d: g.gated(gate_articles(s, d)),
        f"select id, array_to_string(l, ',') as failed, len(l) = 0 as passes from (select id, list_filter([{', '.join(_gate_rules)}], lambda x: x is not null) as l from ({GATE_ARTICLES}))",
    ),
    "jn19_tk7_related": (
        lambda s, d: t.related(*articles_of_events(s, d)),
        """with ev as (select *, event_id // 5 as id from events), meta as (select id, min(event_type) as desk, max(date_diff('day', date '2024-01-01', cast(ts as date))) as day from ev group by all),
named as (select distinct id, type, entity, weight from (select id, unnest(['Person', 'SportsEvent', 'SportsTeam']) as type, unnest([user_id, cast(floor(value) as bigint), user_id % 20]) as entity, unnest([60, 40, 26]) as weight from ev)),
offered as (from meta order by day desc, id desc limit 200),
shared as (select a.id, b.id as other, sum(a.weight) as shared from named a join named b using (type, entity) where b.id in (select id from offered) and a.id <> b.id group by all),
scored as (select s.id, other, o.day as other_day, cast(shared + case when m.desk = o.desk then 4 else 0 end + case when abs(m.day - o.day) <= 1 then 12 when abs(m.day - o.day) <= 3 then 9 when abs(m.day - o.day) <= 7 then 6 else 0 end as bigint) as score
  from shared s join offered o on other = o.id join meta m on s.id = m.id)
select id, other, score, place from (select *, cast(row_number() over (partition by id order by score desc, other_day desc, other desc) as int) as place from scored where score >= 26) where place <= 4""",
    ),
    "id16_alias_index": (
        lambda s, d: t.alias_index(
            table(s, d, "part").select(c("p_partkey").alias("entity"), F.concat(F.lit("FC "), "p_name", F.lit(" "), "p_type", c("p_size").cast("string")).alias("name"), F.concat("p_name", F.lit("-"), c("p_size").cast("string")).alias("short")),
            table(s, d, "part").select(c("p_partkey").alias("entity"), F.concat("p_brand", F.lit("/"), "p_name", F.lit("/"), "p_type").alias("alias")),
        ),
        """with w as (select p_partkey as entity, regexp_split_to_array(lower(p_name || ' ' || p_type || p_size), '[^a-z0-9]+') as words, regexp_replace(lower(p_name || '-' || p_size), '[^a-z0-9]+', ' ', 'g') as short, regexp_replace(lower(p_brand || '/' || p_name || '/' || p_type), '[^a-z0-9]+', ' ', 'g') as other from part),
each as (select entity, 'fc ' || array_to_string(words, ' ') as alias from w union all select entity, array_to_string(words, ' ') from w union all select entity, short from w union all select entity, other from w union all select entity, unnest(list_filter(words, lambda x: length(x) >= 4)) from w)
select alias, min(entity) as entity from each where alias <> '' group by alias having count(distinct entity) = 1""",
    ),
    "jn20_longest_alias": (
        lambda s, d: t.longest_alias(table(s, d, "pages").select(c("page_id").alias("id"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title")), table(s, d, "nation").select(F.lower("n_name").alias("alias"), c("n_nationkey").alias("entity")).unionByName(s.createDataFrame([("the", 900), ("the and", 901), ("der", 902)], "alias string, entity int"))),
        None,
    ),
    "id17_video_kinds": (lambda s, d: table(s, d, "pages").groupBy(t.classify(c("html")).alias("kind")).agg(F.count("*").alias("n")), """select case when lower(html) similar to '(.|\n)*(press conference|pressekonferenz)(.|\n)*' then 'press' when lower(html) similar to '(.|\n)*(highlights|zusammenfassung)(.|\n)*' then 'highlights'
  when lower(html) similar to '(.|\n)*(goals?|tore?)(.|\n)*' then 'goals' when lower(html) similar to '(.|\n)*(recap|spielbericht)(.|\n)*' then 'recap' when lower(html) similar to '(.|\n)*(interview|reacts|mixed zone)(.|\n)*' then 'interview' when lower(html) similar to '(.|\n)*(preview|vorschau)(.|\n)*' then 'preview'
  when lower(html) similar to '(.|\n)*(analysis|tactical|breakdown|explained)(.|\n)*' then 'analysis' else 'other' end as kind, count(*) as n from pages group by all"""),
    "ag23_fn31_cost_report": (
        lambda s, d: t.cost_report(calls(s, d)),
        """select trigger, lane, pool, model, story, count(*) as calls, cast(sum(i + o) as bigint) as tokens, floor(sum((i * 2.5e0 + o * 10.0e0) / 1e6) * 1e6 + 0.5) / 1e6 as usd from (select event_type as trigger, cast(user_id % 3 as varchar) as lane, cast(user_id % 2 as varchar) as model, case when event_id % 5 = 0 then 'premium' else 'shared' end as pool, cast(event_id % 97 as varchar) as story,
  cast(floor(value) as bigint) as i, cast(floor(value * 2) as bigint) as o from events) group by grouping sets ((), (trigger), (lane), (pool), (model), (story))""",
    ),
    "tx1_materiality": (
        material,
        sql("""select match_id, array_to_string(list_concat(l, [x for x in list_transform(coalesce(many, []), lambda n: 'multi_goal_scorer')]), ',') as angles, score, score >= 1.0 as material from (select *, floor((list_sum(list_concat([0.0e0], list_transform(l, lambda x: case x when 'leader_change' then 1.2e0 when 'top4_entry_exit' then 0.8e0 when 'relegation_zone_move' then 0.8e0 when 'high_scoring' then 0.6e0 when 'heavy_margin' then 0.6e0 else 1.0e0 end),
  list_transform(coalesce(many, []), lambda n: case when n >= 3 then 1.2e0 else 0.6e0 end)))) * 100 + 0.5) / 100 as score from (select match_id, many, list_filter([case when t1b is not null and t1b <> t1a and t1a in (h, w) and md >= 3 then 'leader_change' end,
  case when md >= 10 and t2b is not null and (t1b in (h, w) or t2b in (h, w) or t1a in (h, w) or t2a in (h, w)) and abs((p1a - p2a) - (p1b - p2b)) >= 3 then 'title_race_swing' end,
  case when hb is not null and md >= 5 and (hb <= 4) <> (ha <= 4) then 'top4_entry_exit' end, case when wb is not null and md >= 5 and (wb <= 4) <> (wa <= 4) then 'top4_entry_exit' end,
  case when hb is not null and md >= 5 and (hb between teams - 2 and teams) <> (ha between teams - 2 and teams) then 'relegation_zone_move' end, case when wb is not null and md >= 5 and (wb between teams - 2 and teams) <> (wa between teams - 2 and teams) then 'relegation_zone_move' end,
  case when md > 5 and case when hs > ws then hb - wb when hs < ws then wb - hb end >= 8 then 'upset' end, case when case when hs > ws then hht - wht when hs < ws then wht - hht end < 0 then 'comeback_from_ht' end,
  case when case when hs > ws then hwins when hs < ws then wwins end + 1 >= 5 then 'winning_streak' end, case when case when hs > ws then wunb when hs < ws then hunb end >= 8 then 'unbeaten_run_ended' end,
  case when hs + ws >= 6 then 'high_scoring' end, case when abs(hs - ws) >= 4 then 'heavy_margin' end], lambda x: x is not null) as l from whole))""".replace("[x for x in list_transform(coalesce(many, []), lambda n: 'multi_goal_scorer')]", "list_transform(coalesce(many, []), lambda n: 'multi_goal_scorer')"), M, TM, L, MATERIAL),  # fmt: skip
    ),
    "tx3_stories": (
        lambda s, d: t.stories(r.trailing_runs(r.team_match(matches(s, d)), "team_id"), r.form(r.team_match(matches(s, d)), keys=("team_id",))),
        S("""select team_id, array_to_string(l, ',') as angles, floor((list_sum(list_concat([0.0e0], list_transform(l, lambda x: case x when 'winning run' then 1.0e0 when 'losing run' then 0.8e0 when 'unbeaten run' then 0.7e0 else 0.4e0 end)))) * 100 + 0.5) / 100 as weight, list_sum(list_concat([0.0e0], list_transform(l, lambda x: case x when 'winning run' then 1.0e0 when 'losing run' then 0.8e0 when 'unbeaten run' then 0.7e0 else 0.4e0 end))) >= 1.0 as material from (
  select team_id, list_filter([case when winning >= 3 then 'winning run' end, case when losing >= 3 then 'losing run' end, case when unbeaten >= 6 and winning < 3 then 'unbeaten run' end, case when regexp_matches(form, '^W.*L$') then 'turnaround' end], lambda x: x is not null) as l from (select team_id, coalesce(min(k) filter (where points < 3) - 1, max(k)) as winning, coalesce(min(k) filter (where points = 0) - 1, max(k)) as unbeaten,
  coalesce(min(k) filter (where points > 0) - 1, max(k)) as losing, string_agg(case points when 3 then 'W' when 1 then 'D' else 'L' end, '' order by k) filter (where k <= 5) as form from (select *, row_number() over (partition by team_id order by day desc, match_id desc) as k from team_match) group by all))"""),
    ),
    "dq1_violations": (
        lambda s, d: q.violations(table(s, d, "lineitem"), "l_orderkey", RULES).groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys")),
        "select rule, count(*) as n, count(distinct l_orderkey) as keys from (" + " union all ".join(f"select '{k}' as rule, l_orderkey from lineitem where not coalesce({p}, false)" for k, p in RULES.items()) + ") group by all",
    ),
    "dq2_dq7_summary": (lambda s, d: q.summary(table(s, d, "lineitem"), RULES), "select rule, broken, broken = 0 as passed from (" + " union all ".join(f"select '{k}' as rule, count(*) filter (where not coalesce({p}, false)) as broken from lineitem" for k, p in RULES.items()) + ")"),
    "dq9_dq10_frozen": (
        freeze,
        S("""select match_id, 'removed' as breach from matches where match_id % 101 = 0 union all select match_id, 'day changed' from matches where match_id % 101 <> 0 and match_id % 103 = 0
  union all select match_id, 'home_score rewritten' from matches where match_id % 101 <> 0 and match_id % 107 = 0 and home_score is not null"""),
    ),
    "dq12_references": (
        references,
        """select 'lineitem to orders' as reference, count(distinct l_orderkey) as keys, count(*) as n_rows from lineitem where l_orderkey not in (select o_orderkey from orders) union all
select 'orders to customer', count(distinct o_custkey), count(*) from orders where o_custkey not in (select c_custkey from customer) union all
select 'labels to documents', count(distinct doc_id), count(*) from labels where doc_id not in (select doc_id from documents where doc_id % 5 <> 0)""",
    ),
    "str4_deduplicated": (lambda s, d: live.deduplicated(events(s, d).unionByName(events(s, d).where("event_id % 3 = 0"))).groupBy("event_type").agg(F.count("*").alias("n")), "select event_type, count(*) as n from events group by all"),
    "str8_retractions": (
        lambda s, d: live.standing(live.retractions(events(s, d).withColumn("withdrawn", c("event_id") % 97 == 0).withColumn("value", F.floor("value")))),
        "select user_id, cast(count(*) filter (where event_id % 97 <> 0) as bigint) as n, cast(sum(case when event_id % 97 <> 0 then floor(value) else 0 end) as bigint) as value from events group by all",
    ),
    "str9_breaker": (
        lambda s, d: live.breaker(events(s, d).select(c("user_id").alias("provider"), c("event_id").alias("at"), (c("value") > 60).alias("ok"))),
        "select user_id as provider, event_id as at, value > 60 as ok, sum((value <= 60)::int) over (partition by user_id order by event_id rows between 2 preceding and current row) = 3 as open from events",
    ),
    "str9_waits": (
        lambda s, d: live.waits(events(s, d).select(c("user_id").alias("provider"), (c("event_id") * 60).alias("at"), F.when(c("event_id") % 41 == 0, "blocked").when(c("value") > 60, "ok").otherwise("failed").alias("outcome"))),
        """select provider, "at", outcome, until, coalesce("at" < max(until) over (partition by provider order by "at" rows between unbounded preceding and 1 preceding), false) as early from (select *, case when outcome = 'blocked' then "at" + 3600 when sum((outcome <> 'ok')::int) over (partition by provider order by "at" rows between 2 preceding and current row) = 3 then "at" + 300 end as until
  from (select user_id as provider, event_id * 60 as "at", case when event_id % 41 = 0 then 'blocked' when value > 60 then 'ok' else 'failed' end as outcome from events))""",
    ),
    "str10_stale": (
        lambda s, d: live.stale(events(s, d), AT, 600),
        f"select user_id, cast(floor((epoch_us(timestamp '{AT}') - epoch_us(max(ts))) / 60e6) as bigint) as age_minutes, (epoch_us(timestamp '{AT}') - epoch_us(max(ts))) / 60e6 > 600 as delayed from events group by all",
    ),
    "str14_xt8_wn26_state_at": (
        lambda s, d: live.state_at(events(s, d), AT),
        f"select user_id, count(*) as n, arg_max(event_type, epoch_us(ts)::hugeint * 1000000 + event_id) as last_type, arg_max(value, epoch_us(ts)::hugeint * 1000000 + event_id) as last_value from events where ts <= timestamp '{AT}' group by all",
    ),
    "str16_tumbling": (
        lambda s, d: micros(live.tumbling(events(s, d)).withColumn("value", x.half_up(c("value"), 4)), "start"),
        "select epoch_us(time_bucket(interval 1 hour, ts)) as start, event_type, count(*) as n, floor(sum(value) * 1e4 + 0.5) / 1e4 as value from events group by all",
    ),
    "str16_sliding": (
        lambda s, d: micros(live.sliding(events(s, d)), "start"),
        "select start, count(*) as n from (select epoch_us(time_bucket(interval 1 hour, ts)) - unnest([0, 3600000000]) as start from events) group by all",
    ),
    "str16_sessions": (
        lambda s, d: micros(live.sessions(events(s, d)), "start"),
        """select user_id, min(t) as start, count(*) as n from (select *, sum(fresh) over (partition by user_id order by t) as g from (select user_id, epoch_us(ts) as t, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 1800000000 then 0 else 1 end as fresh from events)) group by user_id, g""",
    ),
}
