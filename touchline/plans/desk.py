"""Queries of the news desk, media and the live lane, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import desk as k
from ..operators import results as r
from ..sources.tables import SQL_LEDGER as L
from ..sources.tables import SQL_MATCHES as M
from ..sources.tables import SQL_TEAM_MATCH as TM
from ..sources.tables import ledger, matches, sql, table
from .ingest import standings
from .results import table_sql

c = F.col
NOW = 10227
S = lambda body, *more: sql(body, M, TM, *more)


def q():
    return c("match_id")


VERIFIED = "(select competition_id, season, season <> 1997 or not bool_or(team_id = 3) as verified from team_match group by competition_id, season)"


def parts(s, d):
    state = F.element_at(F.array(*[F.lit(x) for x in ("complete", "empty", "unavailable", "not_applicable", "complete")]), (c("l_partkey") % 5 + 1).cast("int"))
    rows = table(s, d, "lineitem").select(c("l_orderkey").alias("match_id"), state.alias("status"), F.when(c("l_suppkey") % 3 == 0, c("l_suppkey")).alias("retry_at"))
    return k.recap_ready(matches(s, d).where("status = 'finished'").select("match_id", (F.lit(10) - q() % 12).alias("kickoff")), rows, 10)


def preview(s, d):
    x = matches(s, d)
    rows = r.team_match(x)
    table_ = r.league_table(rows.where("season = 1997")).select("competition_id", "team_id", "position", "played")
    return k.previews(x, table_, r.trailing_runs(rows.where(c("day") < NOW), "team_id").select("team_id", "winning", "unbeaten", "losing"), NOW, 14)


def named(s, d):
    e = table(s, d, "lineitem").select(c("l_orderkey").alias("id"), (c("l_partkey") % 40).alias("entity"), F.concat(F.lit("E"), (c("l_partkey") % 40 + (c("l_suppkey") % 50 == 0).cast("int")).cast("string")).alias("name"))
    known = table(s, d, "lineitem").where("l_linenumber <> 5").select(c("l_orderkey").alias("id"), (c("l_partkey") % 40).alias("entity"), F.concat(F.lit("E"), (c("l_partkey") % 40).cast("string")).alias("name"))
    return k.unknown_entities(e.distinct(), known)


def claimed(s, d):
    n = lambda x: x.cast("string")
    text = F.concat(F.lit("In the last "), n(q() % 7), F.lit(" league matches, scoring "), n(q() % 11), F.lit(" and conceding "), n(q() % 13), F.lit(". They lead the table by "), n(q() % 3), F.lit(" points."))
    x = matches(s, d)
    told = x.select(q().alias("id"), (q() % 7).alias("matches"), (q() % 11 + (q() % 17 == 0).cast("int")).alias("goals_for"), (q() % 13).alias("goals_against"), F.lit(None).cast("long").alias("run"), F.when(q() % 5 != 0, q() % 3).alias("gap"))
    return k.wrong_claims(x.select(q().alias("id"), text.alias("text")), told)


def formed(s, d):
    h, a = c("home_score").cast("string"), c("away_score").cast("string")
    x = matches(s, d).where("status = 'finished'")
    head = F.concat(F.lit("Team wins "), F.when(q() % 6 == 0, F.concat_ws("-", a, h)).when(q() % 7 == 0, F.lit("")).otherwise(F.concat_ws("-", h, a)), F.when(q() % 4 != 0, F.lit(" in the late match")).otherwise(F.lit("")))
    return k.article_checks(x.select(q().alias("id"), head.alias("headline"), F.when(q() % 9 == 0, F.lit("shots: undefined")).otherwise(F.lit("nullable")).alias("text"), (q() % 5).alias("paragraphs"), "home_score", "away_score", (c("home_score") + c("away_score") - (q() % 8 == 0).cast("int")).alias("goals")))


def charts(s, d):
    rows = table(s, d, "orders").select((c("o_custkey")).alias("chart_id"), c("o_orderkey").alias("place"), c("o_totalprice").cast("long").alias("value"))
    frozen = rows.where("chart_id % 3 <> 0").groupBy("chart_id").agg(k.values_hash(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"])).alias("frozen"))
    return k.changed_charts(frozen, rows.withColumn("value", c("value") + ((c("chart_id") % 10 == 0) & (c("place") % 2 == 0)).cast("int")))


def desk_rows(s, d):
    state = F.when(c("status") == "finished", "published").when(c("status") == "scheduled", "held").otherwise("draft")
    return matches(s, d).select(q().alias("id"), c("competition_id").alias("desk"), state.alias("status"), "day")


def media(s, d):
    p = c("p_partkey")
    return k.related_media(table(s, d, "part").select((p % 60).alias("entity"), c("p_type").alias("type"), p.alias("media_id"), F.when(p % 4 != 0, "approved").otherwise("open").alias("status"), (p % 9 == 0).alias("is_primary"), c("p_size").alias("day")))


def reads(s, d):
    """Reads of plays: a play is published from one read on, and some are withdrawn again."""
    e = table(s, d, "events").select((c("user_id") % 40).alias("match_id"), c("event_id").alias("play_id"), (c("event_id") % 10).alias("from_read"), F.when(c("event_id") % 6 == 0, c("event_id") % 10 + 3).otherwise(15).alias("to_read"))
    return e.select("match_id", "play_id", F.explode(F.sequence("from_read", "to_read")).alias("read_at"))


def scores(s, d):
    return table(s, d, "events").select((c("user_id") % 50).alias("match_id"), c("event_id").alias("at"), F.floor(c("event_id") / 300).cast("string").alias("theirs"), F.floor((c("event_id") + c("user_id") % 3 * 40) / 300).cast("string").alias("ours"))


def rosters(s, d):
    """Roster files written from the ledger, and read again."""
    e = ledger(s, d).groupBy("match_id", "team_id", "player_id").agg(F.min("sequence").alias("first"), F.count_if("is_goal").alias("goals"))
    one = F.struct((c("first") <= 3).alias("starter"), (c("player_id") % 99).cast("string").alias("jersey"), (c("first") > 3).alias("subbedIn"), F.struct(F.when(c("player_id") % 41 != 0, c("player_id").cast("string")).alias("id"), F.concat(F.lit("P"), c("player_id").cast("string")).alias("displayName")).alias("athlete"), F.array(F.struct(F.lit("totalGoals").alias("name"), c("goals").cast("double").alias("value"))).alias("stats"))
    sides = e.groupBy("match_id", "team_id").agg(F.collect_list(one).alias("roster"))
    files = sides.groupBy("match_id").agg(F.to_json(F.struct(F.collect_list(F.struct(F.lit("home").alias("homeAway"), F.struct(c("team_id").cast("string").alias("id")).alias("team"), "roster")).alias("rosters"))).alias("body"))
    return k.roster_rows(files.unionByName(files.limit(1).select((-q()).alias("match_id"), F.lit("{broken").alias("body"))))


def entries(s, d):
    p = c("p_partkey").cast("string")
    xml = F.concat(F.lit("<entry>\n<yt:videoId>v"), p, F.lit("</yt:videoId><title>Goals &amp; more "), c("p_name"), F.lit("</title><published>2024-01-01</published></entry>"), F.when(c("p_partkey") % 3 == 0, "<entry><title>none</title></entry>").otherwise(""))
    return k.video_entries(table(s, d, "part").select(c("p_brand").alias("channel"), F.concat(F.lit("<feed>"), xml, F.lit("</feed>")).alias("body")))


def article_videos(s, d):
    videos = table(s, d, "part").select(
        c("p_partkey").alias("video_id"), c("p_brand").alias("channel"), F.when(c("p_size") % 4 == 0, "highlights").when(c("p_size") % 4 == 1, "goals").when(c("p_size") % 4 == 2, "other").alias("type"),
        F.when(c("p_size") % 6 != 0, c("p_size") * 9).alias("seconds"), (c("p_partkey") % 11 != 0).alias("embeddable"), (c("p_partkey") % 13 == 0).alias("short"), (c("p_partkey") % 17 == 0).alias("live"),
    )
    links = table(s, d, "lineitem").select(c("l_orderkey").alias("article_id"), c("l_partkey").alias("video_id"), (c("l_partkey") % 5 + 60).alias("score")).distinct()
    return k.article_videos(links, videos, videos.select("channel").distinct().where("channel <> 'Brand#1'"))


def site(s, d):
    day = F.datediff(c("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    articles = table(s, d, "orders").select(c("o_orderkey").alias("id"), c("o_orderpriority").alias("desk"), F.concat(F.lit("a-"), c("o_orderkey").cast("string")).alias("slug"), F.when(c("o_orderstatus") == "F", "published").otherwise("held").alias("status"), day.alias("published"), F.when(c("o_custkey") % 3 == 0, day + 2).alias("updated"), (c("o_custkey") % 5).alias("revision"))
    translated = table(s, d, "lineitem").select(c("l_orderkey").alias("id"), c("l_linenumber").cast("string").alias("locale"), (c("l_partkey") % 5).alias("of_revision"), (c("l_suppkey") % 4 != 0).alias("verified"))
    return k.sitemap(articles, translated)


def kept(s, d):
    """Priorities as methods, with measures made of their orders' keys."""
    o = table(s, d, "orders").select(c("o_orderpriority").alias("method"), F.year("o_orderdate").alias("season"), (c("o_custkey") % 9 - 4).alias("x"), (c("o_orderkey") % 50).alias("y"))
    seasons = o.groupBy("method", "season").agg((F.avg("x") / 40).alias("d_log_loss"))
    raw = o.groupBy("method").agg(
        (F.avg("x") / 10).alias("d_log_loss"), (F.avg("x") / 5).alias("d_brier"), F.avg("x").alias("d_ece"), (F.min("y") / 100 + 0.02).alias("lowest"), (F.max("y") / 50).alias("highest"),
        (F.count("*") % 10 / 100).alias("draw_low"), (F.count("*") % 7 / 14).alias("draw_high"), (F.max("x") / 100).alias("shift"),
    )
    order = o.groupBy("method").agg((F.count("*") % 2 == 0).alias("k5"), F.when(F.count("*") % 3 != 0, F.count("*") % 5 != 0).alias("k6"))
    return k.keep_calibrator(raw, seasons, order)


QUERIES = {
    "tx4_recap_ready": (
        parts,
        S("""select match_id, case when retrying and age < 6 then 'awaiting_enrichment' when whole then 'ready' when age >= 2 then 'ready' else 'too_soon' end as state from (select match_id, match_id % 12 as age, retrying, whole from matches left join (select l_orderkey as match_id,
  bool_or(l_partkey % 5 in (1, 2) and l_suppkey % 3 = 0) as retrying, bool_and(l_partkey % 5 not in (1, 2)) as whole from lineitem group by all) using (match_id) where status = 'finished')"""),
    ),
    "tx5_previews": (
        preview,
        S(f"""select match_id, competition_id, day, score, cast(place as int) as place from (select *, row_number() over (partition by competition_id order by score desc, day, match_id) as place from (select match_id, m.competition_id, day, floor((coalesce(case when h.played >= 3 and a.played >= 3 and h.position <= 4 and a.position <= 4 then 1.0e0 end, 0)
  + coalesce(case when h.played >= 3 and a.played >= 3 and h.position = 1 then 0.6e0 end, 0) + coalesce(case when h.played >= 3 and a.played >= 3 and a.position = 1 then 0.6e0 end, 0) + case when u.winning >= 3 then 0.5e0 when u.unbeaten >= 6 then 0.4e0 else 0 end + case when v.winning >= 3 then 0.5e0 when v.unbeaten >= 6 then 0.4e0 else 0 end
  + case when u.losing >= 3 then 0.4e0 else 0 end + case when v.losing >= 3 then 0.4e0 else 0 end) * 100 + 0.5) / 100 as score from matches m left join tab h on h.competition_id = m.competition_id and h.team_id = home_team_id left join tab a on a.competition_id = m.competition_id and a.team_id = away_team_id
  left join runs u on u.team_id = home_team_id left join runs v on v.team_id = away_team_id where status = 'scheduled' and day between {NOW + 1} and {NOW + 14}) where score >= 1.0) where place <= 3""", f"\ntab as ({table_sql('where season = 1997')})",
  f"\nruns as (select team_id, coalesce(min(k) filter (where points < 3) - 1, max(k)) as winning, coalesce(min(k) filter (where points = 0) - 1, max(k)) as unbeaten, coalesce(min(k) filter (where points > 0) - 1, max(k)) as losing from (select *, row_number() over (partition by team_id order by day desc, match_id desc) as k from team_match where day < {NOW}) group by all)"),
    ),
    "tx5_matchday_briefs": (
        lambda s, d: k.matchday_briefs(matches(s, d), NOW, 400),
        S(f"select *, least(1.6, 1.0 + 0.1e0 * fixtures) as weight from (select competition_id, day, count(*) as fixtures from matches where status = 'scheduled' and day between {NOW + 1} and {NOW + 400} group by all having count(*) >= 3)"),
    ),
    "tx6_group_watch": (
        lambda s, d: k.group_watch(matches(s, d).where("status = 'finished'").select("competition_id", "season", F.floor(c("day") / 7).alias("week"), "match_id"), standings(s, d)),
        S(f"select competition_id, season, day // 7 as week, count(*) as results from matches join {VERIFIED} using (competition_id, season) where status = 'finished' and verified group by all having count(*) >= 6"),
    ),
    "tx9_unknown_entities": (
        named,
        """select id, count(*) as named, count(*) filter (where name is distinct from told) as unknown, count(*) filter (where name is distinct from told) = 0 as passes from (select distinct l_orderkey as id, l_partkey % 40 as entity, 'E' || (l_partkey % 40 + (l_suppkey % 50 = 0)::int) as name from lineitem)
  left join (select distinct l_orderkey as id, l_partkey % 40 as entity, 'E' || (l_partkey % 40) as told from lineitem where l_linenumber <> 5) using (id, entity) group by all""",
    ),
    "tx11_wrong_claims": (
        claimed,
        S("select match_id as id, 'goals_for' as claim, 1::bigint as said, 1::bigint as wrong from matches where match_id % 17 = 0 union all select match_id, 'gap', 1, 1 from matches where match_id % 5 = 0"),
    ),
    "tx12_article_checks": (
        formed,
        S("""select id, array_to_string(l, ',') as failed, len(l) = 0 as passes from (select match_id as id, list_filter([case when (match_id % 7 = 0 and match_id % 6 <> 0) or (match_id % 6 = 0 and home_score > away_score) then 'score_in_headline' end, case when match_id % 8 = 0 then 'goals_match_score' end, case when match_id % 5 < 3 then 'not_thin' end,
  case when match_id % 4 = 0 then 'headline_length' end, case when match_id % 9 = 0 then 'no_artifact' end], lambda x: x is not null) as l from matches where status = 'finished')"""),
    ),
    "tx13_changed_charts": (charts, "select o_custkey as chart_id from orders where o_custkey % 3 <> 0 and o_custkey % 10 = 0 group by all having count(*) filter (where o_orderkey % 2 = 0) > 0"),
    "tx14_shot_map": (
        lambda s, d: k.shot_map(ledger(s, d)),
        sql("select match_id, sequence, floor((case when team_id = home_team_id then x_m else 105.0 - x_m end) * 10 + 0.5) / 10 as x, floor((case when team_id = home_team_id then y_m else 68.0 - y_m end) * 10 + 0.5) / 10 as y, case when is_goal then 'goal' when outcome = 'success' then 'saved' else 'off' end as result from ledger where event_type = 'shot' and x_m is not null", M, L),
    ),
    "tx15_feed": (
        lambda s, d: k.feed(desk_rows(s, d), ledger(s, d).select(q().alias("id"), c("player_id").alias("entity")), 7),
        sql("select match_id as id, day from matches where status = 'finished' and match_id in (select match_id from ledger where player_id = 7) order by day desc, match_id desc limit 20", M, L),
    ),
    "tx17_desk_health": (
        lambda s, d: k.desk_health(desk_rows(s, d), NOW),
        S(f"""select desk, published_1, published_7, published_30, held, {NOW} - last as quiet_days, case when last is null or {NOW} - last > 7 then 'silent' when held > published_30 then 'holding' else 'healthy' end as health from (select competition_id as desk, count(*) filter (where status = 'finished' and day > {NOW - 1}) as published_1,
  count(*) filter (where status = 'finished' and day > {NOW - 7}) as published_7, count(*) filter (where status = 'finished' and day > {NOW - 30}) as published_30, count(*) filter (where status = 'scheduled') as held, max(day) filter (where status = 'finished') as last from matches where day <= {NOW} group by all)"""),
    ),
    "tx18_translations": (
        lambda s, d: k.translations(table(s, d, "orders").where("o_orderkey % 31 <> 0").select(c("o_orderkey").alias("id"), (c("o_custkey") % 5).alias("revision")), table(s, d, "lineitem").select(c("l_orderkey").alias("id"), c("l_linenumber").cast("string").alias("locale"), (c("l_partkey") % 5).alias("of_revision"), (c("l_suppkey") % 4 != 0).alias("verified"))),
        "select l_orderkey as id, cast(l_linenumber as varchar) as locale, case when o_orderkey % 31 = 0 then 'orphan' when l_partkey % 5 <> o_custkey % 5 then 'outdated' when l_suppkey % 4 = 0 then 'unverified' else 'current' end as state from lineitem join orders on l_orderkey = o_orderkey",
    ),
    "xt10_secondary_view": (
        lambda s, d: k.secondary_view(matches(s, d).select("match_id", "status", "home_score", "away_score"), matches(s, d).where("match_id % 3 = 0").select("match_id", F.lit("live").alias("e_status"), (q() % 4).cast("int").alias("e_home"), (q() % 2).cast("int").alias("e_away"), (F.lit(100) - q() % 9).alias("observed_at")), 100),
        S("select match_id, case when new then 'live' else status end as status, case when new then cast(match_id % 4 as int) else home_score end as home_score, case when new then cast(match_id % 2 as int) else away_score end as away_score, case when new then 'enrichment' else 'canonical' end as source from (select *, match_id % 3 = 0 and match_id % 9 <= 5 and status <> 'finished' as new from matches)"),
    ),
    "xt12_video_feed": (
        lambda s, d: k.video_feed(table(s, d, "part").select((c("p_size") % 5).cast("int").alias("desk"), c("p_partkey").alias("video_id"), c("p_brand").alias("channel"), c("p_size").alias("day"), (c("p_partkey") % 7 == 0).alias("linked"))),
        """select desk, video_id, channel, cast(place as int) as place from (select *, row_number() over (partition by desk order by linked desc, day desc, video_id desc) as place from (select *, row_number() over (partition by desk, channel order by linked desc, day desc, video_id desc) as k from (
  select cast(p_size % 5 as int) as desk, p_partkey as video_id, p_brand as channel, p_size as day, p_partkey % 7 = 0 as linked from part)) where k <= 2) where place <= 4""",
    ),
    "xt12_article_videos": (
        article_videos,
        """with v as (select p_partkey as video_id, p_brand as channel, case p_size % 4 when 0 then 'highlights' when 1 then 'goals' when 2 then 'other' end as type, case when p_size % 6 <> 0 then p_size * 9 end as seconds, p_partkey % 11 <> 0 as embeddable, p_partkey % 13 = 0 as short, p_partkey % 17 = 0 as live from part),
l as (select distinct l_orderkey as article_id, l_partkey as video_id, l_partkey % 5 + 60 as score from lineitem),
n as (select * from (select *, row_number() over (partition by article_id order by score desc, video_id) as k from l) where k <= 10)
select article_id, video_id, cast(place as int) as place, score from (select article_id, n.video_id, score, row_number() over (partition by article_id order by score desc, coalesce(case type when 'highlights' then 1 when 'goals' then 2 end, 4), coalesce(seconds >= 120, false) desc, seconds nulls last, n.video_id) as place
  from n join v using (video_id) where embeddable and not short and not live and channel <> 'Brand#1') where place <= 2""",
    ),
    "tx15_sitemap": (
        site,
        """with a as (select o_orderkey as id, o_orderpriority as desk, 'a-' || o_orderkey as slug, date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as published, case when o_custkey % 3 = 0 then date_diff('day', date '1970-01-01', cast(o_orderdate as date)) + 2 end as updated, o_custkey % 5 as revision from orders where o_orderstatus = 'F'),
n as (from a order by published desc, id desc limit 1000)
select desk || '/' || slug as key, coalesce(updated, published) as updated, published, coalesce(locales, '') as locales from n left join (select id, string_agg(locale, ',' order by locale) as locales from (select distinct l_orderkey as id, cast(l_linenumber as varchar) as locale from lineitem join n on n.id = l_orderkey where l_suppkey % 4 <> 0 and l_partkey % 5 = revision) group by id) using (id)""",
    ),
    "xt13_relinked": (
        lambda s, d: k.relinked(table(s, d, "orders").where("o_orderkey % 4 <> 0").select(c("o_orderkey").alias("video_id"), (c("o_custkey") % 100).alias("article_id"), (c("o_custkey") % 70 + 40).alias("points")), table(s, d, "orders").where("o_orderkey % 5 <> 0").select(c("o_orderkey").alias("video_id"), (c("o_custkey") % 50).alias("article_id"), (c("o_custkey") % 60 + 50).alias("points"))),
        """select video_id, case when n is null then null when better then n else o end as article_id, case when n is null then 'withdrawn' when o is null then 'linked' when better and n <> o then 'moved' else 'kept' end as action from (select *, o is null or coalesce(np > op, false) as better from (select o_orderkey as video_id, case when o_orderkey % 4 <> 0 then o_custkey % 100 end as o, case when o_orderkey % 4 <> 0 then o_custkey % 70 + 40 end as op,
  case when o_orderkey % 5 <> 0 then o_custkey % 50 end as n, case when o_orderkey % 5 <> 0 then o_custkey % 60 + 50 end as np from orders where o_orderkey % 4 <> 0 or o_orderkey % 5 <> 0))""",
    ),
    "xt14_limitations": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(k.limitations(F.array(F.lit("lineups for 90% of finished matches"), F.concat(F.lit("note "), c("p_size").cast("string")), F.lit("note a")), F.array(F.lit("note 7"), F.lit("event record for 5% of finished matches")), F.array(F.concat(F.lit("lineups for "), (c("p_partkey") % 100).cast("string"), F.lit("% of finished matches")))), ";").alias("lines")),
        "select p_partkey, 'note ' || p_size || ';note a' || case when p_size = 7 then '' else ';note 7' end || ';lineups for ' || (p_partkey % 100) || '% of finished matches' as lines from part",
    ),
    "xt16_neutral_sites": (
        lambda s, d: k.neutral_sites(matches(s, d), table(s, d, "lineitem").where("l_partkey % 3 = 0").select(c("l_orderkey").alias("match_id"), F.struct("l_partkey", "l_suppkey").alias("at"), F.concat(F.lit('{"neutralSite": '), F.when(c("l_partkey") % 2 == 0, "true").otherwise("false"), F.lit("}")).alias("body"))),
        S("select match_id, coalesce(latest % 2 = 0, false) as neutral, latest is not null as captured from matches left join (select l_orderkey as match_id, max(l_partkey) as latest from lineitem where l_partkey % 3 = 0 group by all) using (match_id)"),
    ),
    "xt18_keep_calibrator": (
        kept,
        """select method, worse, failed, failed = '' as kept from (select method, worse, array_to_string(list_filter([case when ll > -0.0005 then 'K1' end, case when br > 0.0005 then 'K2' end, case when ece >= 0 then 'K3' end, case when worse > 1 then 'K4' end, case when n % 2 <> 0 then 'K5' end, case when n % 3 = 0 or n % 5 = 0 then 'K6' end, case when lo < 0.02 or hi > 0.95 or sh > 0.10 or n % 10 < 5 or n % 7 / 14 > 0.45 then 'K7' end], lambda x: x is not null), ',') as failed from (
  select o_orderpriority as method, avg(o_custkey % 9 - 4) / 10 as ll, avg(o_custkey % 9 - 4) / 5 as br, avg(o_custkey % 9 - 4) as ece, min(o_orderkey % 50) / 100 + 0.02e0 as lo, max(o_orderkey % 50) / 50 as hi, max(o_custkey % 9 - 4) / 100 as sh, count(*) as n from orders group by all)
  join (select method, count(*) filter (where x > 0.002) as worse from (select o_orderpriority as method, year(o_orderdate) as season, avg(o_custkey % 9 - 4) / 40 as x from orders group by all) group by all) using (method))""",
    ),
    "xt20_group_context": (
        lambda s, d: k.group_context(r.league_table(r.team_match(matches(s, d))), standings(s, d), table(s, d, "nation").where("n_nationkey % 4 = 0").select(c("n_nationkey").alias("team_id"))),
        S(f"select competition_id, season, team_id, position, teams_in_group, points, played from (select *, count(*) over (partition by competition_id, season) as teams_in_group from ({table_sql()})) join {VERIFIED} using (competition_id, season) where verified and team_id % 4 = 0"),
    ),
    "xt23_availability": (
        lambda s, d: k.availability(table(s, d, "part").select(c("p_partkey").alias("video_id"), F.when(c("p_partkey") % 5 != 0, c("p_partkey") % 3 != 0).alias("embeddable"), F.when(c("p_size") % 4 == 0, F.array(F.lit("DE"), F.when(c("p_size") % 8 == 0, "US").otherwise("FR"))).alias("blocked"), F.when(c("p_partkey") % 7 == 0, F.array(F.when(c("p_partkey") % 14 == 0, "US").otherwise("GB"))).alias("allowed"))),
        "select p_partkey as video_id, case when p_partkey % 5 <> 0 and p_partkey % 3 = 0 then 'unembeddable' when p_size % 8 = 0 or (p_partkey % 7 = 0 and p_partkey % 14 <> 0) then 'blocked_us' when p_partkey % 5 <> 0 then 'embeddable' else 'unverified' end as state from part",
    ),
    "xt24_related_media": (
        media,
        "select entity, type, media_id from (select *, row_number() over (partition by entity, type order by p_partkey % 9 = 0 desc, p_size desc, p_partkey) as k from (select *, p_partkey % 60 as entity, p_type as type, p_partkey as media_id from part where p_partkey % 4 <> 0)) where k = 1",
    ),
    "str5_first_seen": (
        lambda s, d: k.first_seen(reads(s, d)),
        """with r as (select user_id % 40 as match_id, event_id as play_id, unnest(range(event_id % 10, (case when event_id % 6 = 0 then event_id % 10 + 3 else 15 end) + 1)) as read_at from events), t as (select match_id, read_at, lead(read_at) over (partition by match_id order by read_at) as after from (select distinct match_id, read_at from r))
select match_id, play_id, first_seen, after as withdrawn_seen from (select match_id, play_id, min(read_at) as first_seen, max(read_at) as read_at from r group by all) join t using (match_id, read_at)""",
    ),
    "str6_disagreements": (
        lambda s, d: k.disagreements(scores(s, d), 60),
        """with r as (select user_id % 50 as match_id, event_id as t, case when event_id // 300 <> (event_id + user_id % 3 * 40) // 300 then (event_id // 300) || '|' || ((event_id + user_id % 3 * 40) // 300) end as pair from events),
m as (select *, case when pair is not distinct from lag(pair) over w and row_number() over w > 1 then 0 else 1 end as fresh from r window w as (partition by match_id order by t)), u as (select *, sum(fresh) over (partition by match_id order by t) as run from m),
v as (select *, min(t) over (partition by match_id, run) as since from u) select match_id, pair, since, min(t) as logged_at from v where pair is not null and t - since >= 60 group by all""",
    ),
    "str7_final_reconciliation": (
        lambda s, d: k.final_reconciliation(matches(s, d), table(s, d, "lineitem").select(c("l_orderkey").alias("match_id"), F.struct("l_partkey", "l_suppkey").alias("at"), (c("l_orderkey") % 5).cast("int").alias("home"), (F.floor(c("l_orderkey") / 5) % 4 + (c("l_partkey") % 6 == 0).cast("int")).cast("int").alias("away"))),
        S("select match_id, case when status <> 'finished' then 'waiting' when latest % 6 = 0 then 'differs' else 'agrees' end as result from matches join (select l_orderkey as match_id, max(l_partkey) as latest from lineitem group by all) using (match_id)"),
    ),
    "str11_snapshot_policy": (
        lambda s, d: k.snapshot_policy(table(s, d, "orders").select(c("o_orderkey").alias("snapshot_id"), F.when(c("o_orderkey") % 23 != 0, 10_000 - c("o_orderkey") % 1500).alias("built_at"), F.when(c("o_orderkey") % 6 == 0, 10_000 - c("o_custkey") % 1500).alias("dirty_at"), (c("o_orderkey") % 3 == 0).alias("live"), (c("o_orderkey") % 7 == 0).alias("near")), 10_000),
        """select o_orderkey as snapshot_id, case when b is null then 'missing' when di > b then 'ingest_dirty' when live and age >= 55 then 'live_active' when near and age >= 55 then 'kickoff_near' when age >= 900 then 'idle_safety' end as refresh, coalesce(age <= case when live or near then 180 else 1200 end, false) as serveable from (select *, 10000 - b as age from (
  select o_orderkey, case when o_orderkey % 23 <> 0 then 10000 - o_orderkey % 1500 end as b, case when o_orderkey % 6 = 0 then 10000 - o_custkey % 1500 end as di, o_orderkey % 3 = 0 as live, o_orderkey % 7 = 0 as near from orders))""",
    ),
    "str12_tick_metrics": (
        lambda s, d: k.tick_metrics(table(s, d, "events").select(c("event_type").alias("lane"), c("event_id").alias("at"), F.floor(c("value") * 10).cast("long").alias("ms"))),
        """select lane, count(*) as ticks, max(ms) filter (where r = greatest(1, ceil(0.5 * n))) as median, max(ms) filter (where r = greatest(1, ceil(0.95 * n))) as p95 from (select *, row_number() over (partition by lane order by ms, event_id) as r, count(*) over (partition by lane) as n from (
  select *, event_type as lane, cast(floor(value * 10) as bigint) as ms, row_number() over (partition by event_type order by event_id desc) as k from events) where k <= 120) group by all""",
    ),
    "str13_to_poll": (
        lambda s, d: k.to_poll(matches(s, d).groupBy("season", F.floor(c("day") / 7).alias("matchday")).agg(F.count("*").alias("token")), matches(s, d).where("match_id % 50 <> 0").groupBy("season", F.floor(c("day") / 7).alias("matchday")).agg(F.count("*").alias("token"))),
        S("select season, day // 7 as matchday, count(*) as token from matches group by all having count(*) filter (where match_id % 50 = 0) > 0"),
    ),
    "str15_late_rules": (
        lambda s, d: k.late_rules(matches(s, d).select((q() + 5).alias("pick_id"), "match_id", (c("day") * 24).alias("kickoff")), matches(s, d).where("match_id % 29 <> 0").select("match_id", "status", (c("day") * 24 + q() % 60).alias("starts")), NOW * 24 + 4),
        S(f"""select match_id + 5 as pick_id, match_id, case when match_id % 29 = 0 then 'unknown' when match_id % 60 > 48 then 'void' when status = 'finished' then 'settle' else 'pending' end as state, match_id % 29 <> 0 and status = 'finished' and {NOW * 24 + 4} - (day * 24 + match_id % 60) between 0 and 8 as recap_due from matches"""),
    ),
    "src10_rosters": (
        rosters,
        sql("select match_id, 'home' as side, cast(team_id as varchar) as team, cast(player_id as varchar) as player, 'P' || player_id as name, f <= 3 as starter, f > 3 as came_on, cast(player_id % 99 as int) as shirt, goals from (select match_id, team_id, player_id, min(sequence) as f, count(*) filter (where is_goal) as goals from ledger group by all) where player_id % 41 <> 0", M, L),
    ),
    "src17_envelopes": (
        lambda s, d: k.enveloped(matches(s, d).select("match_id", "status", "home_score", c("day").alias("observed")), "match_id", "results", "observed", NOW, 30),
        S(f"""select match_id, '{{"match_id":' || match_id || ',"status":"' || status || '"' || case when home_score is null then '' else ',"home_score":' || home_score end || '}}' as data, 'results' as source, {NOW} - day as age, case when {NOW} - day <= 30 then 'fresh' else 'stale' end as freshness, case when home_score is null then 'partial' else 'complete' end as coverage from matches"""),
    ),
    "src19_video_entries": (entries, "select p_brand as channel, 'v' || p_partkey as video_id, 'Goals & more ' || p_name as title, '2024-01-01' as published from part"),
}
