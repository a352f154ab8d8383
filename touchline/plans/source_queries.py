"""Queries through readers, feeds, article text, pages and writers; their inputs are derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import text
from touchline.functions.numeric import r6
from touchline.operators import reshape
from touchline.plans.match_queries import FORECAST, evaluated
from touchline.plans.panel_queries import TYPED
from touchline.plans.registry import query
from touchline.plans.views import RAW_PANEL_SQL, ctes, raw_panel, view
from touchline.sources import articles, feeds, files, pages, sinks
from touchline.streaming.run import new_place

V = ctes("v_match")
S = "string"


def _m(spark, sf):
    return view(spark, sf, "v_match")


# --- pages ----------------------------------------------------------------------------------------------------------

@query("html_table_rows", f"""WITH {ctes('p3')} SELECT ranker AS page_id, cast(1 as bigint) AS row_no, hid AS player_id, team_id, player, cast(cast(goals as bigint) as string) AS goals FROM p3""")
def html_table_rows(spark, sf):
    """Statistics tables inside comments of pages, one page per panel row, with a repeated header row."""
    html = F.expr("""concat('<html><body><!-- <table class="s" id="stats_standard"><thead><tr><th>x</th></tr></thead><tbody>',
      '<tr class="thead"><th data-stat="player"><a href="#">Player</a></th></tr>', '<tr><th data-stat="player" data-append-csv="', hid, '"><a href="/en/players/', hid, '/x">', player,
      '</a></th>\n<td data-stat="team"><a href="/en/squads/', team_id, '/y">', team, '</a></td><td data-stat="goals">', cast(cast(goals as bigint) as string), '</td></tr>',
      '</tbody></table> --></body></html>')""")
    p = view(spark, sf, "p3").select(F.col("ranker").alias("page_id"), html.alias("html"))
    out = pages.table_rows(p, "stats_standard")
    return out.select("page_id", F.col("row_no").cast("bigint").alias("row_no"), "player_id", "team_id",
                      F.col("cells")["player"].alias("player"), F.col("cells")["goals"].alias("goals"))


_LINE = " || '|' || ".join(f"coalesce(cast({c} as string), '~')" for c in ("player", "team", "games", "minutes", "ranker"))


@query("page_fingerprints", f"""WITH {ctes('p3')}, {RAW_PANEL_SQL}
SELECT league, count(*) AS rows, cast(sum(cast(cast('0x' || substr(md5({_LINE}), 1, 15) as bigint) as hugeint)) as string) AS fingerprint FROM v_panel GROUP BY league""")
def page_fingerprints(spark, sf):
    return pages.page_fingerprint(raw_panel(spark, sf), "league", "ranker", ["player", "team", "games", "minutes"])


# --- articles -------------------------------------------------------------------------------------------------------

def corpus(spark, sf):
    """One article per match: summary box, tie table with two legs, one or two match boxes."""
    return _m(spark, sf).selectExpr("concat('M', match_id) AS title", """concat(
      case when match_id % 3 = 0 then '' else concat('{{Infobox\n| matches = ', case when played then 2 else 0 end, '\n| goals = ',
        case when played then hg + ag + hc + ac else 0 end + case when match_id % 7 = 0 then 1 else 0 end, '\n| updated = 1 May\n}}\n') end,
      '<!-- {{:Example}} -->\n{{#invoke:Sports series|main\n|[[', home, ' FC|', home, ']]|', home_country, '|', case when match_id % 2 = 0 then '3–2 {{pso|4–3}}' else '1–1' end, '|[[', away, ']]|', away_country, '|',
      case when played then concat(hg, '–', ag) else '10 May' end, '|[[#leg2|', case when played then concat(hc, '-', ac) else 'TBD' end, ']]\n}}\n',
      case when match_id % 5 = 0 then '' else concat('{{Football box\n|date = {{Start date|', season, '|', month_no, '|1}}\n|team1 = [[', home, ' FC|', home, ']] {{fbaicon|', home_country, '}}\n|score = ',
        case when played then concat(hg, '–', ag, ' (a)') else 'v' end, '\n|team2 = {{fbaicon|', away_country, '}} [[', away, ']]\n}}\n') end,
      case when match_id % 2 = 0 then concat('{{football box\n|team1 = [[', away, ']]\n|score = ', case when not played then '' when match_id % 10 = 2 then concat(hc, '–', ac) else concat(ac, '–', hc) end,
        '\n|team2 = [[', home, ' FC|', home, ']]\n}}\n') else '' end) AS text""")


_LEGS = f"""{V}, legs AS (SELECT concat('M', cast(match_id as {S})) AS title, match_id, 1 AS leg, home, away, home_country AS hcn, away_country AS acn, case when played then hg end AS hg, case when played then ag end AS ag, played FROM v_match
UNION ALL SELECT concat('M', cast(match_id as {S})), match_id, 2, away, home, away_country, home_country, case when played then ac end, case when played then hc end, played FROM v_match),
boxes AS (SELECT concat('M', cast(match_id as {S})) AS title, home, away, case when played then hg end AS hg, case when played then ag end AS ag, played, concat(cast(season as {S}), '-', lpad(cast(month_no as {S}), 2, '0'), '-01') AS match_date FROM v_match WHERE match_id % 5 <> 0
UNION ALL SELECT concat('M', cast(match_id as {S})), away, home, case when played then case when match_id % 10 = 2 then hc else ac end end, case when played then case when match_id % 10 = 2 then ac else hc end end, played, NULL FROM v_match WHERE match_id % 2 = 0)"""


@query("article_knockout_legs", f"WITH {_LEGS} SELECT title, leg, home, away, hcn AS home_country, acn AS away_country, hg, ag, played FROM legs")
def article_knockout_legs(spark, sf):
    return articles.knockout_legs(corpus(spark, sf)).drop("line_no")


@query("article_match_boxes", f"WITH {_LEGS} SELECT title, home, away, hg, ag, played, match_date FROM boxes")
def article_match_boxes(spark, sf):
    return articles.match_boxes(corpus(spark, sf)).select("title", "home", "away", "hg", "ag", "played",
                                                         F.col("match_date").cast("string").alias("match_date"))


@query("article_totals_control", f"""WITH {V} SELECT concat('M', cast(match_id as {S})) AS title, case when match_id % 3 = 0 then 'no control' when match_id % 7 = 0 then 'differs' else 'agrees' end AS control,
case when played then 2 else 0 end AS matches, cast(case when played then hg + ag + hc + ac else 0 end as bigint) AS goals FROM v_match""")
def article_totals_control(spark, sf):
    c = corpus(spark, sf)
    return articles.check_totals(c, articles.knockout_legs(c)).select("title", "control", "matches", "goals")


@query("article_cross_check", f"""WITH {_LEGS}, a AS (SELECT *, row_number() OVER (PARTITION BY title, home, away, hg, ag ORDER BY leg) AS k FROM legs WHERE played),
b AS (SELECT *, row_number() OVER (PARTITION BY title, home, away, hg, ag ORDER BY match_date) AS k FROM boxes WHERE played),
j AS (SELECT a.title, a.home, a.away, count(*) AS n, count(b.title) AS hit FROM a LEFT JOIN b ON a.title = b.title AND a.home = b.home AND a.away = b.away AND a.hg = b.hg AND a.ag = b.ag AND a.k = b.k GROUP BY ALL),
s AS (SELECT title, home, away, count(*) AS m FROM b GROUP BY ALL),
t AS (SELECT j.title, sum(hit) AS crossed, sum(least(n - hit, coalesce(m, 0) - hit)) AS differ, sum(n - hit - least(n - hit, coalesce(m, 0) - hit)) AS without_box FROM j LEFT JOIN s USING (title, home, away) GROUP BY j.title)
SELECT title, cast(crossed as bigint) AS crossed, cast(differ as bigint) AS differ, cast(without_box as bigint) AS without_box, case when differ > 0 then 'differs' when without_box > 0 then 'partly crossed' else 'agrees' end AS state
FROM t WHERE title IN (SELECT title FROM b)""")
def article_cross_check(spark, sf):
    c = corpus(spark, sf)
    return articles.cross_check(articles.knockout_legs(c), articles.match_boxes(c))


@query("article_inclusions", f"""WITH {V} SELECT concat('A', cast(match_id as {S})) AS title, concat('start ', case when match_id % 2 = 0 then concat('body of ', home) else '' end, ' mid  end') AS text FROM v_match
UNION ALL SELECT concat('B', cast(match_id as {S})), concat('body of ', home) FROM v_match WHERE match_id % 2 = 0""")
def article_inclusions(spark, sf):
    m = _m(spark, sf)
    a = m.selectExpr("concat('A', match_id) AS title", "concat('start {{:B', match_id, '}} mid <!-- {{:B', match_id, '}} --> end') AS text")
    b = m.filter("match_id % 2 = 0").selectExpr("concat('B', match_id) AS title", "concat('body of ', home) AS text")
    return articles.with_inclusions(a.unionByName(b))


@query("article_sections", f"WITH {V} SELECT match_id, concat('Final of ', home) AS text FROM v_match")
def article_sections(spark, sf):
    m = _m(spark, sf).selectExpr("match_id", "concat('x <section begin=\"Final\" />Final of ', home, '<section end=Final /> y <section begin=Other/>no<section end=Other/>') AS t")
    return m.select("match_id", articles.section(F.col("t"), "Final").alias("text"))


# --- feeds and report strings ---------------------------------------------------------------------------------------

@query("feed_nested_a", f"""WITH {V} SELECT cast(match_id as {S}) AS match_id, home, away, case when played then hg end AS hg, case when played then ag end AS ag, referee, referee_country,
concat('Liga ', cast(league_no as {S})) AS league, cast(match_date as {S}) AS date, '20:45' AS time, played FROM v_match""")
def feed_nested_a(spark, sf):
    payload = F.expr("""to_json(named_struct('id', cast(match_id as string), 'status', case when played then 'FINISHED' else 'UPCOMING' end,
      'kickOffTime', named_struct('dateTime', concat(cast(match_date as string), 'T20:45:00Z')),
      'group', named_struct('league', named_struct('translations', named_struct('name', map('ES', concat('Liga ', league_no), 'EN', concat('League ', league_no))))),
      'homeTeam', named_struct('internationalName', home, 'countryCode', home_country), 'awayTeam', named_struct('internationalName', 'other', 'translations', named_struct('displayName', map('ES', '', 'EN', away))),
      'score', case when played then named_struct('total', named_struct('home', hg, 'away', ag)) end,
      'referees', array(named_struct('role', 'ASSISTANT_REFEREE', 'person', named_struct('countryCode', 'XX', 'internationalName', 'nobody')), named_struct('role', 'REFEREE', 'person', named_struct('countryCode', referee_country, 'internationalName', referee)))))""")
    out = feeds.feed_a(feeds.parse(_m(spark, sf).select(payload.alias("j")), "j", feeds.FEED_A))
    return out.select("match_id", "home", "away", "hg", "ag", "referee", "referee_country", "league", "date", "time", "played")


@query("feed_nested_b", f"WITH {V} SELECT cast(match_id as {S}) AS match_id, home, away, case when played then hg end AS hg, case when played then ag end AS ag, referee, played FROM v_match")
def feed_nested_b(spark, sf):
    payload = F.expr("""to_json(named_struct('matchId', cast(match_id as string), 'status', case when played then 'played' else 'fixture' end, 'dateVenue', cast(match_date as string), 'timeVenueUTC', '18:00:00',
      'homeTeam', named_struct('name', home), 'awayTeam', named_struct('name', away), 'result', named_struct('homeGoals', case when played then hg else 0 end, 'awayGoals', case when played then ag else 0 end),
      'referees', array(named_struct('role', 'Assistant referee 1', 'refereeName', 'nobody'), named_struct('role', 'Referee', 'refereeName', referee))))""")
    out = feeds.feed_b(feeds.parse(_m(spark, sf).select(payload.alias("j")), "j", feeds.FEED_B))
    return out.select("match_id", "home", "away", "hg", "ag", "referee", "played")


@query("feed_officials_text", f"WITH {V} SELECT match_id, referee, referee_country FROM v_match")
def feed_officials_text(spark, sf):
    cell = F.expr("concat('[{''name'': ''A'', ''role'': ''ASSISTANT'', ''counrty_code'': None}, {''name'': ''', referee, ''', ''role'': ''REFEREE'', ''counrty_code'': ''', referee_country, '''}]')")
    return feeds.listed_officials(_m(spark, sf).select("match_id", cell.alias("c")), "c").select("match_id", "referee", "referee_country")


@query("report_strings", f"WITH {V} SELECT match_id, hg AS saves_made, hst AS saves_tried, hf AS possession_pct FROM v_match WHERE match_id % 11 <> 0")
def report_strings(spark, sf):
    m = _m(spark, sf).selectExpr("match_id", "case when match_id % 11 = 0 then 'n/a' else concat(hg, ' of ', hst) end AS saves", "concat(hf, '%') AS possession")
    good, _ = files.report_numbers(m, ["saves"], ["possession"])
    return good.select("match_id", "saves_made", "saves_tried", "possession_pct")


_ODDS = "case match_id % 4 when 0 then '+150' when 1 then '-120' when 2 then '5/2' else '1,85' end"


@query("text_rules", f"""WITH {V} SELECT match_id, round(case match_id % 4 when 0 then 2.5 when 1 then 1 + 100 / 120.0 when 2 then 3.5 else 1.85 end, 6) AS odds, cast(1000 + match_id as double) AS stake, hg AS score_h, ag AS score_a,
round(hc + ac / 60.0, 6) AS minutes, cast(match_date as {S}) AS day, case when match_id % 2 = 0 then '21:00' else '20:00' end AS kickoff, concat(cast(season as {S}), '-', right(cast(season + 1 as {S}), 2)) AS season,
concat('R. ', 'Pérez', cast(match_id as {S})) AS short, concat('raul-perez', cast(match_id as {S})) AS slug, match_id % 38 AS matchday FROM v_match""")
def text_rules(spark, sf):
    m = _m(spark, sf)
    score = F.concat_ws("", F.lit("(4) "), F.col("hg").cast(S), F.lit(" – "), F.col("ag").cast(S), F.lit(" (5)"))
    h, a = text.loose_score(score)
    name = F.concat(F.lit("Raúl Pérez"), F.col("match_id").cast(S))
    return m.select(
        "match_id", r6(text.decimal_odds(F.expr(_ODDS))).alias("odds"), text.money(F.concat(F.lit("$"), F.format_number(1000 + F.col("match_id"), 0))).alias("stake"),
        h.alias("score_h"), a.alias("score_a"), r6(text.clock_minutes(F.format_string("%02d:%02d", "hc", "ac"))).alias("minutes"),
        text.mixed_date(F.when(F.col("match_id") % 2 == 0, F.date_format("match_date", "dd/MM/yyyy")).otherwise(F.col("match_date").cast(S))).cast(S).alias("day"),
        text.local_kickoff(F.when(F.col("match_id") % 2 == 0, "20:00 (21:00)").otherwise("20:00")).alias("kickoff"),
        F.concat(F.substring("season", 1, 2), F.substring(text.season_label(F.concat(F.substring("season", 3, 2), F.substring((F.col("season") + 1).cast(S), 3, 2))), 3, 5)).alias("season"),
        text.short_name(name).alias("short"), text.slug(name).alias("slug"),
        text.matchday_of_round(F.concat(F.lit("Apertura — Jornada "), (F.col("match_id") % 38).cast(S))).alias("matchday"))


# --- files and writers ----------------------------------------------------------------------------------------------

@query("pipe_scan", f"WITH {V} SELECT cast(match_id as {S}) AS match_id, home, away, cast(hg as {S}) AS hg FROM v_match WHERE match_id % 10 <> 0")
def pipe_scan(spark, sf):
    place = new_place(spark, "pipes")
    _m(spark, sf).select(F.expr("concat_ws('|', match_id, home, away, hg, case when match_id % 10 = 0 then 'extra' end)").alias("value")).write.text(place)
    return files.pipe_rows(spark, place, ["match_id", "home", "away", "hg"])[0]


@query("season_csv_scan", f"WITH {V} SELECT home, away, cast(hg as double) AS hg, cast(match_date as {S}) AS match_date, round(odds_h, 6) AS odds_h FROM v_match WHERE played")
def season_csv_scan(spark, sf):
    """Matches written as CSV without some columns, read back to the fixed column list, played rows only."""
    place = new_place(spark, "csv")
    _m(spark, sf).selectExpr("league AS Div", "date_format(match_date, 'dd/MM/yyyy') AS Date", "home AS HomeTeam", "away AS AwayTeam",
                             "case when played then hg end AS FTHG", "case when played then ag end AS FTAG", "odds_h AS B365H").write.option("header", True).csv(place)
    out = files.season_matches(spark, place)
    return out.select(F.col("HomeTeam").alias("home"), F.col("AwayTeam").alias("away"), F.col("FTHG").alias("hg"),
                      F.col("match_date").cast(S).alias("match_date"), r6("B365H").alias("odds_h"))


@query("fixtures_by_priority", f"""WITH {V}, f AS (SELECT league, home, away, match_date, 0 AS p FROM v_match WHERE NOT played AND match_id % 2 = 0 UNION ALL SELECT league, home, away, match_date + 7, 1 FROM v_match WHERE NOT played)
SELECT league, home, away, cast(match_date as {S}) AS match_date FROM f QUALIFY row_number() OVER (PARTITION BY league, home, away ORDER BY p, match_date) = 1""")
def fixtures_by_priority(spark, sf):
    m = _m(spark, sf).filter("NOT played").select("league", "home", "away", "match_date", "match_id")
    main = m.filter("match_id % 2 = 0").drop("match_id")
    backup = m.drop("match_id").withColumn("match_date", F.date_add("match_date", 7))
    return files.fixtures_by_priority(main, backup).withColumn("match_date", F.col("match_date").cast(S))


@query("register_append", f"WITH {V} SELECT match_id, home, case when match_id % 2 = 0 then hg else hg + 100 end AS hg FROM v_match")
def register_append(spark, sf):
    """Half the keys stored first; the second write brings two later readings of each, and only the first of a new key is kept."""
    place = new_place(spark, "register")
    m = _m(spark, sf).select("season", "match_id", "home", "hg")
    m.filter("match_id % 2 = 0").hint("rebalance", "season").write.partitionBy("season").parquet(place)
    again = m.withColumn("reading", F.explode(F.array(F.lit(2), F.lit(1)))).withColumn("hg", F.col("hg") + 150 - 50 * F.col("reading"))
    register = spark.read.schema(m.schema).parquet(place)
    sinks.append_unseen(again, register, place, ["season", "match_id"], "reading", by="season")
    return spark.read.schema(m.schema).parquet(place).drop("season")


@query("partition_replace", f"WITH {V} SELECT match_id, case when season = 1999 then hg + 100 else hg end AS hg, season FROM v_match")
def partition_replace(spark, sf):
    place = new_place(spark, "partitions")
    m = _m(spark, sf).select("match_id", "hg", "season")
    sinks.write_table(m, place, ["season"])
    sinks.replace_partition(m.filter("season = 1999").withColumn("hg", F.col("hg") + 100), place, ["season"])
    return spark.read.parquet(place).withColumn("season", F.col("season").cast("bigint"))


@query("changed_stored_rows", f"WITH {V} SELECT match_id FROM v_match WHERE match_id % 50 = 0")
def changed_stored_rows(spark, sf):
    m = _m(spark, sf).select("match_id", "hg", "odds_h")
    return sinks.changed_rows(m, m.withColumn("hg", F.when(F.col("match_id") % 50 == 0, F.col("hg") + 1).otherwise(F.col("hg"))), ["match_id"])


@query("publish_gate", f"WITH {FORECAST} SELECT 'probabilities sum to one' AS rule, count(*) AS violations FROM ev WHERE match_id % 20 = 0 HAVING count(*) > 0")
def publish_gate(spark, sf):
    bad = evaluated(spark, sf).withColumn("p_home", F.when(F.col("match_id") % 20 == 0, F.col("p_home") + 0.5).otherwise(F.col("p_home")))
    return sinks.publish_gate(bad)


@query("document_round_trip", f"WITH {V} SELECT league, match_id, home, hg, round(odds_h, 6) AS odds_h FROM v_match")
def document_round_trip(spark, sf):
    """One folder of row documents per league and season written as JSON lines, read back to one row per match."""
    place = new_place(spark, "documents")
    m = _m(spark, sf).withColumn("key", F.concat_ws("|", "league", "season"))
    groups = sinks.write_documents(sinks.documents(m, "key", ["match_id"], ["match_id", "home", "hg", "odds_h"]), "key", place)
    back = sinks.read_documents(spark, place, groups, "match_id bigint, home string, hg bigint, odds_h double, key string")
    return back.select(F.split_part("key", F.lit("|"), F.lit(1)).alias("league"), "match_id", "home", "hg", r6("odds_h").alias("odds_h"))


@query("columnar_rows", f"WITH {V} SELECT league, match_id, to_json([cast(match_id as string), home, away, cast(hg as string)]) AS document FROM v_match")
def columnar_rows(spark, sf):
    out = sinks.columnar_rows(_m(spark, sf), "league", ["match_id", "home", "away", "hg"], ["match_id"])
    return out.select("league", "match_id", "document")


_IDS = f"""{TYPED}, rw AS (SELECT ranker, player, team, games, minutes FROM ty)"""


@query("page_alignment", f"""WITH {_IDS} SELECT ranker, player_id, case when ranker % 5 = 0 then 'position' else 'content' end AS matched_by FROM ty""")
def page_alignment(spark, sf):
    """Rows without ids against pages with ids, where every fifth row has another team name."""
    from touchline.operators.panel import typed

    p = typed(raw_panel(spark, sf)).select("ranker", "player", "team", "league", "season", "games", "minutes", "player_id")
    rows = p.drop("player_id").withColumn("minutes", F.coalesce("minutes", F.lit(-1.0)))
    page = p.withColumn("minutes", F.coalesce("minutes", F.lit(-1.0))).withColumn("team", F.when(F.col("ranker") % 5 == 0, F.concat("team", F.lit(" FC"))).otherwise(F.col("team")))
    out = reshape.align_by_content(rows, page, ["player", "team", "league", "season", "games", "minutes"], "ranker", ["games", "minutes"], ["player_id"])
    return out.select("ranker", "player_id", "matched_by")


@query("bag_difference", f"""WITH {V}, a AS (SELECT home, away, hg FROM v_match), b AS (SELECT home, away, case when match_id % 30 = 0 then 9 else hg end AS hg FROM v_match)
SELECT *, 'left' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def bag_difference(spark, sf):
    m = _m(spark, sf)
    return reshape.bag_difference(m.select("home", "away", "hg"),
                                  m.select("home", "away", F.when(F.col("match_id") % 30 == 0, 9).otherwise(F.col("hg")).cast("bigint").alias("hg")))


@query("outcome_crosstab", f"""WITH {V} SELECT phase, round(avg((hg > ag)::int), 6) AS "H", round(avg((hg = ag)::int), 6) AS "D", round(avg((hg < ag)::int), 6) AS "A" FROM v_match WHERE played GROUP BY phase""")
def outcome_crosstab(spark, sf):
    m = _m(spark, sf).filter("played").withColumn("res", F.expr("case when hg > ag then 'H' when hg = ag then 'D' else 'A' end"))
    n = m.groupBy("phase").pivot("res", ["H", "D", "A"]).agg(F.count(F.lit(1)))
    total = F.col("H") + F.col("D") + F.col("A")
    return n.select("phase", *[r6(F.col(c) / total).alias(c) for c in "HDA"])


@query("value_audit", f"WITH {V} SELECT match_id, hg > hst AS goals_above_shots, hf + af > 30 AS many_fouls FROM v_match WHERE hg > hst OR hf + af > 30")
def value_audit(spark, sf):
    m = _m(spark, sf).withColumns({"goals_above_shots": F.col("hg") > F.col("hst"), "many_fouls": F.col("hf") + F.col("af") > 30})
    return m.filter("goals_above_shots OR many_fouls").select("match_id", "goals_above_shots", "many_fouls")


@query("match_totals_profile", f"""WITH {V}, d AS (SELECT hg + ag AS goals, hy + hr + ay + ar AS cards, hc + ac AS corners, odds_h FROM v_match),
u AS (SELECT 'goals' AS "column", goals::double AS v FROM d UNION ALL SELECT 'cards', cards FROM d UNION ALL SELECT 'corners', corners FROM d UNION ALL SELECT 'odds_h', odds_h FROM d)
SELECT "column", count(v) AS n, count(*) - count(v) AS missing, round(avg(v), 6) AS mean, round(var_samp(v), 6) AS variance, min(v) AS low, max(v) AS high FROM u GROUP BY "column" """)
def match_totals_profile(spark, sf):
    d = _m(spark, sf).selectExpr("match_id", "cast(hg + ag as double) AS goals", "cast(hy + hr + ay + ar as double) AS cards", "cast(hc + ac as double) AS corners", "odds_h")
    long = d.unpivot(["match_id"], ["goals", "cards", "corners", "odds_h"], "column", "v")
    return long.groupBy("column").agg(F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), r6(F.avg("v")).alias("mean"),
                                      r6(F.var_samp("v")).alias("variance"), F.min("v").alias("low"), F.max("v").alias("high"))


