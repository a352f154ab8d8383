"""Matches from article text: knockout ties, match boxes, sections and inclusions over a corpus (title, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.text import link_label, strict_score

BAR = "\u0001"  # stands for a bar inside a link or template while a row is split
INCLUSION = "\\{\\{:\\s*([^}|\\n]+?)\\s*\\}\\}"


def without_comments(text) -> Column:
    """Comments are not rendered, so they are not parsed either."""
    return F.regexp_replace(text, "(?s)<!--.*?-->", "")


def section(text, name: str) -> Column:
    """What lies between a named section's begin and end marks, '' if absent."""
    mark = "<section\\s+{}\\s*=\\s*[\"']?" + name + "[\"']?\\s*/>"
    return F.regexp_extract(text, "(?s)" + mark.format("begin") + "(.*?)" + mark.format("end"), 1)


def with_inclusions(corpus: DataFrame) -> DataFrame:
    """Replace each whole-article inclusion by that article's text, one level deep; a missing article gives ''.

    Text is cut at its inclusions, the parts are joined with the corpus on the title and put back in order.
    """
    text = without_comments("text")
    gaps = F.split(text, INCLUSION)
    titles = F.regexp_extract_all(text, F.lit(INCLUSION), F.lit(1))
    with_any = corpus.filter(F.size(titles) > 0).select("title", F.posexplode(F.arrays_zip(gaps.alias("gap"), titles.alias("ref"))).alias("i", "_z"))
    parts = with_any.select("title", "i", F.col("_z")["gap"].alias("gap"), F.trim(F.col("_z")["ref"]).alias("ref"))
    sub = corpus.select(F.col("title").alias("ref"), without_comments("text").alias("_sub"))
    filled = parts.join(sub, "ref", "left").groupBy("title").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("i", F.concat(F.coalesce("gap", F.lit("")), F.coalesce("_sub", F.lit(""))).alias("t")))),
        lambda p: p["t"]), "").alias("_full"))
    return corpus.join(filled, "title", "left").withColumn("text", F.coalesce("_full", text)).drop("_full")


def _protect(line: Column) -> Column:
    """Hide bars inside [[...]] and {{...}} (templates may sit beside links)."""
    for pattern in ("(\\[\\[[^\\]|]*)\\|([^\\]]*\\]\\])", "(\\{\\{[^{}|]*)\\|([^{}]*\\}\\})", "(\\{\\{[^{}|]*)\\|([^{}]*\\}\\})",
                    "(\\{\\{[^{}|]*)\\|([^{}]*\\}\\})", "(\\{\\{[^{}|]*)\\|([^{}]*\\}\\})"):
        line = F.regexp_replace(line, pattern, "$1" + BAR + "$2")
    return line


def knockout_legs(corpus: DataFrame) -> DataFrame:
    """One row per leg from tie tables: home, country, aggregate, away, country, first leg, second leg.

    In the second leg the teams change sides, and so does the score, which the table writes from the first team's view.
    """
    blocks = corpus.select("title", F.explode(F.regexp_extract_all(
        "text", F.lit("(?s)\\{\\{#invoke:Sports series\\|main(.*?)\\n\\}\\}"), F.lit(1))).alias("_b"))
    lines = blocks.select("title", F.posexplode(F.split("_b", "\n")).alias("line_no", "_l")).filter(F.col("_l").contains("[["))
    cells = F.filter(F.transform(F.split(_protect(F.col("_l")), "\\|"), lambda c: F.trim(F.translate(c, BAR, "|"))), lambda c: c != "")
    rows = lines.withColumn("_c", cells).filter((F.size("_c") >= 7) & F.col("_c")[0].contains("[["))
    c = F.col("_c")
    first, second = strict_score(c[5]), strict_score(c[6])
    one, two = link_label(c[0]), link_label(c[3])

    def leg(no, home, away, hc, ac, hg, ag):
        return F.struct(F.lit(no).alias("leg"), home.alias("home"), away.alias("away"), hc.alias("home_country"),
                        ac.alias("away_country"), hg.alias("hg"), ag.alias("ag"))

    legs = F.array(leg(1, one, two, c[1], c[4], first[0], first[1]), leg(2, two, one, c[4], c[1], second[1], second[0]))
    out = rows.select("title", "line_no", F.explode(legs).alias("_g")).select("title", "line_no", "_g.*")
    return out.withColumn("played", F.col("hg").isNotNull() & F.col("ag").isNotNull())


def match_boxes(corpus: DataFrame) -> DataFrame:
    """One row per match box, its fields read by name."""
    boxes = corpus.select("title", F.posexplode(F.regexp_extract_all(
        "text", F.lit("(?s)\\{\\{[Ff]ootball box(.*?)\\n\\}\\}"), F.lit(1))).alias("box_no", "_b"))

    def field(name):
        return F.trim(F.regexp_extract("_b", "(?m)^\\s*\\|?\\s*" + name + "\\s*=\\s*(.*)$", 1))

    f = boxes.select("title", "box_no", *[field(n).alias(f"_{n}") for n in ("date", "team1", "team2", "score")])
    hg, ag = strict_score("_score")
    day = "\\{\\{Start date\\|(\\d+)\\|(\\d+)\\|(\\d+)"
    date = F.try_to_date(F.concat_ws("-", *[F.regexp_extract("_date", day, i) for i in (1, 2, 3)]), "y-M-d")

    def country(c):
        return F.nullif(F.regexp_extract(c, "fbaicon\\|(\\w+)", 1), F.lit(""))

    out = f.select("title", "box_no", date.alias("match_date"), link_label("_team1").alias("home"), link_label("_team2").alias("away"),
                   country("_team1").alias("home_country"), country("_team2").alias("away_country"), hg.alias("hg"), ag.alias("ag"))
    return out.withColumn("played", F.col("hg").isNotNull() & F.col("ag").isNotNull())


def declared_totals(corpus: DataFrame) -> DataFrame:
    """Matches and goals an article's summary box declares."""
    def number(name):
        return F.regexp_extract("text", "\\|\\s*" + name + "\\s*=\\s*(\\d+)", 1).try_cast("int")

    updated = F.nullif(F.trim(F.regexp_extract("text", "\\|\\s*updated\\s*=\\s*(.+)", 1)), F.lit(""))
    return corpus.select("title", number("matches").alias("declared_matches"), number("goals").alias("declared_goals"), updated.alias("updated"))


def check_totals(corpus: DataFrame, found: DataFrame) -> DataFrame:
    """Parsed against declared totals: agrees, differs, or no control where nothing is declared."""
    sums = found.filter("played").groupBy("title").agg(F.count(F.lit(1)).alias("matches"), F.sum(F.col("hg") + F.col("ag")).alias("goals"))
    j = declared_totals(corpus).join(sums, "title", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("matches", "goals")})
    none = F.col("declared_matches").isNull() & F.col("declared_goals").isNull()
    same = (F.col("matches") == F.col("declared_matches")) & (F.col("goals") == F.col("declared_goals"))
    return j.withColumn("control", F.when(none, "no control").when(F.coalesce(same, F.lit(False)), "agrees").otherwise("differs"))


def cross_check(legs: DataFrame, boxes: DataFrame) -> DataFrame:
    """The tie table against the match boxes of the same article, as multisets of (home, away, score).

    A leg without any box contradicts nothing; a leg whose boxes show another score does. Counts per score pair off,
    so no rows are numbered and nothing is listed pairwise.
    """
    key = ["title", "home", "away"]
    a = legs.filter("played").groupBy(*key, "hg", "ag").agg(F.count(F.lit(1)).alias("n"))
    b = boxes.filter("played").groupBy(*key, "hg", "ag").agg(F.count(F.lit(1)).alias("m"))
    hit = a.join(b, [*key, "hg", "ag"], "left").withColumn("k", F.least("n", F.coalesce("m", F.lit(0))))
    per = hit.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    shown = b.groupBy(*key).agg(F.sum("m").alias("m"))
    j = per.join(shown, key, "left").withColumn("free", F.coalesce(F.col("m"), F.lit(0)) - F.col("k"))
    left = F.col("n") - F.col("k")
    out = j.groupBy("title").agg(F.sum("k").alias("crossed"), F.sum(F.least(left, F.col("free"))).alias("differ"),
                                 F.sum(left - F.least(left, F.col("free"))).alias("without_box"))
    return out.join(boxes.filter("played").select("title").distinct(), "title", "left_semi").withColumn(
        "state", F.when(F.col("differ") > 0, "differs").when(F.col("without_box") > 0, "partly crossed").otherwise("agrees"))
