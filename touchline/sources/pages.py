"""Statistics tables in HTML pages to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _plain(cell: Column) -> Column:
    return F.trim(F.regexp_replace(cell, "<[^>]*>", ""))


def table_rows(pages: DataFrame, table_id: str, html: str = "html") -> DataFrame:
    """Player rows of one table, also where the table sits inside a comment; repeated header rows are dropped.

    Cells become a map from their statistic name to text; ids come from the cell's own mark or its link.
    """
    table = F.regexp_extract(html, f"(?s)<table[^>]*id=\"{table_id}\"[^>]*>(.*?)</table>", 1)
    body = F.regexp_extract(table, "(?s)<tbody[^>]*>(.*?)</tbody>", 1)
    rows = F.regexp_extract_all(body, F.lit("(?s)(<tr[^>]*>.*?</tr>)"), F.lit(1))
    r = pages.select("page_id", F.posexplode(rows).alias("row_no", "_r")).filter(
        ~F.regexp_extract("_r", "^<tr([^>]*)>", 1).rlike("thead|over_header")).filter(
        F.col("_r").rlike("(?s)data-stat=\"player\"[^>]*>.*?<a"))
    cell = "(?s)<t[dh][^>]*data-stat=\"([^\"]+)\"[^>]*>(.*?)</t[dh]>"
    names = F.regexp_extract_all("_r", F.lit(cell), F.lit(1))
    texts = F.transform(F.regexp_extract_all("_r", F.lit(cell), F.lit(2)), _plain)
    own = F.regexp_extract("_r", "data-append-csv=\"([^\"]+)\"", 1)
    link = F.regexp_extract("_r", "href=\"/[^/\"]+/players/([^/\"]+)", 1)
    team = F.regexp_extract("_r", "href=\"/[^/\"]+/squads/([^/\"]+)", 1)
    return r.select("page_id", "row_no", F.map_from_arrays(names, texts).alias("cells"),
                    F.when(own != "", own).otherwise(link).alias("player_id"), team.alias("team_id"))


def page_fingerprint(rows: DataFrame, page: str, order: str, content: list[str]) -> DataFrame:
    """One fingerprint per page of its ordered content: equal extracts have equal fingerprints.

    Rows are hashed on their own and combined with their place by a sum, so a page is never held in one task.
    """
    line = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in [*content, order]]))
    number = F.conv(F.substring(line, 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(page).agg(F.count(F.lit(1)).alias("rows"), F.sum(number).cast("string").alias("fingerprint"))
