"""Scans of CSV, text and JSON inputs with explicit columns; bad lines and cells never stop a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions import text
from touchline.schemas import CALENDAR, MATCHES, REGISTER, conform


def season_matches(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Season files of matches: typed columns, the season from the file name, played rows only."""
    raw = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("enforceSchema", False).csv(paths)
    names = {c: c.replace("﻿", "") for c in raw.columns}
    raw = raw.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col("_metadata.file_name").alias("_file"))
    season = text.season_label(F.regexp_extract("_file", "(\\d{4})(?=\\.csv)", 1))
    typed = conform(raw.select("*"), T.StructType([*MATCHES.fields, T.StructField("_file", T.StringType())]))
    return typed.withColumns({"season": season, "match_date": text.mixed_date("Date")}).drop("_file").filter(
        F.col("FTHG").isNotNull() & F.col("FTAG").isNotNull())


def union_seasons(frames: list[DataFrame]) -> DataFrame:
    """Union of seasons whose columns changed over the years, to the fixed column list."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return conform(out, MATCHES)


def text_table(spark: SparkSession, paths: str | list[str], keep_text: list[str]) -> DataFrame:
    """Many CSV files read as text, then numbers where they parse; an empty cell is NULL, not zero."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(paths)
    return raw.select(*[F.col(c) if c in keep_text else text.thousands(c).alias(c) for c in raw.columns])


def pipe_rows(spark: SparkSession, paths: str | list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Headerless pipe-separated lines: rows with exactly the expected fields, and the rejected lines."""
    lines = spark.read.text(paths).withColumn("_f", F.split("value", "\\|"))
    good = lines.filter(F.size("_f") == len(columns)).select(
        *[F.nullif(F.trim(F.col("_f")[i]), F.lit("")).alias(c) for i, c in enumerate(columns)])
    bad = lines.filter(F.size("_f") != len(columns)).select(F.col("value").alias("line"), F.size("_f").alias("fields"))
    return good, bad


def calendar(spark: SparkSession, path: str) -> DataFrame:
    from touchline.operators.competition import calendar_columns

    return calendar_columns(spark.read.option("header", True).schema(CALENDAR).csv(path))


def register(spark: SparkSession, path: str) -> DataFrame:
    """The append-only register of frozen predictions."""
    return spark.read.schema(REGISTER).parquet(path)


def fixtures_by_priority(main: DataFrame, backup: DataFrame) -> DataFrame:
    """Two fixture sources: per pairing (not per date) the main source wins."""
    both = main.withColumn("_p", F.lit(0)).unionByName(backup.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    keep = [c for c in both.columns if c not in ("league", "home", "away", "_p")]
    return both.groupBy("league", "home", "away").agg(
        F.min_by(F.struct(*keep), F.struct("_p", "match_date")).alias("_r")).select("league", "home", "away", "_r.*")


def csv_text_map(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A map of name -> CSV text, one row per CSV line."""
    rows = df.select(F.explode(column).alias("name", "_text")).select("name", F.posexplode(F.split("_text", "\n")).alias("line_no", "_line"))
    body = rows.filter((F.col("line_no") > 0) & (F.trim("_line") != ""))
    return body.select("name", "line_no", F.from_csv("_line", F.lit(schema)).alias("_r")).select("name", "line_no", "_r.*")


def page_dump(df: DataFrame, columns: str = "cols", rows: str = "rows") -> DataFrame:
    """{cols: [...], rows: [[...], ...]} -> one row per record with its cells as a map."""
    return df.select("*", F.posexplode(rows).alias("row_no", "_r")).withColumn("cells", F.map_from_arrays(columns, "_r")).drop("_r", rows, columns)


def prediction_documents(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Exported forecast documents (one per league) back to one row per match."""
    docs = spark.read.schema(f"league string, historico array<struct<{schema}>>").option("multiLine", True).json(paths)
    return docs.select("league", F.explode("historico").alias("_m")).select("league", "_m.*")


def report_numbers(df: DataFrame, attempts: list[str], percents: list[str]) -> tuple[DataFrame, DataFrame]:
    """Report strings ('5 of 14', '55%') as integers; rows where a string does not parse are set aside."""
    out = df
    ok = F.lit(True)
    for c in attempts:
        made, tried = text.count_of_attempts(c)
        out = out.withColumns({f"{c}_made": made, f"{c}_tried": tried})
        ok = ok & (F.col(f"{c}_made").isNotNull() | F.col(c).isNull())
    for c in percents:
        out = out.withColumn(f"{c}_pct", text.percent(c))
        ok = ok & (F.col(f"{c}_pct").isNotNull() | F.col(c).isNull())
    out = out.withColumn("_ok", ok)
    return out.filter("_ok").drop("_ok"), out.filter("NOT _ok").drop("_ok")
