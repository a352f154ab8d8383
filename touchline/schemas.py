"""Column contracts: explicit schemas, late typing and a data dictionary kept in column metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_IDS = ("player_id", "team_id", "match_id_text")

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "date": T.DateType(), "boolean": T.BooleanType(),
          "bigint": T.LongType(), "int": T.IntegerType()}


def columns(text: str) -> T.StructType:
    """'a string, b double' as a schema; needs no running session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in text.split(","))])


MATCHES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("Div", "Date", "Time", "HomeTeam", "AwayTeam", "FTR", "Referee")]
    + [T.StructField(n, T.DoubleType()) for n in (
        "FTHG", "FTAG", "HS", "AS", "HST", "AST", "HF", "AF", "HC", "AC", "HY", "AY", "HR", "AR", "B365H", "B365D",
        "B365A", "PSCH", "PSCD", "PSCA", "AvgH", "AvgD", "AvgA")])

REGISTER = columns(
    "frozen_at string, model string, season string, league string, match_date date, home string, away string, "
    "p_home double, p_draw double, p_away double, pick string, even boolean, counts_live boolean, "
    "expected_cards double, lam double, mu double, note string")

CALENDAR = columns(
    "kind string, competition string, edition string, phase string, scope string, confederation string, "
    "start date, end date, what string, confirmed string, source string")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns: absent ones NULL, present ones cast without failing on bad cells."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields])


def documented(df: DataFrame, dictionary: dict[str, str]) -> DataFrame:
    """Attach descriptions to columns; the output must have exactly the dictionary's columns."""
    if set(df.columns) != set(dictionary):
        missing, extra = set(dictionary) - set(df.columns), set(df.columns) - set(dictionary)
        raise ValueError(f"columns differ from the dictionary: missing {sorted(missing)}, extra {sorted(extra)}")
    return df.select(*[F.col(c).alias(c, metadata={"comment": text}) for c, text in dictionary.items()])
