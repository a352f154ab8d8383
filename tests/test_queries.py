"""Registered queries against their SQL on the smallest tables; `check.py` runs all of them at any scale."""

import pytest

import __spark_entry__ as entry
from check import database, difference

SF = "/root/testdata/sf0.001"
SOME = ["standings", "format_control", "profile_rolling", "profile_expanding_gap", "profile_asof_date", "head_to_head",
        "forecast_rps_by_season", "metric_table", "fisher_even", "mann_whitney_phase", "referee_pair_vs_rest",
        "panel_clean", "player_season", "fantasy_defense", "team_season_summary", "bet_settlement", "freeze_candidates",
        "territory", "stint_minutes", "calendar_overlaps", "team_name_match", "article_cross_check", "stream_alarm"]


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, con, name):
    problem, rows = difference(entry.queries()[name](spark, SF), entry.oracle_sql()[name], con)
    assert not problem
    assert rows > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 120


def test_entry_is_the_flagship(spark):
    assert entry.entry(spark).count() > 0
