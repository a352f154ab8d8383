"""What queries write to the shared folder, against the size of the lines table."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from touchline.session import shared_folder

SF = "/root/testdata/sf0.01"


def written(folder) -> int:
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())


@pytest.mark.parametrize("name", ["league_ladder_fit", "league_ladder_differences", "regression_curve", "league_comparison", "squad_vs_points",
                                  "level_clusters", "silhouette", "level_drift", "nested_card_tests", "nested_card_models",
                                  "nested_card_scores"])
def test_queries_write_little_more_than_they_read(spark, name):
    folder = shared_folder(spark).removeprefix("file:")
    before = written(folder)
    assert entry.queries()[name](spark, SF).count() > 0
    assert written(folder) - before < 2 * os.path.getsize(f"{SF}/lineitem.parquet")
