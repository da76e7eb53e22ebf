"""A quick selection of registered queries against DuckDB; ``tools/check.py`` runs all of them."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import compare, connect

QUICK = [
    "load_claims", "csv_roundtrip", "coerce_numeric", "clip_log1p", "derive_target", "freq_encode", "category_drift",
    "quantile_vector", "predicate_rates", "spearman", "qcut", "kfold", "class_shares", "class_metrics", "tau_sensitivity",
    "check_result", "markdown_blocks", "pipe_table_cells", "stage_progress",
]


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", QUICK)
def test_same_as_sql(spark, sf_dir, duck, name):
    problem, rows = compare(queries()[name](spark, sf_dir), duck, oracle_sql()[name])
    assert problem is None and rows > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 3 and sum(r.pct for r in rows) == pytest.approx(100, abs=0.01)
