"""Registered queries against their SQL, on the smallest data set.

TIDEWATCH_ALL=1 runs every query; by default one or two of each family.
"""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracles  # noqa: E402

import __spark_entry__ as entry_points  # noqa: E402

FOLDER = os.environ.get("TIDEWATCH_DATA", "/root/testdata/sf0.001")
USUAL = [
    "f6_visible_to",
    "n14_deterministic_id",
    "n15_dedupe_key",
    "s6_contract_gate",
    "s8_partitioned_write",
    "a2_lag_quantiles",
    "w1_flag_jumps",
    "w6_current_revisions",
    "w11_rank_priority",
    "j1_resolve_refs",
    "j3_match_areas",
    "j6_as_of_many",
    "d6_apply_changes",
    "d8_contradictions",
    "q1_observation_rules",
    "k1_top_events",
    "a9_throttle_alerts",
    "t1_search",
    "x3_jump_check",
]
NAMES = sorted(entry_points.queries()) if os.environ.get("TIDEWATCH_ALL") else USUAL


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    con = check_oracles.connect(FOLDER)
    build, sql = entry_points.queries()[name], entry_points.oracle_sql().get(name)
    ok, text, _, _ = check_oracles.compare(spark, con, name, build, sql, FOLDER)
    assert ok, text


def test_every_sql_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_flagship(spark):
    assert entry_points.entry(spark).count() == 20


def test_entry_without_the_training_data_package():
    import subprocess

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'k1_top_events' in q and 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
