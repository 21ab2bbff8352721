"""Registered queries against their oracle SQL; all of them with ORACLE_ALL=1."""

import os

import pytest

from check import compare, connect
from repohealth.plans import REGISTRY

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
SAMPLE = (
    "overall_score", "scored_trend", "trend", "reconcile", "file_health", "action_bundles", "secrets", "external_silos",
    "resolve_imports", "repo_traits", "config_checks", "churn", "lcov", "vulnerable_deps", "similarity", "agreement",
    "cohesion", "budget_pack", "parse_review", "latest_progress", "scan_scores",
)
NAMES = sorted(REGISTRY) if os.environ.get("ORACLE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip(f"{FOLDER} is not there")
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    outcome, _ = compare(spark, con, FOLDER, REGISTRY[name])
    assert outcome in ("ok", "rows only"), outcome


@pytest.mark.parametrize("name", ("scan_findings", "scan_results"))
def test_whole_scan(spark, con, name):
    """Its SQL is made of the SQL of other queries and changes with these."""
    outcome, rows = compare(spark, con, FOLDER, REGISTRY[name])
    assert outcome == "ok" and rows


def test_queries_without_an_oracle():
    assert {name for name, q in REGISTRY.items() if not q.sql} == {"greedy_match", "communities", "modularity"}
