"""Every registered query with SQL gives what DuckDB gives; the others run."""

import pytest

from tests.oracle import same
from vetra.queries import ORACLES, QUERIES

SLOW = {"kmeans_references", "fit_risk"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    same(spark, QUERIES[name], ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_references_come_from_every_class(spark, sf_dir):
    rows = QUERIES["kmeans_references"](spark, sf_dir).collect()
    assert len({r["class_name"] for r in rows}) == 6


def test_risk_rises_with_distance(spark, sf_dir):
    assert QUERIES["fit_risk"](spark, sf_dir).first()["slope"] > 0


def test_all_decisions_occur(spark):
    rows = QUERIES["decide"](spark, "/root/testdata/sf0.01")
    assert {r["decision"] for r in rows.select("decision").distinct().collect()} == {"PASS", "REVIEW", "UNKNOWN"}


def test_the_chain_runs_on_its_own_calibration(spark):
    """What is accepted of the validation set is what the threshold was selected for, and risk meets the policy at the boundary."""
    from vetra.queries.calibration import calibrated

    sf = "/root/testdata/sf0.01"
    c, p = calibrated(spark, sf)
    rows = QUERIES["screen_calibrated"](spark, sf).collect()
    known = [r for r in rows if r["split"] == "validation"]
    assert c.boundary <= c.threshold and sum(r["distance"] <= c.boundary for r in known) >= 0.95 * len(known)
    assert all(r["unknown_risk"] <= p.max_risk for r in rows if r["decision"] == "PASS")
    assert all((r["unknown_status"] == "UNKNOWN") == (r["distance"] > c.threshold) for r in rows)
