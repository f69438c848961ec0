"""Every registered query against its SQL; those without SQL have tests of their own values."""

from __future__ import annotations

import pytest

from chronoloom.plans import queries as plans

from .oracle import compare

#: Held against plain versions in test_reports.py.
BY_HAND = {"clean_code_findings", "lexical_suite", "lexical_pages", "findings_ranked", "compound_rules", "severity_counts", "report_payload", "technical_report", "security_report", "pm_report", "code_review_report"}


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_as_sql(spark, name):
    rows = compare(spark, plans.QUERIES[name], plans.ORACLES[name])
    assert rows or name in ("changed_comments", "secret_candidates", "mega_commits", "drift_smells", "velocity_anomalies")


def test_no_query_without_a_test():
    assert set(plans.QUERIES) - set(plans.ORACLES) == BY_HAND


