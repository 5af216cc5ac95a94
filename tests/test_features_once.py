"""Page features are written once where several branches of a query read them."""

from __future__ import annotations

import pytest

from siteprism.common import materialize
from siteprism.operators import audit
from siteprism.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["check_039", "check_055", "t05_template_profile", "t06_template_names", "t10_unclassified_pages", "t12_template_report"])
def test_html_is_not_parsed_by_every_branch(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "</nav>" not in plan  # part of the markup that the derived pages add


@pytest.mark.parametrize("name", ["a08_quick_wins", "a16_report_issue_union", "r04_category_listing"])
def test_no_hits_are_written_where_no_lists_are_shown(spark, name, monkeypatch):
    written = []
    monkeypatch.setattr(audit, "materialize", lambda df: written.append(df.columns) or materialize(df))
    catalog.QUERIES[name](spark, SF)
    assert not [c for c in written if "metric" in c]
