"""All registered queries."""

from siteprism.plans import q_audit, q_issues, q_keywords, q_monitor, q_pages, q_reports, q_streams, q_templates  # noqa: F401
from siteprism.plans.registry import ORACLES, QUERIES  # noqa: F401
