"""Named queries over the adapter views, one module per part of the inventory."""

from repohealth.plans import compare_plans, file_plans, finding_plans, graph_plans, history_plans  # noqa: F401
from repohealth.plans import rule_plans, scan_plans, shape_plans, tool_plans, work_plans  # noqa: F401
from repohealth.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
