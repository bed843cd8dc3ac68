"""Joins with the lookups that hold every customer for 31 days."""

import pytest

import __spark_entry__ as E
from test_plans_and_oracle import SF, _children, _planned


def _broadcast_explodes(node, below=False):
    """Explodes below a broadcast: their rows pass through the driver."""
    name = node.getClass().getSimpleName()
    below = below or name == "BroadcastExchangeExec"
    return (below and name == "GenerateExec") + sum(_broadcast_explodes(c, below) for c in _children(node))


@pytest.mark.parametrize("name", ["clean_log", "clean_log_salted", "clerk_clean_log", "polyclinic_clean_log",
                                  "role_two_lookups", "prefer_lookup_participant"])
def test_no_exploded_lookup_is_broadcast(spark, name):
    """Spark's estimate of an exploded lookup is 31 times too small, so a
    broadcast chosen by it fails long before 10 MB of customers."""
    assert not _broadcast_explodes(_planned(E.queries()[name](spark, SF)))


@pytest.mark.parametrize("name", [
    "activity_share_by_role", "activity_summary_by_role", "clean_log_two_exports", "dataset_overview",
    "headcount_by_role", "headcount_by_role_sessions", "location_matrix_by_role", "location_matrix_shown",
    "location_summary_by_role", "location_summary_first_two_exports", "notebook_clean_log"])
def test_no_table_with_roles_broadcasts_an_exploded_lookup(spark, name):
    """The tables pass through the same joins.  Those without a role keep so few
    columns that on this small input the facts of the sessions, joined already,
    are broadcast; they are left out."""
    assert not _broadcast_explodes(_planned(E.queries()[name](spark, SF)))
