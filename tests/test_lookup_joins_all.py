"""The lookup that holds every customer for 31 days is never broadcast itself."""

import pytest

import __spark_entry__ as E
from test_plans_and_oracle import SF, _children, _planned


def _lookup_broadcasts(node, below=False):
    """Explodes that only steps row by row part from a broadcast.  A join or a
    shuffle between them ends the search: small facts of the sessions, joined
    to the lookup already, may be broadcast."""
    name = node.getClass().getSimpleName()
    kids = _children(node)
    if name == "BroadcastExchangeExec":
        below = True
    elif "Exchange" in name or len(kids) > 1:
        below = False
    return (below and name == "GenerateExec") + sum(_lookup_broadcasts(c, below) for c in kids)


@pytest.mark.parametrize("name", [
    "activity_share_by_role",
    "activity_summary",
    "activity_summary_by_role",
    "clean_log",
    "clean_log_from_tables",
    "clean_log_salted",
    "clean_log_two_exports",
    "clerk_clean_log",
    "dataset_overview",
    "headcount_by_role",
    "headcount_by_role_sessions",
    "location_long",
    "location_matrix",
    "location_matrix_by_role",
    "location_matrix_shown",
    "location_summary",
    "location_summary_by_role",
    "location_summary_first",
    "location_summary_first_two_exports",
    "notebook_clean_log",
    "observer_summary",
])
def test_no_customer_lookup_is_broadcast_itself(spark, name):
    assert not _lookup_broadcasts(_planned(E.queries()[name](spark, SF)))
