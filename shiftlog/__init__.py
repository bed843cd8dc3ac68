"""shiftlog: time-and-motion activity-log analytics on Spark.

One row per observed activity, many activities per session, many sessions
per observer.  Every operator is a ``DataFrame -> DataFrame`` function built
from Spark's own DataFrame functions, so the whole library runs inside
Catalyst / whole-stage codegen and scales with the cluster.

Layout
------
``functions``  column-level helpers (time text, rounding, NA-aware aggregates,
               flag folding, chart labels)
``sources``    typed CSV scans, lookup scans, sinks, form specs, and the
               activity log derived from the test tables
``operators``  cleaning, joins, enrichment, summaries and breakdowns
``plans``      the cleaning chains and report bundles that compose operators
``streaming``  the same cleaning chain applied to exports arriving in a folder
"""

from shiftlog.session import get_spark, scratch_dir  # noqa: F401

__all__ = ["get_spark", "scratch_dir"]
