"""Bench: headline reports over the activity log derived from ``lineitem``.

The lineitem-derived log is first written (untimed) as CSV exports in the
staff layout plus a ';' role lookup -- what a site run starts from.
``clean_log`` times the typed CSV scan (staged once as parquet), the
cleaning chain and the written processed dataset; every report is then timed from that dataset to its full
result (a ``noop`` write, so nothing is collected to the driver).
The whole pass runs once cold and then ``BENCH_RUNS`` (default 3) times
warm in one process; each query's best warm time is reported and the cold
pass total is added as ``cold_pass_total``.  Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from shiftlog import get_spark, scratch_dir  # noqa: E402
from shiftlog.operators import breakdowns as B  # noqa: E402
from shiftlog.operators import summaries as S  # noqa: E402
from shiftlog.plans.cleaning import CleaningConfig, Export, clean_log  # noqa: E402
from shiftlog.plans.sites import LINEITEM_LOCATION_COLUMNS  # noqa: E402
from shiftlog.sources.readers import read_activity_log, read_lookup, to_export  # noqa: E402
from shiftlog.sources.sinks import stage, write_processed  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from shiftlog.sources.testlog import activity_log_from_lineitem, role_lookup_from_orders  # noqa: E402

LINEITEM = CleaningConfig(dataset="lineitem", form="staff_v1")


def lineitem_log(spark, sf_dir):
    """Cleaned log straight from the tables (the derived source computes the
    session bounds itself)."""
    return clean_log([Export(activity_log_from_lineitem(spark, sf_dir))], LINEITEM,
                     role_lookup_from_orders(spark, sf_dir))


def prepare_exports(spark, sf_dir) -> tuple[str, str]:
    """Write the lineitem-derived log as CSV exports in the staff layout
    (H:M:S text, raw header names) and the orders lookup as a ';' CSV: the
    inputs a site run starts from.  Untimed data preparation."""
    base = scratch_dir(spark, "bench_exports")
    (to_export(activity_log_from_lineitem(spark, sf_dir), "staff_v1")
     .write.option("header", True).csv(f"{base}/exports"))
    (role_lookup_from_orders(spark, sf_dir)
     .select(F.col("session_id").alias("session id"),
             F.col("role").alias("health_professional_desc"))
     .write.option("header", True).option("sep", ";").csv(f"{base}/lookup"))
    return f"{base}/exports", f"{base}/lookup"


def clean_from_exports(spark, exports: str, lookup: str):
    """Typed scan of the exports, staged once as parquet, then the chain."""
    log = stage(read_activity_log(spark, exports, "staff_v1"), scratch_dir(spark, "bench_staged"))
    return clean_log([Export(log)], LINEITEM, read_lookup(spark, lookup))


HEADLINE = {
    "observer_summary": S.observer_summary,
    "activity_summary": S.activity_summary,
    "activity_summary_by_role": lambda log: S.activity_summary(log, per_session=True,
                                                               role="role"),
    "activity_share": B.activity_share,
    "subcategory_share": B.subcategory_share,
    "waiting_time": S.waiting_time,
    "provider_contact_time": S.provider_contact_time,
    "session_times": S.session_times,
    "session_detail": S.session_detail,
    "tool_by_activity": B.tool_time,
    "location_summary": B.location_summary,
    "location_matrix": lambda log: B.location_matrix(log, LINEITEM_LOCATION_COLUMNS,
                                                     role="role"),
    "dataset_overview": lambda log: B.dataset_overview(log, role="role"),
}


def run(df):
    df.write.format("noop").mode("overwrite").save()


def one_pass(spark, exports: str, lookup: str) -> dict[str, float]:
    """Clean the exports once and write the processed dataset (as the
    reference's scripts do), then run every report from it: column-pruned,
    already cleaned."""
    times = {}
    t0 = time.perf_counter()
    path = write_processed(clean_from_exports(spark, exports, lookup),
                           scratch_dir(spark, "bench_processed"), partition_by=())
    times["clean_log"] = round(time.perf_counter() - t0, 3)
    for name, fn in HEADLINE.items():
        t0 = time.perf_counter()
        run(fn(spark.read.parquet(path)))
        times[name] = round(time.perf_counter() - t0, 3)
    return times


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(master=f"local[{cpus}]", app="shiftlog-bench",
                      shuffle_partitions=int(cpus))
    # One untimed pass first: JVM class loading, JIT and Spark's generated-code
    # cache are one-time costs per process; the timed pass measures
    # steady-state throughput of the same queries on the same data.
    exports, lookup = prepare_exports(spark, sf_dir)
    cold = one_pass(spark, exports, lookup)
    runs = [one_pass(spark, exports, lookup) for _ in range(int(os.environ.get("BENCH_RUNS", "3")))]
    # best of the warm runs per query (as timeit does): the machine's noise
    # only ever adds time
    times = {q: min(r[q] for r in runs) for q in runs[0]}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds_warm_jvm",
                      "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf,
                      "cold_pass_total": round(sum(cold.values()), 3),
                      "warm_runs": len(runs)}))
    spark.stop()


if __name__ == "__main__":
    main()
