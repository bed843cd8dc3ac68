"""Run one site's cleaning chain and write its report bundle.

    python -m shiftlog --site hospital_staff \\
        --export staff_v1=exports/v1/ --export staff_v2=exports/v2/ \\
        --lookup lookups/roles.csv --out /shared/reports/hospital_staff [--overview]

Sites and their corrections are in ``shiftlog.plans.sites``.  A second
``--lookup`` is used as a fallback (clerk site); ``--overview`` also cleans the
exports by the site's notebook chain and writes that notebook's overview tables.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from shiftlog.plans import sites
from shiftlog.plans.cleaning import CleaningConfig, Export, clean_log
from shiftlog.plans.reports import (Overview, overview_bundle, patient_bundle, staff_bundle,
                                    write_bundle)
from shiftlog.session import get_spark
from shiftlog.sources.readers import read_activity_log, read_lookup
from shiftlog.sources.sinks import stage


@dataclass(frozen=True)
class Site:
    """A site's script (chain and report bundle) and notebook (chain and what
    it shows); ``role_required``: rows of later exports without a role belong
    to other sites."""

    script: CleaningConfig
    bundle: Callable[[DataFrame], dict[str, DataFrame]]
    notebook: CleaningConfig | None = None
    overview: Overview | None = None
    role_required: bool = False


SITES = {
    "hospital_staff": Site(sites.REFERENCE_HOSPITAL_STAFF, staff_bundle,
                           sites.REFERENCE_HOSPITAL_NOTEBOOK, sites.HOSPITAL_OVERVIEW, True),
    "polyclinic_staff": Site(sites.REFERENCE_POLYCLINIC_STAFF, staff_bundle,
                             sites.REFERENCE_POLYCLINIC_NOTEBOOK, sites.POLYCLINIC_OVERVIEW),
    "clerk": Site(sites.REFERENCE_CLERK, lambda log: staff_bundle(log, clerk=True),
                  sites.REFERENCE_CLERK_NOTEBOOK, sites.CLERK_OVERVIEW),
    "patient": Site(sites.REFERENCE_PATIENT, patient_bundle),
}


def _lookups(spark, paths: Sequence[str], cfg: CleaningConfig):
    columns = {"health_professional_desc": "role"}
    if cfg.participant_from_lookup:
        columns["participant_id_2"] = "participant_id_2"
    return [read_lookup(spark, p, columns) for p in paths] or None


def main(argv=None) -> dict[str, str]:
    ap = argparse.ArgumentParser(prog="shiftlog")
    ap.add_argument("--site", required=True, choices=sorted(SITES))
    ap.add_argument("--export", action="append", required=True, metavar="FORM=PATH",
                    help="an export folder / file / glob and its layout; the first one "
                         "gets the raw-stage corrections")
    ap.add_argument("--lookup", action="append", default=[], metavar="PATH")
    ap.add_argument("--out", required=True)
    ap.add_argument("--overview", action="store_true")
    args = ap.parse_args(argv)
    site = SITES[args.site]
    if args.overview and site.notebook is None:
        ap.error(f"the site {args.site} has no overview")

    spark = get_spark(app=f"shiftlog-{args.site}")
    out = args.out.rstrip("/")
    exports = []
    for i, spec in enumerate(args.export):
        form, path = spec.split("=", 1)
        # typed scan staged once as parquet: the chain's branches then read
        # only their columns, and lineage stops at the staged copy
        df = stage(read_activity_log(spark, path, form), f"{out}/staged/export_{i}")
        # as the reference: corrections on the first export
        exports.append(Export(df, require_role=i > 0 and bool(args.lookup) and site.role_required,
                              apply_raw=i == 0))
    # the processed log is written once; every table is built from that copy
    log = clean_log(exports, site.script, _lookups(spark, args.lookup, site.script))
    paths = write_bundle(log, site.bundle, out)
    if args.overview:
        lookups = _lookups(spark, args.lookup, site.notebook)
        log = clean_log(exports, site.notebook, lookups)
        show = site.overview
        if lookups is None and show.role:
            show = replace(show, role=None)
        tables = write_bundle(log, lambda written: overview_bundle(written, show), f"{out}/overview")
        paths |= {f"overview_{name}": path for name, path in tables.items()}
    for name, path in paths.items():
        print(f"{name}\t{path}")
    return paths


if __name__ == "__main__":
    main()
