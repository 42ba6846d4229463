"""The whole export plan: inventory to filters, names, file and folder actions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyward.operators import export_plan as x
from tallyward.session import written
from tallyward.sources.inventory import file_inventory


def plan_export(attachments: DataFrame, links: DataFrame, parents: dict[str, DataFrame], existing: DataFrame,
                options: x.ExportOptions | None = None, ids: DataFrame | None = None,
                types: DataFrame | None = None) -> dict[str, DataFrame]:
    """Targets, file actions, renames, folder actions and counters.

    Targets are named once and written; every part of the plan reads that table.
    """
    chosen = {k: v for k, v in parents.items() if options is None or not options.types or k in options.types}
    rows = file_inventory(attachments, links, chosen)
    if options is not None:
        rows = x.filter_dates_and_types(rows, options)
    if ids is not None:
        rows = x.filter_ids(rows, ids)
    if types is not None:
        rows = x.filter_types(rows, types)
    targets = written(x.with_targets(rows), "targets")
    files = x.plan_files(targets, existing)
    return {
        "targets": targets, "files": files, "renames": x.plan_file_renames(targets, existing),
        "folders": x.plan_folders(targets, existing), "counters": x.run_counters(files),
    }
