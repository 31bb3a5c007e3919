"""One call from a pulled file to the published table of a dataset.

land → newest run → clean → key-null gate → validate, reconcile and publish →
optional CSV export and managed table.  Each step is the library function of
that name; a failed gate raises or publishes nothing, and readers keep the
previous snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from terrapanel.operators import quality as Q
from terrapanel.operators.clean import clean
from terrapanel.registry import Dataset
from terrapanel.sources import files as FS
from terrapanel.sources import publish as P


def run_dataset(raw: DataFrame, root: str, ds: Dataset, run_id: str | None = None, mode: str = "live", on_flag: str = "keep_previous",
                order_by: Sequence[str] = ("_row_seq",), export: str | None = None, namespace: str | None = None) -> P.PublishResult:
    """Land ``raw`` (a frame read from files) as run ``run_id`` and publish it.

    The run id names the snapshot too, so running a pull again changes nothing:
    a run that has landed is not landed again.
    ``export`` writes the published table as CSV; ``namespace`` replaces the
    managed table ``<namespace>.<dataset>``.
    """
    spark = raw.sparkSession
    run_id = run_id or FS.run_stamp()
    if FS.read_run(spark, root, ds.name, run_id) is None:
        FS.land(FS.with_lineage(raw, mode).drop("_run_id"), root, ds.name, run_id)
    landed = FS.read_run(spark, root, ds.name, run_id)
    Q.enforce(Q.key_null_gate(landed, ds))
    result = P.publish(clean(landed, ds, order_by=order_by), f"{root.rstrip('/')}/published", ds, run_id, on_flag)
    table = P.read_current(spark, f"{root.rstrip('/')}/published", ds)
    if result.status == "published" and export:
        FS.export_csv(table, export)
    if result.status == "published" and namespace:
        FS.ensure_namespace(spark, namespace)
        FS.replace_table(table, f"`{namespace}`.`{ds.name}`")
    return result
