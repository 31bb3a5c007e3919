"""Gated snapshot publish (S13, S14, V4, ST2, D17) on bucketed files.

A snapshot is a manifest over immutable bucket files (``sources.buckets``).  A
publish stages the load once, bucketed by key; the staged files themselves become
the snapshot, and only buckets with something to change beyond the load are
written again: those of withheld rows, or, for a load that holds some keys only,
those it shares with rows that stay.  Readers see the old or the new manifest,
never part of one; a crash before the commit leaves the old one in force.

Any number of publishers may run at once.  One that finds the log moved on takes
the new head as its base: if nobody else changed the buckets of its load, its
files stand; otherwise it compares and merges again.  A published id is never
written again, so a replay changes nothing.

No row vanishes: rows that break the contract, lose to another row of their key,
lack a key, can't be cast to the snapshot's types, or are withheld, go to the
snapshot's rejects with the reason, and are counted in the result.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from terrapanel.operators import quality as Q
from terrapanel.operators import reconcile as R
from terrapanel.operators.window import latest_per_key
from terrapanel.registry import Dataset
from terrapanel.sources.buckets import OUTGROWN, BucketStore, Manifest, bucket_count, bucket_of
from terrapanel.sources.tables import materialize

#: Attempts of one publish against others that come first.
ATTEMPTS = 50
REJECT = "reason string, copies long, row string"


def store(spark: SparkSession, root: str, ds: Dataset) -> BucketStore:
    return BucketStore(spark, f"{root.rstrip('/')}/{ds.name}")


def current_snapshot_id(spark: SparkSession, root: str, ds: Dataset) -> str | None:
    head = store(spark, root, ds).head()
    return None if head is None else head.snapshot


def is_published(spark: SparkSession, root: str, ds: Dataset, snapshot_id: str) -> bool:
    """Whether a manifest has this name, the current one or an earlier one."""
    return store(spark, root, ds).state(snapshot_id)[1]


def _manifest(s: BucketStore, snapshot_id: str | None) -> Manifest | None:
    return s.head() if snapshot_id is None else s.find(snapshot_id)


def read_current(spark: SparkSession, root: str, ds: Dataset, snapshot_id: str | None = None) -> DataFrame | None:
    """The last published snapshot, or the one of this name; None before the first publish."""
    s = store(spark, root, ds)
    m = _manifest(s, snapshot_id)
    return None if m is None else s.read(m)


def read_rejects(spark: SparkSession, root: str, ds: Dataset, snapshot_id: str | None = None) -> DataFrame | None:
    """(reason, copies, row as JSON) of the rows that a publish did not take."""
    m = _manifest(store(spark, root, ds), snapshot_id)
    return None if m is None else spark.read.schema(REJECT).parquet(m.rejects)


def _reject(df: DataFrame, reason: Column, copies: Column | None = None, hidden: tuple[str, ...] = ()) -> DataFrame:
    shown = [c for c in df.columns if c not in hidden]
    return df.select(reason.alias("reason"), (F.lit(1) if copies is None else copies).cast("long").alias("copies"),
                     F.to_json(F.struct(*shown)).alias("row"))


def _losers(rows: DataFrame, winners: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key another row was taken for, equal ones folded with a count ``__copies``.

    Equal rows are folded before anything is joined, and only keys with several
    rows take part, so a row that a third of the load repeats is one row here.
    """
    rest = F.struct(*[c for c in rows.columns if c not in key])
    same = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__copies"))
    several = same.groupBy(*key).agg(F.sum("__copies").alias("__n")).where("__n > 1").drop("__n")
    best = winners.join(several, key, "left_semi").select(*key, rest.alias("__best"))
    left = F.col("__copies") - F.when(rest.eqNullSafe(F.col("__best")), 1).otherwise(0)
    return same.join(best, key).withColumn("__copies", left).where("__copies > 0").drop("__best")


def _types(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def _cast(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` in these columns and types; columns it lacks are null."""
    have = _types(df)
    return df.select(*[(F.lit(None).cast(f.dataType) if f.name not in have
                        else F.col(f.name) if have[f.name] == f.dataType.simpleString() else F.col(f.name).try_cast(f.dataType)).alias(f.name)
                       for f in schema.fields])


def _loses_value(df: DataFrame, schema: StructType) -> Column | None:
    """Whether the cast to ``schema`` would turn a value into null."""
    have = _types(df)
    lost = [F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()
            for f in schema.fields if have.get(f.name, f.dataType.simpleString()) != f.dataType.simpleString()]
    out = None
    for x in lost:
        out = x if out is None else out | x
    return out


def _widened(first: StructType, second: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType) for f in [*first.fields, *(f for f in second.fields if f.name not in first.names)]])


@dataclass
class PublishResult:
    dataset: str
    status: str                 # published | gate_failed | already_published
    snapshot: str | None
    total_rows: int
    valid_rows: int
    pass_rate: float
    rows_compared: int = 0
    anomaly_count: int = 0
    flagged_rows: int = 0
    rejected_rows: int = 0
    rewritten_buckets: int = 0
    attempts: int = 0


class _Staged:
    """A load in bucket files, one row a key, ready to be put over any head of the same layout."""

    def __init__(self, s: BucketStore, load: DataFrame, order: list[str], ds: Dataset, head: Manifest | None, rows: int, partial: bool):
        key = tuple(ds.key)
        columns = [c for c in load.columns if c not in order]
        plain = StructType([f for f in load.schema.fields if f.name in columns])
        if head is None:
            schema = _widened(plain, StructType())
        else:  # a part of the table takes the types that the rest has; a whole one brings its own
            schema = _widened(head.schema, plain) if partial else _widened(plain, head.schema)
        n = bucket_count(rows)
        if head is not None and head.key == key and (partial or n <= OUTGROWN * head.buckets):
            n = head.buckets
        nameless = F.lit(False)
        for k in key:
            nameless = nameless | F.col(k).isNull()
        lost = _loses_value(load, schema)
        refused = nameless if lost is None else nameless | F.coalesce(lost, F.lit(False))
        good = load.where(~refused)
        ranked = order or [c for c in columns if c not in key]
        best = latest_per_key(good, list(key), ranked) if ranked else good.dropDuplicates(list(key))
        # every task of the write is one bucket and writes one sorted file
        self.gen, self.rows = s.write(_cast(best.select(*columns), schema).repartition(n, *key), key, n)
        self.manifest = Manifest("", n, key, schema, {b: (self.gen, c) for b, c in self.rows.items()})
        self.partial = partial
        self.rejects: list[DataFrame] = []
        bad = load.where(refused)
        refusals = bad.count() if rows > self.manifest.rows else 0
        if refusals:
            self.rejects.append(_reject(bad.select(*columns).withColumn("__no", F.when(nameless, "null_key").otherwise("type")), F.col("__no"), hidden=("__no",)))
        if rows > self.manifest.rows + refusals:
            losers = _losers(_cast(good.select(*columns), schema), s.read(self.manifest), list(key))
            self.rejects.append(_reject(losers, F.lit("duplicate_key"), F.col("__copies"), ("__copies",)))

    def fits(self, head: Manifest | None) -> bool:
        """Whether the staged files still have the layout and columns that this head asks for."""
        if head is None:
            return True
        own = {f.name: f.dataType for f in self.manifest.schema.fields}
        if not self.partial:
            return all(f.name in own for f in head.schema.fields)
        return head.buckets == self.manifest.buckets and all(own.get(f.name) == f.dataType for f in head.schema.fields)


@dataclass
class _Merged:
    """A staged load over one head: the manifest without name and number, buckets written again, withheld rows."""

    manifest: Manifest
    again: set[int] = field(default_factory=set)
    held: DataFrame | None = None
    rows_compared: int = 0
    anomaly_count: int = 0
    flagged_rows: int = 0


def _merge(s: BucketStore, staged: _Staged, head: Manifest | None, ds: Dataset, on_flag: str | None) -> _Merged:
    """Compare the staged load with ``head`` (``on_flag`` None: take it as it is) and write what has to change."""
    new = staged.manifest
    if head is None or not head.live:
        return _Merged(new)
    key = list(new.key)
    same_layout = head.buckets == new.buckets and head.key == new.key
    # few buckets: their files alone; many: by bucket, which joins without an exchange
    aligned = lambda k: same_layout and 4 * k >= new.buckets
    out = _Merged(new)
    if on_flag is not None:
        at = set(new.live) if same_layout else None
        by = aligned(len(new.live))
        old = _cast(s.read(head, at, bucketed=by), new.schema)
        compared = R.compare(s.read(new, bucketed=by), old, ds)
        held = materialize(compared.where(F.size("_anomalies") > 0).drop("_matched"), f"withheld_{ds.name}")
        found = held.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_anomalies")), F.lit(0))).first()
        out.rows_compared, out.flagged_rows, out.anomaly_count = new.rows, found[0], found[1]
        out.held = held if found[0] else None
    if out.held is not None:
        out.again |= {r["b"] for r in out.held.select(bucket_of(new.key, new.buckets).alias("b")).distinct().collect()}
    if staged.partial:
        out.again |= set(new.live) & set(head.live)
    base = replace(head, schema=new.schema) if staged.partial else replace(new, live={})
    rest = {b: n for b, n in staged.rows.items() if b not in out.again}
    out.manifest = base.with_live(staged.gen, rest, out.again)
    if out.again:
        by = aligned(len(out.again))
        old = s.read(head, out.again if same_layout else None, bucketed=by)
        if not same_layout:
            old = old.where(bucket_of(new.key, new.buckets).isin(*sorted(out.again)))
        keys = None if out.held is None else out.held.select(*key)
        rows = R.merge(s.read(new, out.again, bucketed=by), _cast(old, new.schema), key, keys, on_flag != "drop", staged.partial)
        gen, written = s.write(rows if by else rows.repartition(len(out.again), bucket_of(new.key, new.buckets)), new.key, new.buckets)
        out.manifest = out.manifest.with_live(gen, written)
    return out


def _publish(s: BucketStore, load: DataFrame, order: list[str], ds: Dataset, snapshot_id: str, rows: int, res: PublishResult,
             partial: bool = False, on_flag: str | None = None, rejects: DataFrame | None = None) -> PublishResult:
    """Stage, merge and commit; from the merge again whenever another publisher came first."""
    try:
        return _attempts(s, load, order, ds, snapshot_id, rows, res, partial, on_flag, rejects)
    finally:
        s.forget()


def _attempts(s: BucketStore, load: DataFrame, order: list[str], ds: Dataset, snapshot_id: str, rows: int, res: PublishResult,
              partial: bool, on_flag: str | None, rejects: DataFrame | None) -> PublishResult:
    staged = done = base = None
    for attempt in range(1, ATTEMPTS + 1):
        head, published = s.state(snapshot_id)
        if published:
            return PublishResult(ds.name, "already_published", snapshot_id, 0, 0, 0.0)
        if staged is None or not staged.fits(head):
            staged, done = _Staged(s, load, order, ds, head, rows, partial), None
        before = base.live if base is not None else {}
        if done is not None and partial and head is not None and all(before.get(b) == head.live.get(b) for b in staged.rows):
            # others changed other buckets only: the files stand, over the new head
            own = {b: at for b, at in done.manifest.live.items() if b in staged.rows}
            kept = {b: at for b, at in head.live.items() if b not in staged.rows}
            done.manifest = replace(done.manifest, live=kept | own)
        else:
            done = _merge(s, staged, head, ds, on_flag)
        parts = [*staged.rejects, *([] if rejects is None else [rejects])]
        if done.held is not None:
            why = F.concat(F.lit("withheld:"), F.array_join(F.transform("_anomalies", lambda a: a["column"]), ","))
            parts.append(_reject(done.held, why, hidden=("_anomalies",)))
        path = f"{s.base}/snapshot={snapshot_id}/rejects-{staged.gen}-{attempt}"
        out = s.spark.createDataFrame([], REJECT)
        for p in parts:
            out = out.unionByName(p)
        out.write.parquet(path)
        if s.commit(replace(done.manifest, snapshot=snapshot_id, rejects=path), head):
            res.status, res.snapshot, res.attempts, res.rewritten_buckets = "published", snapshot_id, attempt, len(done.again)
            res.rows_compared, res.anomaly_count, res.flagged_rows = done.rows_compared, done.anomaly_count, done.flagged_rows
            res.rejected_rows = s.spark.read.schema(REJECT).parquet(path).agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
            return res
        base = head
    raise RuntimeError(f"{ds.name}: {ATTEMPTS} attempts to publish {snapshot_id} came second")


def publish(new: DataFrame, root: str, ds: Dataset, snapshot_id: str, on_flag: str = "keep_previous", partial: bool = False) -> PublishResult:
    """Contract columns → validate → (gate) → reconcile with the current snapshot → commit the promoted table.

    Gate failure publishes nothing (readers keep the previous snapshot).  Of valid
    rows that share a key, one is published (the greatest by its other columns).
    ``partial``: the load holds some keys only, and keys that it lacks keep their
    rows; else the load replaces the table.  ``on_flag``: ``keep_previous`` (the
    key keeps its previous row) or ``drop``.  Columns that only one side has are
    null on the other.  Publishing an id again returns "already_published".
    """
    if on_flag not in ("keep_previous", "drop"):
        raise ValueError(on_flag)
    s = store(new.sparkSession, root, ds)
    if s.state(snapshot_id)[1]:
        return PublishResult(ds.name, "already_published", snapshot_id, 0, 0, 0.0)
    validated = materialize(Q.validate(Q.to_contract(new, ds), ds), f"staged_{ds.name}")
    rep = Q.validation_report(validated, ds).first()
    res = PublishResult(ds.name, "gate_failed", None, rep["total_rows"], rep["valid_rows"], rep["pass_rate"])
    if not rep["passed"]:
        return res
    marks = ("_violations", "is_valid", "first_error")
    broken = None
    if rep["invalid_rows"]:
        broken = _reject(validated.where(~F.col("is_valid")), F.concat(F.lit("contract:"), "first_error"), hidden=marks)
    return _publish(s, validated.where("is_valid").drop(*marks), [], ds, snapshot_id, rep["valid_rows"], res, partial, on_flag, broken)


def write_snapshot(df: DataFrame, root: str, ds: Dataset, snapshot_id: str) -> PublishResult:
    """Replace the table by ``df`` without contract or reconciliation (one row a key, the greatest by its other columns)."""
    s = store(df.sparkSession, root, ds)
    if s.state(snapshot_id)[1]:
        raise ValueError(f"snapshot {snapshot_id} of {ds.name} is published; snapshots are never rewritten")
    rows = materialize(df, f"staged_{ds.name}")
    n = rows.count()
    return _publish(s, rows, [], ds, snapshot_id, n, PublishResult(ds.name, "published", None, n, n, 1.0))


def upsert_snapshot(batch: DataFrame, root: str, ds: Dataset, snapshot_id: str,
                    order_by: tuple[str, ...] = ("_ingested_at", "_row_seq")) -> PublishResult:
    """ST2: idempotent upsert by key: the latest row of each key in the batch replaces that key's row.

    Only the buckets of the batch's keys are read and written.  Replaying the same
    batch changes nothing (same id), and two batches may run at once.  Columns
    that start with an underscore order the rows or describe the load, and are
    not stored.
    """
    s = store(batch.sparkSession, root, ds)
    if s.state(snapshot_id)[1]:
        return PublishResult(ds.name, "already_published", snapshot_id, 0, 0, 0.0)
    order = [c for c in order_by if c in batch.columns]
    rows = materialize(batch.select(*[c for c in batch.columns if c in order or not c.startswith("_")]), f"staged_{ds.name}")
    n = rows.count()
    return _publish(s, rows, order, ds, snapshot_id, n, PublishResult(ds.name, "published", None, n, n, 1.0), partial=True)
