"""Row contract, quality gate and data-quality rules.

The contract is compiled from the registry into one array-of-violations column:
a single narrow stage, no Python per row.  Dataset-level rules are aggregate
expressions evaluated in *one* ``agg`` per dataset and unpivoted into a rule
table ``(dataset, rule, observed, threshold, passed)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from terrapanel.functions.text import personal_fields, pii_columns
from terrapanel.registry import Dataset

VIOLATION = "struct<field:string,rule:string,value:string>"


def _violation(field: str, rule: str, bad: Column) -> Column:
    return F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule"),
                                F.col(field).cast("string").alias("value")))


def contract_checks(ds: Dataset, columns: Sequence[str]) -> list[Column]:
    """Violation expressions in contract field order (key, required, optional)."""
    checks = []
    for c in ds.columns:
        if c not in columns:
            if c in ds.key or c in ds.required:
                checks.append(F.struct(F.lit(c).alias("field"), F.lit("missing_column").alias("rule"),
                                       F.lit(None).cast("string").alias("value")))
            continue
        col = F.col(c)
        missing = col.isNull()
        if c in ds.bounds:  # numeric: NaN counts as missing (P19)
            missing = missing | F.coalesce(F.expr(f"isnan(try_cast(`{c}` as double))"), F.lit(False))
        if c in ds.key or c in ds.required or c in ds.defaults:
            checks.append(_violation(c, "missing", missing))
        if c in ds.key and c not in ds.bounds:  # an id of blanks names nothing
            checks.append(_violation(c, "blank", ~missing & (F.trim(col.cast("string")) == "")))
        if c in ds.int_cols:
            d = F.expr(f"try_cast(`{c}` as double)")
            checks.append(_violation(c, "not_integer", ~missing & (d.isNull() | (d != F.floor(d)))))
        b = ds.bounds.get(c)
        if b is not None:
            d = F.expr(f"try_cast(`{c}` as double)")
            if c not in ds.int_cols:  # there it is not_integer already
                checks.append(_violation(c, "not_a_number", ~missing & d.isNull()))
            if b.lo is not None:
                checks.append(_violation(c, "below_min", ~missing & (d < F.lit(float(b.lo)))))
            if b.hi is not None:
                checks.append(_violation(c, "above_max", ~missing & (d > F.lit(float(b.hi)))))
        if c in ds.enums:
            checks.append(_violation(c, "not_allowed", ~missing & ~col.isin(*ds.enums[c])))
    return checks


def to_contract(df: DataFrame, ds: Dataset, text: bool = False) -> DataFrame:
    """V1: the columns that a row of ``ds`` has: defaults for columns the load lacks, other optional ones null,
    columns beyond a closed contract dropped (those that start with an underscore stay).  ``text``: all as text."""
    have = set(df.columns)
    kept = [c for c in df.columns if not ds.closed or c in ds.columns or c.startswith("_")]

    def type_of(c: str) -> str:
        return "string" if text else "bigint" if c in ds.int_cols else "double" if c in ds.bounds else "string"

    added = [(F.lit(ds.defaults[c]) if c in ds.defaults else F.lit(None)).cast(type_of(c)).alias(c)
             for c in ds.optional if c not in have and (c in ds.defaults or ds.closed)]
    return df.select(*[F.col(f"`{c}`") for c in kept], *added)


def validate(df: DataFrame, ds: Dataset) -> DataFrame:
    """Adds ``_violations`` (array, contract order), ``is_valid`` and ``first_error``."""
    checks = contract_checks(ds, df.columns)
    arr = F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast(f"array<{VIOLATION}>")
    out = df.withColumn("_violations", arr)
    return (out.withColumn("is_valid", F.size("_violations") == 0)
               .withColumn("first_error", F.when(F.size("_violations") > 0,
                                                 F.concat_ws(":", F.element_at("_violations", 1).field,
                                                             F.element_at("_violations", 1).rule))))


def validation_report(validated: DataFrame, ds: Dataset) -> DataFrame:
    """One row: total, valid, invalid, pass rate and the ≥ gate (empty → 0.0 → fail)."""
    return validated.agg(
        F.lit(ds.name).alias("dataset"),
        F.count(F.lit(1)).alias("total_rows"),
        F.sum(F.col("is_valid").cast("long")).alias("valid_rows"),
        F.sum((~F.col("is_valid")).cast("long")).alias("invalid_rows"),
    ).select("dataset", "total_rows", F.coalesce("valid_rows", F.lit(0)).alias("valid_rows"),
             F.coalesce("invalid_rows", F.lit(0)).alias("invalid_rows"),
             F.coalesce(F.try_divide(F.col("valid_rows").cast("double"), F.col("total_rows")),
                        F.lit(0.0)).alias("pass_rate")) \
        .withColumn("passed", F.col("pass_rate") >= F.lit(ds.pass_rate)) \
        .withColumn("pass_rate", F.round("pass_rate", 6))  # shown rounded, gated exactly


def first_errors(validated: DataFrame, ds: Dataset, k: int = 20) -> DataFrame:
    """O3: the first ``k`` invalid rows in key order (a per-task top-k, then a
    merge of k rows per task; never the whole error list in one place)."""
    return (validated.where(~F.col("is_valid"))
                     .select(*ds.key, "first_error").orderBy(*ds.key).limit(k))


def key_null_gate(df: DataFrame, ds: Dataset) -> DataFrame:
    """V5 as a status row: rows, max null rate over the gate's columns (key and headline
    measure), passed (rows > 0 and rate ≤ limit).  Run it on the *pre-clean* frame:
    after dropna it can only fail on empty input."""
    key = [c for c in (ds.gate or ds.key) if c in df.columns]
    rates = [F.avg(F.col(c).isNull().cast("double")) for c in key]
    g = df.agg(F.count(F.lit(1)).alias("rows"),
               (F.greatest(*rates) if len(rates) > 1 else rates[0]).alias("max_key_null_rate"))
    return g.select(F.lit(ds.name).alias("dataset"), "rows",
                    F.round(F.coalesce("max_key_null_rate", F.lit(0.0)), 6).alias("max_key_null_rate"),
                    ((F.col("rows") > 0) & (F.coalesce("max_key_null_rate", F.lit(0.0)) <= ds.max_key_null_rate))
                    .alias("passed"))


class QualityGateError(RuntimeError):
    pass


def enforce(status: DataFrame) -> None:
    """Raise if any status row failed (one small action on an aggregated frame)."""
    bad = status.where(~F.col("passed")).limit(1).collect()
    if bad:
        raise QualityGateError(str(bad[0].asDict()))


# -- dataset rules (D4-D16) in one pass ----------------------------------------------------------
STAMP_IN_NAME = r"_(\d{8}T\d{6}Z)\.csv$"


def _row_rules(df: DataFrame, ds: Dataset, complete: bool, as_of: str | None) -> dict[str, tuple[Column, str]]:
    """Per rule what one row adds to it, and how rows fold (sum or max)."""
    cols, out = set(df.columns), {}
    one = lambda bad: F.coalesce(bad.cast("double"), F.lit(0.0))
    for c in ds.key + ds.required:
        if c in cols:
            out[f"nulls_{c}"] = (one(F.col(c).isNull()), "sum")
    if ds.period and ds.period in cols:
        p = F.col(ds.period)
        out["period_lag"] = (p.cast("double"), "max")
        out["period_out_of_range"] = (one(~p.between(1990, 2100)), "sum")
        out["period_not_integer"] = (one(p.cast("double") != F.floor(p)), "sum")
    if complete:
        for c in ds.text_cols:
            if c in cols:
                out[f"blank_{c}"] = (one(F.trim(F.col(c)) == ""), "sum")
        if "_source_file" in cols:
            stamp = F.regexp_extract("_source_file", STAMP_IN_NAME, 1)
            at = F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd'T'HHmmss'Z'"))
            out["file_stamp_invalid"] = (one(at.isNull() | (F.year(at) < 2020)), "sum")
            out["file_age_days"] = (F.datediff(F.lit(as_of).cast("date") if as_of else F.current_date(), at.cast("date")).cast("double"), "max")
    return out


def rule_table(df: DataFrame, ds: Dataset, as_of_year: int,
               expected: DataFrame | None = None, parent_codes: DataFrame | None = None,
               freshness_years: int = 5, complete: bool = False, source_columns: Sequence[str] = (), as_of: str | None = None) -> DataFrame:
    """Every dataset rule from one scan of ``df``: ``(dataset, rule, observed, threshold, passed)``.

    Rows fold to keys (copies of a key, D10), keys to entity codes, which meet the
    codes that ``expected`` and ``parent_codes`` bring (D9, D14), and codes to one
    row, which is unpivoted.  Each step has map-side partials, so a key or code
    that a third of all rows share is one row a task.

    ``expected``: one-column frame of entity codes that must all be present (D9).
    ``parent_codes``: one-column frame of codes the entity column must come from (D14).
    ``complete`` adds: copies of whole rows (D10), blank names (D14), stamps and
    age of files named in ``_source_file`` (D8, D13; age as of the date ``as_of``),
    and, from column names alone, ``source_columns`` that are missing (D4),
    contract columns that are missing (D5), names like those of personal data
    (D15a) and names of personal-data fields (D16).
    """
    v = validate(df, ds)
    per_row = _row_rules(df, ds, complete, as_of)
    fold = {"sum": F.sum, "max": F.max}
    code = F.col(ds.entity)
    rows = v.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(ds.key)], code.alias("__code"),
                    F.col("is_valid").cast("double").alias("__ok"), *[e.alias(n) for n, (e, _) in per_row.items()],
                    *([F.xxhash64(*df.columns).alias("__h1"), F.xxhash64(F.lit(1), *df.columns).alias("__h2")] if complete else []))
    keys = [f"__k{i}" for i in range(len(ds.key))]
    folded = [fold[how](n).alias(n) for n, (_, how) in per_row.items()]
    count = F.count(F.lit(1)).alias("__n")
    if complete:  # equal rows first: they are part of their key's copies
        rows = rows.groupBy(*keys, "__code", "__h1", "__h2").agg(count, F.sum("__ok").alias("__ok"), *folded)
        rows = rows.withColumn("__same", F.when(F.col("__n") > 1, F.col("__n")).otherwise(0))
        count = F.sum("__n").alias("__n")
        folded = [*folded, F.sum("__same").alias("__same")]
    by_key = rows.groupBy(*keys, "__code").agg(count, F.sum("__ok").alias("__ok"), *folded)
    copies = F.sum("__n").alias("__n")
    if ds.entity in ds.key:
        by_key = by_key.withColumn("__dup", F.when(F.col("__n") > 1, F.col("__n")).otherwise(0))
    else:  # a key with several codes is still one key: fold once by key, for its copies, and once by code, for all the rest
        by_key = by_key.withColumn("__kind", F.explode(F.array(F.lit("key"), F.lit("code"))))
        key_side, measures = F.col("__kind") == "key", [c for c in by_key.columns if c not in (*keys, "__code", "__kind")]
        by_key = by_key.select("__kind", *[F.when(key_side, F.col(k)).alias(k) for k in keys], F.when(~key_side, F.col("__code")).alias("__code"), *measures)
        by_key = by_key.groupBy("__kind", *keys, "__code").agg(copies, F.sum("__ok").alias("__ok"), *folded)
        by_key = by_key.withColumn("__dup", F.when(key_side & (F.col("__n") > 1), F.col("__n")).otherwise(0))
        by_key = by_key.select("__code", "__dup", *[F.when(~key_side, F.col(c)).alias(c) for c in measures])
    by_code = by_key.groupBy("__code").agg(copies, F.sum("__ok").alias("__ok"), F.sum("__dup").alias("__dup"), *folded)
    sides = {"__expected": expected, "__parent": parent_codes}
    for name, side in sides.items():  # codes without rows join the fold as empty ones
        by_code = by_code.withColumn(name, F.lit(None).cast("int"))
    for name, side in sides.items():
        if side is not None:
            by_code = by_code.unionByName(side.toDF("__code").select("__code", F.lit(1).alias(name)), allowMissingColumns=True)
    if expected is not None or parent_codes is not None:
        by_code = by_code.groupBy("__code").agg(copies, F.sum("__ok").alias("__ok"), F.sum("__dup").alias("__dup"), *folded,
                                                *[F.max(n).alias(n) for n in sides])
    n = F.coalesce(F.sum("__n"), F.lit(0)).cast("double")
    seen = F.col("__n") > 0
    rules = {"row_count_min": (n, float(ds.row_bounds[0]), ">="), "row_count_max": (n, float(ds.row_bounds[1]), "<="),
             "valid_share": (F.coalesce(F.try_divide(F.sum("__ok"), n), F.lit(0.0)), ds.pass_rate, ">="),
             "duplicate_key_rows": (F.coalesce(F.sum("__dup"), F.lit(0)).cast("double"), 0.0, "<=")}
    limits = {"period_lag": float(freshness_years), "file_age_days": 364.0}
    for name, (_, how) in per_row.items():
        value = fold[how](name)
        rules[name] = (F.lit(float(as_of_year)) - value if name == "period_lag" else value, limits.get(name, 0.0), "<=")
    if expected is not None:
        rules["missing_expected"] = (F.count_if(F.col("__expected").isNotNull() & ~F.coalesce(seen, F.lit(False))).cast("double"), 0.0, "<=")
    if parent_codes is not None:
        rules["orphan_codes"] = (F.count_if(F.coalesce(seen, F.lit(False)) & F.col("__parent").isNull()).cast("double"), 0.0, "<=")
    if complete:
        names = {"missing_source_columns": len(set(source_columns) - set(df.columns)),
                 "missing_contract_columns": len([c for c in ds.columns if c not in df.columns]),
                 "personal_column_names": len(pii_columns(df.columns)), "personal_fields": len(personal_fields(df.columns))}
        rules["duplicate_rows"] = (F.coalesce(F.sum("__same"), F.lit(0)).cast("double"), 0.0, "<=")
        # constants take the row count along, so that they stay part of the one aggregate
        rules |= {name: (F.lit(float(x)) + 0 * n, 0.0, "<=") for name, x in names.items()}
    long = by_code.agg(*[e.alias(name) for name, (e, _, _) in rules.items()]).unpivot([], list(rules), "rule", "observed")
    thr = F.create_map(*[x for name, r in rules.items() for x in (F.lit(name), F.lit(r[1]))])
    op = F.create_map(*[x for name, r in rules.items() for x in (F.lit(name), F.lit(r[2]))])
    long = long.withColumn("threshold", thr[F.col("rule")]).withColumn("__op", op[F.col("rule")])
    passed = F.when(F.col("__op") == ">=", F.col("observed") >= F.col("threshold")).otherwise(
        F.col("observed") <= F.col("threshold"))
    return long.select(F.lit(ds.name).alias("dataset"), "rule", F.round("observed", 6).alias("observed"),
                       "threshold", F.coalesce(passed, F.lit(False)).alias("passed"))


def duplicate_rows(df: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Keys (or full rows) that occur more than once, with their copy count."""
    cols = list(key) if key else df.columns
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def schema_drift(df: DataFrame, ds: Dataset) -> list[tuple[str, str]]:
    """D4/D5/P20 (metadata only, no data read): missing and extra columns."""
    have = set(df.columns)
    want = set(ds.columns)
    return [(c, "missing") for c in ds.columns if c not in have] + \
           [(c, "extra") for c in df.columns if c not in want and not c.startswith("_")]


def conform(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """P20: add missing columns as null, drop extras, cast (try_cast) to the target types."""
    have = set(df.columns)
    return df.select(*[(F.expr(f"try_cast(`{c}` as {t})") if c in have else F.lit(None).cast(t)).alias(c)
                       for c, t in schema.items()])
