"""The DDL's constraints checked as queries, reported as a table.

One scan per table computes its NOT NULL, length and primary-key rules
together (a grouped count per key, then one total, unpivoted); a table's
foreign keys are checked in one chain of left joins and one aggregate.
Output: (table_name, rule, columns, violations).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bodega.sources import schemas as S


def _row_checks(name: str, df: DataFrame) -> list[tuple[str, str, Column]]:
    checks = []
    for c in S.NOT_NULL.get(name, []):
        if c in df.columns:
            checks.append(("not_null", c, F.col(c).isNull()))
    for c, n in S.MAX_LENGTH.get(name, {}).items():
        if c in df.columns:
            checks.append((f"max_length_{n}", c, F.length(c) > n))
    return checks


def _table_rules(name: str, df: DataFrame) -> DataFrame | None:
    """NOT NULL, length and primary-key rules of one table in one scan.

    With a key, rows are first counted per key value (map-side combining,
    so a repeated key costs one partial row per task) together with the
    per-key counts of each row rule; a second, global aggregate adds them
    up. Without a key, one global aggregate."""
    checks = _row_checks(name, df)
    key = S.PRIMARY_KEY.get(name)
    if key and not all(k in df.columns for k in key):
        key = None
    if not checks and not key:
        return None
    rule_cols = [F.count(F.when(cond, 1)).alias(f"r{i}") for i, (_, _, cond) in enumerate(checks)]
    out = [(rule, col, f"r{i}") for i, (rule, col, _) in enumerate(checks)]
    if key:
        per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *rule_cols)
        null_key = F.lit(False)
        for k in key:
            null_key = null_key | F.col(k).isNull()
        dup = F.when(null_key, F.col("_n")).when(F.col("_n") > 1, F.col("_n") - 1).otherwise(0)
        agg = per_key.agg(F.coalesce(F.sum(dup), F.lit(0)).alias("pk"),
                          *[F.coalesce(F.sum(f"r{i}"), F.lit(0)).alias(f"r{i}") for i in range(len(checks))])
        out.append(("primary_key", ",".join(key), "pk"))
    else:
        agg = df.agg(*rule_cols)
    stack = ", ".join(f"'{rule}', '{col}', CAST({ref} AS BIGINT)" for rule, col, ref in out)
    return agg.select(F.lit(name).alias("table_name"),
                      F.expr(f"stack({len(out)}, {stack}) AS (rule, columns, violations)"))


def _fk_rules(name: str, df: DataFrame, fks: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """All foreign keys of one table in one pass: each referenced table is
    reduced to its distinct keys and left-joined in turn (small ones are
    broadcast once measured), then one aggregate counts the misses."""
    cols = sorted({c for c, _, _, _ in fks})
    x = df.select(*cols)
    for i, (col, ref, ref_col, _) in enumerate(fks):
        keys = ref.select(F.col(ref_col).alias(f"_ref{i}")).distinct().withColumn(f"_hit{i}", F.lit(True))
        x = x.join(keys, x[col] == keys[f"_ref{i}"], "left").drop(f"_ref{i}")
    agg = x.agg(*[F.count(F.when(F.col(c).isNotNull() & F.col(f"_hit{i}").isNull(), 1)).alias(f"r{i}")
                  for i, (c, _, _, _) in enumerate(fks)])
    stack = ", ".join(f"'foreign_key:{rn}.{rc}', '{c}', r{i}" for i, (c, _, rc, rn) in enumerate(fks))
    return agg.select(F.lit(name).alias("table_name"),
                      F.expr(f"stack({len(fks)}, {stack}) AS (rule, columns, violations)"))


def check_constraints(d: dict[str, DataFrame]) -> DataFrame:
    """Every rule of ``bodega.sources.schemas`` whose tables are in ``d``."""
    parts = []
    for name, df in d.items():
        r = _table_rules(name, df)
        if r is not None:
            parts.append(r)
    by_table: dict[str, list] = {}
    for t, c, rt, rc in S.FOREIGN_KEYS:
        if t in d and rt in d and c in d[t].columns:
            by_table.setdefault(t, []).append((c, d[rt], rc, rt))
    for t, fks in by_table.items():
        parts.append(_fk_rules(t, d[t], fks))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table_name", "rule", "columns", F.col("violations").cast("long").alias("violations"))


def orphans(df: DataFrame, col: str, ref: DataFrame, ref_col: str) -> DataFrame:
    """The rows themselves whose ``col`` points nowhere (for repair or review)."""
    keys = ref.select(F.col(ref_col).alias("_ref")).distinct()
    return df.where(F.col(col).isNotNull()).join(keys, F.col(col) == F.col("_ref"), "left_anti")
