"""Running sums and row numbers that stay balanced when one group is huge.

A window ``partitionBy(g).orderBy(o)`` puts a whole group into one task; if
one group holds a third of all rows, that task holds a third of the data.
For such groups the rows are range-partitioned on ``(g, o)`` instead, so a
hot group is cut across many partitions. Each partition computes its own
running sums, the per-(group, partition) totals (at most groups +
partitions rows) give each slice its offset, and a join adds the offset
back. Ordinary groups keep the plain window.

The range assignment is written to the session's checkpoint folder once,
so a retried task sees the same partitions as the first attempt.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bodega.session import ensure_checkpoint_dir

_PID = "_seq_pid"


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside send a side to all tasks only if it was measured to be small. The plain
    estimate is the size of compressed files, from which a side of 10 MB may take some hundred
    in the driver's memory."""
    plain, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before, own = spark.conf.get(plain), spark.conf.get(measured, None)
    spark.conf.set(plain, "-1")
    if own is None:
        spark.conf.set(measured, before)
    try:
        yield
    finally:
        spark.conf.set(plain, before)
        if own is None:
            spark.conf.unset(measured)


def unsent(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is planned elsewhere, and so not by ``measured_joins``:
    a part of a stored table whose rows grow with the data is never sent to all tasks."""
    return df.hint("merge")


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    with measured_joins(df.sparkSession):
        return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``reliable_checkpoint``, but as Parquet: several times smaller than the rows a
    checkpoint keeps, and a reader takes the columns it needs."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bodega-stored/{uuid.uuid4().hex}"
    with measured_joins(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_ranges(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence,
                 num_partitions: int | None = None) -> DataFrame:
    """Range-partition on (group, order), tag each row with its partition and
    checkpoint, so the assignment survives retries and can be reused."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    staged = df.repartitionByRange(n, *_cols(group_cols), *_cols(order_cols)).withColumn(_PID, F.spark_partition_id())
    return reliable_checkpoint(staged)


def prefix_sums_staged(staged: DataFrame, group_cols: Sequence[str], order_cols: Sequence,
                       values: dict[str, Column], *, inclusive: bool = True) -> DataFrame:
    """``prefix_sums`` over rows already tagged by ``stage_ranges`` (the tag
    column is dropped from the result)."""
    group = list(group_cols)
    order = _cols(order_cols)
    vnames = list(values)
    base_cols = [c for c in staged.columns if c != _PID]
    rows = staged.select("*", *[v.alias(f"_v_{k}") for k, v in values.items()])

    local_w = (Window.partitionBy(*group, _PID).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = rows.select("*", *[F.sum(f"_v_{k}").over(local_w).alias(f"_l_{k}") for k in vnames])

    totals = rows.groupBy(*group, _PID).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in vnames])
    off_w = Window.partitionBy(*group).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, _PID, *[
        F.coalesce(F.sum(f"_t_{k}").over(off_w), F.lit(0)).alias(f"_o_{k}") for k in vnames])
    if not group:
        # one row per partition: bounded by the partition count
        offsets = F.broadcast(offsets)

    cond = [local[c].eqNullSafe(offsets[c]) for c in group] + [local[_PID] == offsets[_PID]]
    joined = local.join(offsets, cond, "inner")
    outs = []
    for k in vnames:
        run = F.col(f"_o_{k}") + F.col(f"_l_{k}")
        if not inclusive:
            run = run - F.col(f"_v_{k}")
        outs.append(run.alias(k))
    return joined.select(*[local[c] for c in base_cols], *outs)


HOT_GROUP_ROWS = 1_000_000  # a group above this many rows is split across tasks


def _hot_rows(spark) -> int:
    return int(spark.conf.get("bodega.hotGroupRows", str(HOT_GROUP_ROWS)))


def may_have_hot_groups(spark, rows: int) -> bool:
    """Whether a table of so many rows can hold a group above the limit."""
    return rows > _hot_rows(spark)


def window_sums(df: DataFrame, group: Sequence[str], order_cols: Sequence, values: dict[str, Column],
                inclusive: bool = True) -> DataFrame:
    """Running sums with a plain window: for groups known not to be hot."""
    frame = (Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    w = Window.partitionBy(*group).orderBy(*_cols(order_cols)).rowsBetween(*frame)
    return df.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(k) for k, v in values.items()])


SAMPLED_ROWS_PER_HOT_GROUP = 100


def hot_keys(df: DataFrame, group: Sequence[str], hot_rows: int | None = None) -> DataFrame | None:
    """Keys of the groups above about the hot-row limit (checkpointed), or
    None if there are none.

    Counted on a sample in which a group of ``limit`` rows appears about 100
    times, so only a sample's keys are aggregated. The split only picks the
    strategy (both paths are exact): a group near the limit may land on
    either side. At most 2 x rows / limit keys qualify, so they may be
    broadcast."""
    limit = hot_rows or _hot_rows(df.sparkSession)
    fraction = min(1.0, SAMPLED_ROWS_PER_HOT_GROUP / limit)
    rows = df if fraction >= 1.0 else df.sample(fraction=fraction, seed=17)
    cut = limit * fraction if fraction >= 1.0 else SAMPLED_ROWS_PER_HOT_GROUP / 2
    hot = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cut).select(*group)
    hot = reliable_checkpoint(hot)
    return None if hot.limit(1).count() == 0 else hot


def prefix_sums(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence,
                values: dict[str, Column], *, inclusive: bool = True,
                num_partitions: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Add, per name in ``values``, the running sum of that value within the
    group in ``order_cols`` order (current row included unless
    ``inclusive=False``). ``order_cols`` must order rows totally within a
    group, or tied rows must be interchangeable.

    Groups up to ``hot_rows`` rows (conf ``bodega.hotGroupRows``) use a
    plain window; larger ones are range-split across tasks. Finding them is
    one grouped count with map-side combining; there are at most
    rows / hot_rows of them, which bounds the broadcast of their keys."""
    group = list(group_cols)
    if not group:
        staged = stage_ranges(df, group, order_cols, num_partitions)
        return prefix_sums_staged(staged, group, order_cols, values, inclusive=inclusive)
    hot = hot_keys(df, group, hot_rows)
    if hot is None:
        return window_sums(df, group, order_cols, values, inclusive)
    keys = F.broadcast(hot)
    cold = window_sums(df.join(keys, group, "left_anti"), group, order_cols, values, inclusive)
    staged = stage_ranges(df.join(keys, group, "left_semi"), group, order_cols, num_partitions)
    warm = prefix_sums_staged(staged, group, order_cols, values, inclusive=inclusive)
    return cold.select(*df.columns, *values).unionByName(warm.select(*df.columns, *values))


def number_rows(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence,
                name: str = "rn", start: int = 1, hot_rows: int | None = None) -> DataFrame:
    """``row_number()`` within each group, skew-safe."""
    out = prefix_sums(df, group_cols, order_cols, {name: F.lit(1).cast("long")}, hot_rows=hot_rows)
    if start != 1:
        out = out.withColumn(name, F.col(name) + F.lit(start - 1))
    return out


def following(df: DataFrame, group: Sequence[str], order_col: str, conds: dict[str, Column],
              hot: DataFrame | None = None) -> DataFrame:
    """Add, per name in ``conds``, the next value of ``order_col`` in the group at which
    the condition holds (after the row itself; NULL if none). The groups in ``hot`` are
    range-split; a slice then also looks at the first hit of later slices."""
    group = list(group)

    def hits() -> list[Column]:
        return [F.when(c, F.col(order_col)).alias(f"_h_{k}") for k, c in conds.items()]

    def ahead(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(order_col).rowsBetween(1, Window.unboundedFollowing)
        return rows.select("*", *[F.min(f"_h_{k}").over(w).alias(f"_n_{k}") for k in conds])

    cold = df if hot is None else df.join(F.broadcast(hot), group, "left_anti")
    out = ahead(cold.select("*", *hits()), group).select(*df.columns, *[F.col(f"_n_{k}").alias(k) for k in conds])
    if hot is None:
        return out
    staged = stage_ranges(df.join(F.broadcast(hot), group, "left_semi"), group, [order_col]).select("*", *hits())
    first = staged.groupBy(*group, _PID).agg(*[F.min(f"_h_{k}").alias(f"_f_{k}") for k in conds])
    later_w = Window.partitionBy(*group).orderBy(_PID).rowsBetween(1, Window.unboundedFollowing)
    later = first.select(*group, _PID, *[F.min(f"_f_{k}").over(later_w).alias(f"_l_{k}") for k in conds])
    warm = ahead(staged, [*group, _PID]).join(later, [*group, _PID])
    return out.unionByName(warm.select(*df.columns, *[F.coalesce(f"_n_{k}", f"_l_{k}").alias(k) for k in conds]))
