"""The skew-safe running sums equal a plain window, also with one hot group."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from bodega.functions.sequence import number_rows, prefix_sums


def test_prefix_sums_match_window_with_hot_group(spark):
    n = 5000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 17).alias("g"),  # group 0 holds a third
        F.col("id").alias("o"),
        (F.col("id") % 7 - 3).alias("v"))
    got = prefix_sums(df, ["g"], ["o"], {"s": F.col("v")}, inclusive=False, num_partitions=6, hot_rows=1000)
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("g", "o", "v", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"))
    assert sorted(got.collect()) == sorted(want.collect())
    # the hot group really is spread over several partitions
    staged = df.repartitionByRange(6, "g", "o").select("g", F.spark_partition_id().alias("p"))
    assert staged.where("g = 0").select("p").distinct().count() > 1


def test_number_rows_global_and_grouped(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 4).alias("g"))
    glob = number_rows(df, [], ["k"], "rn").collect()
    assert sorted(r.rn for r in glob) == list(range(1, 1001))
    assert all(r.rn == r.k + 1 for r in glob)
    grp = number_rows(df, ["g"], ["k"], "rn", hot_rows=100)
    w = Window.partitionBy("g").orderBy("k")
    want = df.select("k", "g", F.row_number().over(w).alias("rn"))
    assert sorted(grp.collect()) == sorted(want.collect())


def test_plain_window_path_when_no_group_is_hot(spark):
    df = spark.range(300).select((F.col("id") % 10).alias("g"), F.col("id").alias("o"))
    got = number_rows(df, ["g"], ["o"], "rn")
    assert all(r.rn == r.o // 10 + 1 for r in got.collect())


def test_scale_conf_sizes_partitions():
    from bodega.session import scale_conf
    conf = scale_conf(100 * 2 ** 40, executors_cores=8000)           # 100 TiB on 8,000 cores
    assert int(conf["spark.sql.shuffle.partitions"]) == 100 * 2 ** 40 // (256 << 20)
    assert conf["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert int(scale_conf(10 << 20, executors_cores=8)["spark.sql.shuffle.partitions"]) == 16


def test_stored_keeps_rows_in_less_space_than_a_checkpoint(spark):
    from pathlib import Path

    from bodega.functions.sequence import reliable_checkpoint, stored
    from bodega.session import ensure_checkpoint_dir
    df = spark.range(0, 20000, 1, 2).selectExpr("id", "CAST(id % 9 AS DECIMAL(18,4)) AS q", "CAST(NULL AS STRING) AS s", "if(id % 2 = 0, 'n' || id, NULL) AS o")
    root = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in root.rglob("*") if f.is_file())
    at = [size()]
    for keep in (reliable_checkpoint, stored):
        assert sorted(map(tuple, keep(df).collect()))[:50] == sorted(map(tuple, df.collect()))[:50]
        at.append(size())
    assert 2 * (at[2] - at[1]) < at[1] - at[0]
