"""Typed scans (E10), JSON order requests in (E11), results out (E12), and
versioned snapshots for the maintenance jobs."""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bodega.sources.schemas import DDL, REQUEST_DDL


def open_tables(spark: SparkSession, root: str, names=None, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Every table under ``root/<name>`` with its declared schema.

    A declared schema skips inference (no extra job listing footers) and
    keeps types stable across versions written by different jobs."""
    out = {}
    for name in names or DDL:
        out[name] = spark.read.schema(DDL[name]).format(fmt).load(f"{root.rstrip('/')}/{name}")
    return out


def open_jdbc_table(spark: SparkSession, url: str, table: str, name: str, key: str,
                    lower: int, upper: int, partitions: int, properties: dict | None = None) -> DataFrame:
    """E10 over a database: a parallel read split on an integer key range,
    one connection per partition, then cast to the declared schema."""
    df = spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper,
                         numPartitions=partitions, properties=properties or {})
    declared = spark.createDataFrame([], DDL[name]).schema
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in declared.fields])


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON order requests (one object per line, nested ``items``).

    Malformed records are kept in ``_corrupt_record`` rather than failing
    the job; they become rejects downstream."""
    ddl = REQUEST_DDL + ", _corrupt_record STRING"
    return (spark.read.schema(ddl)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSS]")
            .json(path))


def flatten_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested requests -> (headers, items with their 1-based position).

    One request body is small (it came through one HTTP call); exploding
    it is per-row work with no shuffle."""
    head_cols = [c for c in requests.columns if c not in ("items",)]
    headers = requests.select(*head_cols)
    items = requests.select("request_id", F.posexplode_outer("items").alias("p", "it")).where(
        F.col("it").isNotNull()).select(
        "request_id", (F.col("p") + 1).cast("long").alias("pos"),
        F.col("it.product_id").alias("product_id"),
        F.col("it.quantity").alias("quantity"),
        F.col("it.unit_price").alias("unit_price"))
    return headers, items


def split_malformed(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``read_requests`` read -> (whole requests, answers to the others).

    A body that is not JSON, or whose fields are not of the declared types, is answered
    'malformed' with the body as it came; its ``request_id`` is whatever could be read."""
    corrupt = F.col("_corrupt_record")
    good = requests.where(corrupt.isNull()).drop("_corrupt_record")
    return good, requests.where(corrupt.isNotNull()).select(
        "request_id", F.lit("malformed").alias("reason"), corrupt.alias("body"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the shared store holds ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def ensure_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> bool:
    """``CREATE TABLE IF NOT EXISTS``: write an empty table with the declared
    schema when ``root/name`` is absent; leave an existing one alone.
    Returns True when it created the table."""
    path = f"{root.rstrip('/')}/{name}"
    if exists(spark, path):
        return False
    spark.createDataFrame([], DDL[name]).write.format(fmt).save(path)
    return True


def write_result(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Write a result as JSON lines (the reply format) or Parquet."""
    df.write.mode(mode).format(fmt).save(path)


def read_appended(spark: SparkSession, root: str, table: str, schema) -> DataFrame:
    """Every row of an appended table, with the ``batch`` that brought it."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return spark.read.schema(f"{fields}, batch STRING").parquet(f"{root.rstrip('/')}/{table}")


def append_batch(df: DataFrame, root: str, table: str, batch: str, key: list[str]) -> tuple[int, DataFrame]:
    """``INSERT ... SELECT`` into a table that may be filled: -> (rows written, refused rows).

    The rows go to ``root/table/batch=<batch>``. A batch that is loaded again replaces its
    own folder only and never compares itself with what it wrote before, so twice is once
    (one loader at a time). Refused are rows whose key another batch holds, rows that share
    a key within the batch, and rows without a whole key; where a primary key would end the
    whole statement, the other rows are kept here. The number written is observed by the
    write itself. Keys are counted with map-side combining before they meet the rows, so a
    key shared by very many rows is one row there."""
    spark, cols = df.sparkSession, df.columns
    if not exists(spark, f"{root.rstrip('/')}/{table}"):
        raise FileNotFoundError(f"{root}/{table}: an append needs an existing table (ensure_table)")
    held = read_appended(spark, root, table, df.schema).where(F.col("batch") != batch).select(*key)
    fresh = (df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n").join(held, key, "left_anti"))
    seen = Observation()
    df.join(fresh, key, "left_semi").select(*cols).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(
        "overwrite").parquet(f"{root.rstrip('/')}/{table}/batch={batch}")
    return seen.get["rows"], df.join(fresh, key, "left_anti").select(*cols)


def write_snapshot(df: DataFrame, root: str, table: str, version: int) -> str:
    """Write a new version of a table beside the old ones and return its path.

    Never overwrites what a reader may be scanning: version N stays intact
    until readers move to N+1; the ``_SUCCESS`` marker says it is complete."""
    path = f"{root.rstrip('/')}/{table}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def latest_version(spark: SparkSession, root: str, table: str, upto: int | None = None) -> int | None:
    """Highest complete version of ``table`` under ``root`` (at most ``upto``
    when given; None if none)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{table}")
    fs = base.getFileSystem(conf)
    if not fs.exists(base):
        return None
    best = None
    for st in fs.listStatus(base):
        name = st.getPath().getName()
        if name.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            v = int(name.split("=", 1)[1])
            if upto is not None and v > upto:
                continue
            best = v if best is None or v > best else best
    return best
