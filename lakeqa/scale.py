"""Size checks, lineage cuts and input spreading: the few places that look at sizes before planning."""

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, functions as F

BROADCAST_BYTES = 64 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, else the session's warehouse.

    A cluster names the first, and its warehouse is shared too; nothing is ever written to a folder
    of one machine, and the session's settings stay as they are.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def new_shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/lakeqa-{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder; later plans read the files instead of recomputing.

    Losing an executor afterwards costs a re-read, never the work that led here. Wide rows are
    written in groups of ``group_rows``; see ``wide_rows``.
    """
    path = new_shared_path(df.sparkSession, "cut")
    (df.write if group_rows is None else wide_rows(df, group_rows)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wide_rows(df: DataFrame, group_rows: int) -> DataFrameWriter:
    """A writer of Parquet files in row groups of ``group_rows``.

    A reader decodes up to 4,096 rows of a row group at once, so rows of megabytes must not share a
    large one: what a task holds would grow with its file.
    """
    return df.write.option("parquet.block.row.count.limit", group_rows)


# Bytes of rows that go to a Python worker at once where rows are wide; Spark's own limit is 64 MB.
BATCH_BYTES = 4 * 1024 * 1024
# Rows that the Parquet reader decodes at once there; Spark's own limit is 4,096, whole texts in one array.
READ_ROWS = 512
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_READ_LIMIT = "spark.sql.parquet.columnarReaderBatchSize"


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]):
    """Jobs inside run with ``settings``; the session has its own back afterwards."""
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, setting in settings.items():
        spark.conf.set(name, setting)
    try:
        yield
    finally:
        for name, setting in before.items():
            if setting is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, setting)


@contextmanager
def small_batches(spark: SparkSession, limit_bytes: int = BATCH_BYTES):
    """Jobs inside send rows to Python workers in batches of ``limit_bytes``, a row at least.

    A task holds a batch several times over, as vectors outside the heap, as a message and in its
    worker. What it reads is decoded READ_ROWS rows at a time, as one array of thousands of texts
    takes a heap of its own. Only jobs that run inside see the limits, not plans made there; the
    session has its own settings back afterwards.
    """
    rows = spark.conf.get(_READ_LIMIT)
    with _settings(spark, {_BATCH_LIMIT: f"{limit_bytes}b", _READ_LIMIT: str(min(READ_ROWS, int(rows)))}):
        yield


@contextmanager
def small_files(spark: SparkSession):
    """Jobs inside write Parquet files that are compressed more; texts take about two thirds of the space."""
    with _settings(spark, {"spark.sql.parquet.compression.codec": "zstd"}):
        yield


@contextmanager
def short_shuffles(spark: SparkSession):
    """What a job inside has shuffled goes when the job ends, not when the driver collects its garbage.

    For jobs whose results are written or are a few rows at once; an iterator of rows would still read it.
    """
    with _settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        yield


def fits_broadcast(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of ``df`` are, measured, small enough to be sent to every executor."""
    width = sum(
        (
            F.coalesce(F.octet_length(F.col(f"`{name}`").cast("string")), F.lit(0)) + F.lit(16)
            for name in df.columns
        ),
        F.lit(0),
    )
    size = df.agg(F.coalesce(F.sum(width.cast("bigint")), F.lit(0)).alias("b")).first()["b"]
    return size <= limit_bytes


def broadcast_if_small(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring; larger sides keep the shuffle join AQE can split."""
    return F.broadcast(df) if fits_broadcast(df, limit_bytes) else df


# A key held by more than this share of the rows is cut into slices of about that share.
HOT_SHARE = 1 / 1000


def join_to_unique(
    rows: DataFrame, unique: DataFrame, keys: list[str], row_id: str, how: str = "inner"
) -> DataFrame:
    """Join many rows to at most one row per key, however many of the rows share one key.

    Keys are counted first (pre-aggregated, one number per key). At most 1/HOT_SHARE keys can be
    hot; their rows are spread over slices by a digest of ``row_id``, which a repeated task gets
    again, and their one partner is copied to each slice.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    share = rows.agg(F.count("*") * HOT_SHARE).scalar()
    hot = F.broadcast(
        counts.where(F.col("_n") > share).select(
            *keys, F.ceil(F.col("_n") / share).cast("bigint").alias("_slices")
        )
    )
    slices = F.coalesce("_slices", F.lit(1).cast("bigint"))
    cut_rows = rows.join(hot, keys, "left").withColumn(
        "_slice", F.pmod(F.xxhash64(row_id), slices)
    )
    copies = unique.join(hot, keys, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1))
    )
    return cut_rows.drop("_slices").join(copies.drop("_slices"), [*keys, "_slice"], how).drop("_slice")
