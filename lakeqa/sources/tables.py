"""Lake tables and questions: two physical forms each, one normalized relation each."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeqa import schemas
from lakeqa.scale import broadcast_if_small

DATASETS = ("aitqa", "nqtables")


def _check(dataset: str) -> None:
    if dataset not in DATASETS:
        raise ValueError(f"dataset must be one of {DATASETS}")


def with_ordinals(df: DataFrame, name: str = "ord", place: tuple[str, ...] = ()) -> DataFrame:
    """Number rows 0..n-1 without moving them, in the order of the columns ``place`` of their splits.

    Row counts per split (one small row each) give every split its first number. ``place`` says
    where a split starts, the same for all its rows; without it partitions count in their order.
    The input must read the same way twice, as files and written tables do.
    """
    keys = [*place, "_part"]
    placed = df.withColumn("_part", F.spark_partition_id()).withColumn(
        "_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    counts = placed.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = counts.selectExpr(
        *keys,
        "_first",
        f"coalesce(sum(_n) over (order by {', '.join(keys)} rows between unbounded preceding and 1 preceding), 0)"
        " as _start",
    )
    # One row per split: bounded by the bytes of the files, whatever the row count.
    return (
        placed.join(F.broadcast(starts), keys)
        .withColumn(name, F.col("_start") + F.col("_at") - F.col("_first"))
        .drop(*keys, "_at", "_first", "_start")
    )


def _read_in_order(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of JSON lines, numbered by file path and place in the file, however Spark splits the files."""
    rows = spark.read.schema(schema).json(path).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )
    return with_ordinals(rows, place=("_file", "_block"))


def normalize_tables(tables: DataFrame, dataset: str) -> DataFrame:
    """``(ord, dataset, table_id, table_name, column_header, row_header, data)`` from either form."""
    _check(dataset)
    no_paths = F.array().cast("array<array<string>>")
    if dataset == "aitqa":
        columns = {
            "table_id": F.col("id"),
            "table_name": F.col("title"),
            "column_header": F.coalesce("column_header", no_paths),
            "row_header": F.coalesce("row_header", no_paths),
            "data": F.coalesce("data", no_paths),
        }
    else:
        columns = {
            "table_id": F.col("tableId"),
            "table_name": F.col("documentTitle"),
            "column_header": F.coalesce(
                F.transform("columns", lambda c: F.array(c["text"])), no_paths
            ),
            "row_header": no_paths,
            "data": F.coalesce(
                F.transform("rows", lambda r: F.transform(r["cells"], lambda c: c["text"])), no_paths
            ),
        }
    return tables.select(
        "ord", F.lit(dataset).alias("dataset"), *[c.alias(n) for n, c in columns.items()]
    )


def read_tables(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Read lake tables from JSON lines; file order becomes ``ord``."""
    _check(dataset)
    schema = schemas.AITQA_TABLE if dataset == "aitqa" else schemas.NQ_TABLE
    return normalize_tables(_read_in_order(spark, path, schema), dataset)


def last_of_each_id(tables: DataFrame) -> DataFrame:
    """For lookups by id: of tables sharing an id, the last one in file order.

    Only ids are shuffled; the text is filtered in place against the repeated ids.
    """
    repeated = (
        tables.groupBy("table_id")
        .agg(F.max("ord").alias("_last"), F.count("*").alias("_copies"))
        .where("_copies > 1")
    )
    return (
        tables.join(broadcast_if_small(repeated), "table_id", "left")
        .where(F.col("_last").isNull() | (F.col("ord") == F.col("_last")))
        .withColumn("num_copies", F.coalesce("_copies", F.lit(1)).cast("bigint"))
        .drop("_last", "_copies")
    )


def _answer_list(text):
    """A JSON list of strings, or one bare string wrapped into a list."""
    return F.when(
        F.ltrim(text).startswith("["), F.from_json(text, "array<string>")
    ).otherwise(F.array(text))


def normalize_questions(questions: DataFrame, dataset: str) -> DataFrame:
    """``(query_ord, query_id, query_text, table_id, ground_truth)`` from either form."""
    _check(dataset)
    if dataset == "aitqa":
        return questions.select(
            F.col("ord").alias("query_ord"),
            F.col("id").alias("query_id"),
            F.col("question").alias("query_text"),
            "table_id",
            _answer_list(F.col("answers")).alias("ground_truth"),
        )
    first = F.get("questions", F.lit(0))
    return questions.select(
        F.col("ord").alias("query_ord"),
        first["id"].alias("query_id"),
        first["originalText"].alias("query_text"),
        F.col("table.tableId").alias("table_id"),
        _answer_list(first["answer"]["answerTexts"]).alias("ground_truth"),
    )


def read_questions(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    _check(dataset)
    schema = schemas.AITQA_QUESTION if dataset == "aitqa" else schemas.NQ_QUESTION
    return normalize_questions(_read_in_order(spark, path, schema), dataset)


def sample_questions(questions: DataFrame, num_questions: int, seed: int) -> DataFrame:
    """A repeatable sample: order by a seeded digest, keep the first ones (all if there are fewer).

    Questions that share an id follow each other by position."""
    digest = F.md5(F.concat(F.col("query_id"), F.lit(f"-{seed}")))
    place = [c for c in ("query_ord",) if c in questions.columns]
    return questions.orderBy(digest, "query_id", *place).limit(num_questions)
