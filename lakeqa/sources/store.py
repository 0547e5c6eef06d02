"""Persisted relations: responses, vectors, run records, reports and split question sets."""

import hashlib

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeqa import schemas
from lakeqa.operators import completions
from lakeqa.scale import cut_lineage, small_batches


NUM_BUCKETS = 64
# Requests in a file of the queue, and files that one micro-batch takes.
FILE_REQUESTS = 500
BATCH_FILES = 200


def _num_buckets(spark: SparkSession, path: str) -> int:
    return spark.read.schema("buckets int").json(f"{path}.layout").first()["buckets"]


def _responses_table(spark: SparkSession, path: str) -> str:
    """The session's name for the store at ``path``: a table bucketed by digest over its files."""
    name = "lakeqa_responses_" + hashlib.md5(path.encode()).hexdigest()
    if not spark.catalog.tableExists(name):
        buckets = _num_buckets(spark, path)
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.RESPONSE_STORE)
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (request_hash) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
    return name


def create_response_store(spark: SparkSession, path: str, num_buckets: int = NUM_BUCKETS) -> None:
    """An empty store at ``path``: Parquet files bucketed by ``request_hash``, in ``num_buckets`` buckets.

    A bucket is one task of every look-up, so choose as many as a shuffle of all responses would
    need. Beside it lie ``.layout`` (their number), and later ``.requests`` and ``.progress``, the queue
    of ``complete_into_store``. Sessions name the files as a table of their catalog.
    """
    spark.createDataFrame([(num_buckets,)], "buckets int").coalesce(1).write.mode("errorifexists").json(f"{path}.layout")
    _responses_table(spark, path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """All stored responses; grouping or joining them by ``request_hash`` moves none."""
    name = _responses_table(spark, path)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def append_responses(responses: DataFrame, path: str) -> None:
    """Adds responses to the store, one file for each bucket that gets any."""
    spark = responses.sparkSession
    name = _responses_table(spark, path)
    buckets = _num_buckets(spark, path)
    kept = responses.select("request_hash", "provider", "request_check", "response")
    kept.repartition(buckets, "request_hash").write.insertInto(name)


class CompletionError(RuntimeError):
    """Some calls of a completion function failed; the replies of all others are in the store."""


def complete_into_store(
    requests: DataFrame, path: str, complete_batch=None, num_tasks: int | None = None,
    file_requests: int = FILE_REQUESTS, batch_files: int = BATCH_FILES, call_size: int = 64,
) -> DataFrame:
    """Resolve requests (with digests) against the store at ``path``.

    With a completion function, what the store lacks is queued as files of ``file_requests``, and a
    stream takes ``batch_files`` of them at a time until none is left: completes them, appends the
    replies, goes on. A reply is in the store when its micro-batch ends, also if other calls of the batch
    failed; then a CompletionError ends the stream. Called again, it takes up the failed batch and
    asks only for what the store still lacks. (A task that is lost with its executor asks again.)
    Failed replies are not kept. Without a function, misses stay null; ``completions.misses`` lists them.
    """
    spark = requests.sparkSession
    if complete_batch is not None:
        missing = completions.misses(requests, read_responses(spark, path))
        text = completions.request_text(F.col("request")).alias("request_text")
        queued = missing.select("request_hash", "provider", "request_check", text)
        queued.write.mode("append").option("maxRecordsPerFile", file_requests).parquet(f"{path}.requests")
        _work_off(spark, path, complete_batch, num_tasks, batch_files, call_size)
    return completions.look_up(requests, read_responses(spark, path))


def _work_off(spark, path: str, complete_batch, num_tasks: int | None, batch_files: int, call_size: int) -> None:
    num_tasks = num_tasks or spark.sparkContext.defaultParallelism

    def answer(batch: DataFrame, batch_id: int) -> None:
        # A batch that is run again finds its own replies in the store.
        missing = completions.misses(batch, read_responses(batch.sparkSession, path), "request_text")
        replies = cut_lineage(completions.complete(missing, complete_batch, num_tasks, call_size))
        append_responses(replies.where(F.col("response.model").isNotNull()), path)
        failed = replies.where("failure IS NOT NULL").agg(F.count("*").alias("n"), F.min("failure").alias("why")).first()
        if failed["n"]:
            raise CompletionError(f"{failed['n']} requests of batch {batch_id} failed, one of them: {failed['why']}")

    fields = "request_hash string, provider string, request_check string, request_text string"
    files = spark.readStream.schema(fields).option("maxFilesPerTrigger", batch_files).parquet(f"{path}.requests")
    query = (
        files.writeStream.foreachBatch(answer)
        .option("checkpointLocation", f"{path}.progress")
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    except StreamingQueryException as error:
        if "CompletionError" in str(error):
            raise CompletionError(str(error)) from error
        raise


_VECTORS = "model_id string, digest string, vector array<float>"


def create_vector_store(spark: SparkSession, path: str) -> None:
    """An empty store of vectors by text digest, a folder for each model."""
    spark.createDataFrame([], _VECTORS).write.partitionBy("model_id").mode("errorifexists").parquet(path)


def embed_into_store(texts: DataFrame, path: str, embed, model_id: str | None = None) -> DataFrame:
    """``(text, vector)`` for the distinct texts of a column ``text``, from the store at ``path``.

    Only texts whose digest the store lacks for this model are embedded and appended; texts
    themselves are not stored. ``model_id`` tells models apart, by default the one that ``embed`` has.
    """
    from lakeqa.operators import dense

    spark = texts.sparkSession
    name = model_id or embed.model_id
    digest = F.sha2("text", 256).alias("digest")
    asked = texts.where("text IS NOT NULL").select("text", digest).distinct()

    def known() -> DataFrame:
        stored = spark.read.schema(_VECTORS).parquet(path).where(F.col("model_id") == name)
        # Writers that met may have stored a text twice.
        return stored.groupBy("digest").agg(F.max("vector").alias("vector"))

    new = asked.join(known().select("digest"), "digest", "left_anti").select("text")
    made = dense.embed_distinct(new, embed).select(F.lit(name).alias("model_id"), digest, "vector")
    with small_batches(spark):
        made.write.mode("append").partitionBy("model_id").parquet(path)
    return asked.join(known(), "digest").select("text", "vector")


def write_runs(records: DataFrame, path: str) -> None:
    """One JSON record per run."""
    records.write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RUN_RECORD).json(path).withColumn(
        "path", F.col("_metadata.file_path")
    )


def read_run_documents(spark: SparkSession, path: str) -> DataFrame:
    """Run files of any shape: ``document``, each record as a variant, and its ``path``."""
    read = spark.read.option("singleVariantColumn", "document").json(path)
    return read.select("document", F.col("_metadata.file_path").alias("path"))


def write_run_relations(hits: DataFrame, qrels: DataFrame, answers: DataFrame, path: str) -> None:
    """What a run ranked, what was right, what it answered: flat JSON lines, one folder per run.

    Inputs carry ``run_id``. A run may have any number of questions, so these stay relations and are
    not gathered into its record.
    """
    relations = {
        "run": hits.select("run_id", "query_id", "table_id", "rank", "score"),
        "qrels": qrels.select("run_id", "query_id", "table_id", "rel"),
        "predictions": answers.select("run_id", "query_ord", "query_id", "prediction"),
        "references": answers.select("run_id", "query_ord", "query_id", "ground_truth"),
    }
    for name, relation in relations.items():
        relation.write.mode("append").partitionBy("run_id").json(f"{path}/{name}")


_RUN_RELATIONS = {
    "run": "run_id string, query_id string, table_id string, rank bigint, score double",
    "qrels": "run_id string, query_id string, table_id string, rel int",
    "predictions": "run_id string, query_ord bigint, query_id string, prediction string",
    "references": "run_id string, query_ord bigint, query_id string, ground_truth array<string>",
}


def read_run_relation(spark: SparkSession, path: str, name: str) -> DataFrame:
    columns = [c.split()[0] for c in _RUN_RELATIONS[name].split(", ")]
    return spark.read.schema(_RUN_RELATIONS[name]).json(f"{path}/{name}").select(columns)


def write_report(report: DataFrame, path: str) -> None:
    """A report has one row per configuration, so one CSV file holds it."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_split(questions: DataFrame, path: str) -> None:
    """Easy and hard question sets of each partition, in their own folders, as JSON lines.

    Folders that ``questions`` has rows for are replaced, all others stay; a repeated job gives the same.
    """
    writer = questions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("partition", "difficulty").json(path)


def read_split(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A written split; ``schema`` are the columns of its questions."""
    return spark.read.schema(f"{schema}, partition string, difficulty string").json(path)
