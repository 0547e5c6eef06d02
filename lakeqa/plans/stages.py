"""Interchangeable stages: functions that are bound to their settings once and then applied.

    retriever   (questions, tables) -> hits
    zoom        (questions, hits, tables) -> hits    tables: those that were hit, else the bound ones
    reranker    (questions, hits, tables) -> hits
    generator   (requests)          -> answers
    exchange    (requests)          -> requests with responses
"""

from pyspark.sql import DataFrame, functions as F

from lakeqa.functions import linearize as L, parsing, stem, text as text_functions
from lakeqa.operators import completions, dense, lexical, ranking, requests as R
from lakeqa.scale import cut_lineage, small_batches
from lakeqa.sources import store

# Default zoom stages, 100 -> 10 tables seeing one row, then 10 -> 3 seeing five.
ZOOM_STAGES = (
    {"num_tables": 10, "num_rows": 1},
    {"num_tables": 3, "num_rows": 5},
)


def no_retriever():
    retrieve = lambda questions, tables: ranking.no_hits(questions)
    retrieve.mode = "closed-book"
    return retrieve


def oracle_retriever():
    retrieve = lambda questions, tables: ranking.oracle_hits(questions)
    retrieve.mode = "oracle"
    return retrieve


def bm25_retriever(
    linearization: str = "csv", num_retrieve: int = 100, separate_names: bool = True,
    stop_words=text_functions.ENGLISH_STOP_WORDS, normalizer=stem.stem_words, index=None,
):
    """BM25 over table text and, by default, over table names as a second field.

    ``index`` is a stored index to use instead of building one.
    """
    fields = {"content": "table_content"}
    if separate_names:
        fields["name"] = "table_name"

    def retrieve(questions: DataFrame, tables: DataFrame) -> DataFrame:
        built = index or lexical.build_index(
            L.linearize(tables, linearization), fields, stop_words, normalizer
        )
        return lexical.bm25_hits(questions, built, num_retrieve)

    retrieve.mode = "open-book"
    return retrieve


def dense_retriever(embed, linearization: str = "csv", num_retrieve: int = 100, table_vectors=None):
    """Cosine over embedded texts; ``table_vectors(ord, table_id, vector)`` if already stored.

    ``embed`` adds vectors to texts, or is an estimator that the tables' texts are fitted on first;
    with stored vectors it has to be the fitted model they came from.
    """

    def retrieve(questions: DataFrame, tables: DataFrame) -> DataFrame:
        vectors, model = table_vectors, embed
        if vectors is None:
            texts = L.linearize(tables, linearization).select(
                "ord", "table_id", F.col("table_content").alias("text")
            )
            if hasattr(embed, "fit"):
                model = embed.fit(texts)
            # Vectors are written once; the text they come from goes no further.
            with small_batches(tables.sparkSession):
                vectors = cut_lineage(model(texts).select("ord", "table_id", "vector"))
        asked = questions.select("query_id", F.col("query_text").alias("text"))
        return dense.dense_hits(model(asked).select("query_id", "vector"), vectors, num_retrieve)

    retrieve.mode = "open-book"
    return retrieve


def store_exchange(path: str, complete_batch=None, num_tasks: int | None = None):
    """Resolve requests from a response store, completing what is missing if a function is given."""

    def exchange(requests: DataFrame) -> DataFrame:
        return store.complete_into_store(
            completions.with_digests(requests), path, complete_batch, num_tasks
        )

    return exchange


def no_zoom():
    return lambda questions, hits, tables=None: hits


def check_stages(num_zoom: int, stages) -> None:
    focus = num_zoom
    for stage in stages:
        if not stage["num_tables"] < focus:
            raise ValueError(f"cannot narrow {focus} tables to {stage['num_tables']}")
        focus = stage["num_tables"]


def row_zoom(
    tables: DataFrame, exchange, model: str, linearization: str = "csv", num_zoom: int = 100,
    stages=ZOOM_STAGES, meter=None,
):
    """Let a model pick tables from a few rows of each, in ever smaller circles.

    A ``meter`` counts the selections of another size than asked for, as ``off_size_ctr``.
    """
    check_stages(num_zoom, stages)

    lake = tables

    def zoom(questions: DataFrame, hits: DataFrame, tables: DataFrame | None = None) -> DataFrame:
        tables, focus = lake if tables is None else tables, num_zoom
        for stage in stages:
            # Each stage's hits are written once: the next stage, its requests and the reordering
            # all read them, and no model call is ever repeated by a recomputation.
            hits = cut_lineage(hits)
            shown = L.linearize(tables, linearization, num_rows=stage["num_rows"])
            asked = R.zoom_requests(
                questions, hits, shown, focus, stage["num_tables"], stage["num_rows"], model
            )
            picked = exchange(asked).select(
                "query_id",
                parsing.selected_ids(parsing.content_of(F.col("response"))).alias("selected"),
            )
            if meter is None:
                hits = ranking.selected_first(hits, picked, focus)
            else:
                hits = ranking.selected_first(hits, picked, focus, sizes="_named")
                off = (F.col("rank") == 1) & (F.col("_named") != stage["num_tables"])
                hits = meter.written(hits, off_size_ctr=F.count_if(off)).drop("_named")
            focus = stage["num_tables"]
        return hits

    return zoom


def no_reranker():
    return lambda questions, hits, tables=None: hits


def parse_generated(hits: DataFrame, replies: DataFrame, num_rerank: int) -> DataFrame:
    """``(query_id, table_id, questions)``: replies brought back to the hits they are about.

    ``replies(table_id, response)`` hold one reply per asked table. The first key of a reply names
    its table; it counts for every question that has both the asked and the named table in its
    head. Replies without a question list are failures.
    """
    head = hits.where(F.col("rank") <= num_rerank).select("query_id", "table_id")
    content = parsing.content_of(F.col("response"))
    parsed = replies.select(
        "table_id",
        parsing.first_key(content).alias("named"),
        parsing.generated_questions(content).alias("questions"),
    ).where("named is not null and size(questions) > 0")
    answered = head.join(parsed, "table_id").select(
        "query_id", F.col("named").alias("table_id"), "questions"
    )
    return answered.join(head, ["query_id", "table_id"], "left_semi")


def question_reranker(
    tables: DataFrame, exchange, embed, model: str, dataset: str, linearization: str = "csv",
    num_rerank: int = 10,
):
    """Let a model invent questions per table and rank tables by the one closest to the asked one."""

    lake = tables

    def rerank(questions: DataFrame, hits: DataFrame, tables: DataFrame | None = None) -> DataFrame:
        tables = lake if tables is None else tables
        hits = cut_lineage(hits)
        asked = R.question_requests(
            hits, L.linearize(tables, linearization), num_rerank, dataset, model
        )
        generated = parse_generated(hits, exchange(asked), num_rerank)
        similarities = dense.max_similarity(questions, generated, embed)
        return ranking.merge_reranked(hits, similarities, num_rerank)

    return rerank


def no_generator():
    """Empty answers."""
    return lambda asked: asked.withColumn("prediction", F.lit(""))


def completion_generator(exchange):
    def generate(asked: DataFrame) -> DataFrame:
        return exchange(asked).withColumn(
            "prediction", parsing.answer(parsing.content_of(F.col("response")))
        )

    return generate
