"""Requests: contexts, prompts and token budgets. Text is joined late and only for ranked hits."""

from pyspark.sql import Column, DataFrame, functions as F

from lakeqa.functions import templates as T, text as text_functions
from lakeqa.operators import fetch
from lakeqa.scale import BROADCAST_BYTES, broadcast_if_small, cut_lineage


def request_struct(
    model: str, system: str, user: Column, max_tokens: int, temperature: float = 0.0,
    seed: int = T.MODEL_SEED,
) -> Column:
    return F.struct(
        F.lit(model).alias("model"),
        F.array(
            F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
            F.struct(F.lit("user").alias("role"), user.alias("content")),
        ).alias("messages"),
        F.lit(float(temperature)).alias("temperature"),
        F.lit(max_tokens).cast("int").alias("max_tokens"),
        F.lit(seed).cast("bigint").alias("seed"),
    )


def with_table_text(hits: DataFrame, tables_text: DataFrame) -> DataFrame:
    """Hits with their table's text; a table that the lake lacks is an error when the row is made.

    Of tables that share an id the last one counts. Only tables that are hit are moved.
    """
    shown = hit_tables(hits, tables_text.select(*_order_of(tables_text), "table_id", "table_name", "table_content"))
    joined = hits.select("query_id", "table_id", "rank").join(shown.withColumn("_there", F.lit(True)), "table_id", "left")
    absent = F.raise_error(F.concat(F.lit("no table "), F.coalesce("table_id", F.lit("null")))).cast("string")
    text = F.when(F.col("_there").isNull(), absent).otherwise(F.col("table_content"))
    return joined.withColumn("table_content", text).drop("_there", "ord")


def _order_of(tables: DataFrame) -> list[str]:
    return ["ord"] if "ord" in tables.columns else []


def hit_tables(hits: DataFrame, tables: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The tables that ``hits`` name, one for each id: of those sharing it the last one in file order.

    Tables that are not hit stay where they are (``fetch.rows_of_ids``); those that are meet on their id
    once. ``tables`` without ``ord``, as ``met_tables`` returns them, have one row per id already.
    """
    found = fetch.rows_of_ids(tables, hits, "table_id", broadcast_bytes)
    if "ord" not in tables.columns:
        return found
    last = F.max_by(F.struct(*[c for c in tables.columns if c != "table_id"]), "ord").alias("_last")
    return found.groupBy("table_id").agg(last).select(
        *[F.col("table_id") if c == "table_id" else F.col(f"_last.{c}").alias(c) for c in tables.columns]
    )


def met_tables(hits: DataFrame, tables: DataFrame) -> DataFrame:
    """The tables that ``hits`` name, written once; later stages don't look for the last of an id again."""
    return cut_lineage(hit_tables(hits, tables).drop("ord"))


def missing_tables(hits: DataFrame, tables_text: DataFrame) -> DataFrame:
    """Hits naming a table the lake does not have; should be empty."""
    return hits.select("table_id").distinct().join(tables_text.select("table_id"), "table_id", "left_anti")


def _in_rank_order(parts: DataFrame, text: Column, separator: str, name: str) -> DataFrame:
    """One text per question from its ranked parts; callers bound the number of parts per question."""
    return parts.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", text.alias("part")))), lambda p: p["part"]
            ),
            separator,
        ).alias(name)
    )


def open_book_context(
    questions: DataFrame, hits: DataFrame, tables_text: DataFrame, num_context: int, template: str
) -> DataFrame:
    """``(query_id, context)`` from the first ``num_context`` hits, in rank order."""
    parts = with_table_text(hits.where(F.col("rank") <= num_context), tables_text)
    body = F.concat(F.lit("Table "), F.col("rank").cast("string"), F.lit(": "), F.col("table_content"))
    if template == "QTQTQT":
        asked = broadcast_if_small(questions.select("query_id", "query_text"))
        parts = parts.join(asked, "query_id")
        body = F.concat(F.lit("Query: "), F.col("query_text"), F.lit(" "), body)
    return _in_rank_order(parts, body, "\n", "context")


def oracle_context(
    questions: DataFrame, hits: DataFrame, tables_text: DataFrame, template: str
) -> DataFrame:
    """``(query_id, context)`` from the first hit only."""
    parts = with_table_text(hits.where(F.col("rank") == 1), tables_text)
    body = F.concat(F.lit("Ground truth table : "), F.col("table_content"))
    if template == "QTQTQT":
        asked = broadcast_if_small(questions.select("query_id", "query_text"))
        parts = parts.join(asked, "query_id")
        body = F.concat(F.lit("Query: "), F.col("query_text"), F.lit(" "), body)
    return parts.select("query_id", body.alias("context"))


def fit_context(
    contexts: DataFrame,
    prompt_template: str,
    max_context: int,
    answer_tokens: int = T.ANSWER_TOKENS,
    buffer_tokens: int = T.BUFFER_TOKENS,
    token_count=text_functions.token_count,
    first_tokens=text_functions.first_tokens,
) -> DataFrame:
    """Cut ``context`` to the tokens left beside template, question, answer and a reserve.

    Input ``(query_id, query_text, context)``; adds ``available_tokens``, ``context_tokens`` and
    ``was_cut``. A budget below zero leaves an empty context.
    """
    available = F.greatest(
        F.lit(max_context - answer_tokens - buffer_tokens)
        - token_count(F.lit(prompt_template))
        - token_count(F.col("query_text")),
        F.lit(0),
    )
    return (
        contexts.withColumn("available_tokens", available.cast("bigint"))
        .withColumn("context_tokens", token_count(F.col("context")))
        .withColumn("was_cut", F.col("context_tokens") > F.col("available_tokens"))
        .withColumn(
            "context",
            F.when(
                F.col("was_cut"), first_tokens(F.col("context"), F.col("available_tokens"))
            ).otherwise(F.col("context")),
        )
    )


def answer_requests(
    questions: DataFrame,
    mode: str,
    template: str,
    dataset: str,
    model: str,
    max_context: int,
    contexts: DataFrame | None = None,
    answer_tokens: int = T.ANSWER_TOKENS,
    seed: int = T.MODEL_SEED,
    token_count=text_functions.token_count,
    first_tokens=text_functions.first_tokens,
) -> DataFrame:
    """``(query_id, was_cut, request)`` for every question; closed-book needs no contexts."""
    prompt = T.answer_template(template, dataset, mode)
    asked = questions.select("query_id", "query_text")
    if mode == "closed-book":
        ready = asked.withColumn("was_cut", F.lit(False)).withColumn("context", F.lit(""))
    else:
        joined = asked.join(contexts, "query_id", "left").withColumn(
            "context", F.coalesce("context", F.lit(""))
        )
        ready = fit_context(
            joined, prompt, max_context, answer_tokens, T.BUFFER_TOKENS, token_count, first_tokens
        )
    text = T.fill(prompt, query=F.col("query_text"), context=F.col("context"))
    return ready.select(
        "query_id",
        "was_cut",
        request_struct(model, T.ANSWER_SYSTEM, text, answer_tokens, seed=seed).alias("request"),
    )


def zoom_requests(
    questions: DataFrame,
    hits: DataFrame,
    tables_text: DataFrame,
    focus: int,
    num_tables: int,
    num_rows: int,
    model: str,
    max_tokens: int = T.ZOOM_TOKENS,
    seed: int = T.MODEL_SEED,
) -> DataFrame:
    """``(query_id, request)`` asking for the best ``num_tables`` of the first ``focus`` hits.

    ``tables_text`` must already be limited to ``num_rows`` rows per table.
    """
    parts = with_table_text(hits.where(F.col("rank") <= focus), tables_text)
    block = F.concat(F.lit("table_id: "), F.col("table_id"), F.lit("\n\n"), F.col("table_content"))
    tables = _in_rank_order(parts, block, "\n\n\n", "tables")
    size = f"{num_tables} tables (each shown with its first {num_rows} rows)"
    text = T.fill(
        T.ZOOM_PROMPT,
        next_focus_size=F.lit(size),
        query=F.col("query_text"),
        tables=F.coalesce("tables", F.lit("")),
    )
    return (
        questions.select("query_id", "query_text")
        .join(tables, "query_id", "left")
        .select("query_id", request_struct(model, T.ZOOM_SYSTEM, text, max_tokens, seed=seed).alias("request"))
    )


def question_requests(
    hits: DataFrame,
    tables_text: DataFrame,
    num_rerank: int,
    dataset: str,
    model: str,
    max_tokens: int = T.QUESTIONS_TOKENS,
    seed: int = T.MODEL_SEED,
) -> DataFrame:
    """``(table_id, request)``: one request per distinct table among the heads of all rankings.

    The prompt does not depend on the question, so a table hit by many questions is asked once.
    """
    wanted = hits.where(F.col("rank") <= num_rerank).select("table_id").distinct()
    tables = hit_tables(
        wanted, tables_text.select(*_order_of(tables_text), "table_id", "table_name", "table_content")
    )
    values = {"table_id": F.col("table_id"), "table": F.col("table_content")}
    if dataset == "aitqa":
        values["airline_name"] = F.col("table_name")
    text = T.fill(T.QUESTIONS_PROMPT[dataset], **values)
    return tables.select(
        "table_id", request_struct(model, T.QUESTIONS_SYSTEM, text, max_tokens, seed=seed).alias("request")
    )
