"""Token counts and money: per request, per response, per run."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakeqa.functions import text as text_functions

# List prices in US dollars per one million tokens, and model limits.
PRICES = [
    # model, mode, input, cached input, output, max context, max output
    ("gpt-4o-2024-11-20", "default", 2.50, 1.25, 10.00, 128000, 16384),
    ("gpt-4o-2024-11-20", "batch", 1.25, 1.25, 5.00, 128000, 16384),
    ("gpt-4o-2024-11-20", "flex", 1.25, 1.25, 5.00, 128000, 16384),
    ("gpt-4o-mini-2024-07-18", "default", 0.15, 0.075, 0.60, 128000, 16384),
    ("gpt-4o-mini-2024-07-18", "batch", 0.075, 0.075, 0.30, 128000, 16384),
    ("gpt-4o-mini-2024-07-18", "flex", 0.075, 0.075, 0.30, 128000, 16384),
]
MESSAGE_TOKENS = 10


def max_context(model: str) -> int:
    for name, _, _, _, _, context, _ in PRICES:
        if name == model:
            return context
    raise KeyError(f"no limits known for model {model}")


def prices(spark: SparkSession, mode: str = "default") -> DataFrame:
    schema = (
        "model string, mode string, input_usd double, cached_usd double, output_usd double, "
        "max_context bigint, max_output bigint"
    )
    return spark.createDataFrame(PRICES, schema).where(F.col("mode") == mode).drop("mode")


def input_tokens(messages: Column, token_count=text_functions.token_count) -> Column:
    """Tokens of all message contents plus a fixed number per message."""
    return F.aggregate(
        messages,
        F.lit(0).cast("bigint"),
        lambda total, m: total + token_count(m["content"]) + MESSAGE_TOKENS,
    )


def response_costs(
    responses: DataFrame, price_list: DataFrame, ignore_token_caching: bool = False
) -> DataFrame:
    """Add ``cost`` in US dollars; responses without a model are failures and are left out."""
    usage = F.col("response.usage")
    cached = F.lit(0) if ignore_token_caching else F.coalesce(
        usage["prompt_tokens_details"]["cached_tokens"], F.lit(0)
    )
    cost = (
        cached * F.col("cached_usd")
        + (usage["prompt_tokens"] - cached) * F.col("input_usd")
        + usage["completion_tokens"] * F.col("output_usd")
    ) / 1_000_000
    answered = responses.where(F.col("response.model").isNotNull()).withColumn(
        "model", F.col("response.model")
    )
    # The price list has one row per model.
    priced = _with_prices(answered, price_list).withColumn("cost", cost)
    return priced.drop(*[c for c in price_list.columns if c != "model"])


def dollars(response: Column, mode: str = "default", ignore_token_caching: bool = False) -> Column:
    """The cost of one response in its row; null for a failed one. A model without a price is an error."""
    usage, model = response["usage"], response["model"]
    cached = F.lit(0) if ignore_token_caching else F.coalesce(
        usage["prompt_tokens_details"]["cached_tokens"], F.lit(0)
    )
    cost = F.raise_error(F.concat(F.lit("no price for model "), model)).cast("double")
    for name, listed, per_input, per_cached, per_output, *_ in PRICES:
        if listed == mode:
            own = cached * per_cached + (usage["prompt_tokens"] - cached) * per_input + usage["completion_tokens"] * per_output
            cost = F.when(model == name, own / 1_000_000).otherwise(cost)
    return F.when(model.isNotNull(), cost)


def _with_prices(rows: DataFrame, price_list: DataFrame) -> DataFrame:
    """Rows with the prices of their ``model``; one that the list lacks is an error, not free of charge."""
    unknown = F.raise_error(F.concat(F.lit("no price for model "), F.coalesce("model", F.lit("null"))))
    absent = F.col("input_usd").isNull()
    dollars = [c for c in price_list.columns if c.endswith("_usd")]
    return rows.join(F.broadcast(price_list), "model", "left").withColumns(
        {c: F.when(absent, unknown.cast("double")).otherwise(F.col(c)) for c in dollars}
    )


def cost_per_question(costs: DataFrame, questions: DataFrame) -> DataFrame:
    """``(run_id, total_cost, num_questions, cost_per_question)``; each relation is pre-aggregated."""
    spent = costs.groupBy("run_id").agg(F.sum("cost").alias("total_cost"))
    asked = questions.groupBy("run_id").agg(F.count("*").alias("num_questions"))
    return asked.join(spent, "run_id", "left").select(
        "run_id",
        F.coalesce("total_cost", F.lit(0.0)).alias("total_cost"),
        "num_questions",
        (F.coalesce("total_cost", F.lit(0.0)) / F.col("num_questions")).alias("cost_per_question"),
    )


def estimate_costs(
    requests: DataFrame, price_list: DataFrame, token_count=text_functions.token_count
) -> DataFrame:
    """Upper bound of the cost of each request before it is sent.

    The output limit is ``max_completion_tokens`` if the request has that field, else
    ``max_tokens``, else what the context leaves, up to the model's own limit.
    """
    fields = requests.schema["request"].dataType.fieldNames()
    limits = [F.col(f"request.{n}") for n in ("max_completion_tokens", "max_tokens") if n in fields]
    left = F.least(
        F.greatest(F.col("max_context") - F.col("input_tokens"), F.lit(0)), F.col("max_output")
    )
    return (
        requests.withColumn("model", F.col("request.model"))
        .transform(_with_prices, price_list)
        .withColumn("input_tokens", input_tokens(F.col("request.messages"), token_count))
        .withColumn("output_limit", F.coalesce(*limits, left).cast("bigint"))
        .withColumn("max_usage", F.col("input_tokens") + F.col("output_limit"))
        .withColumn(
            "max_cost",
            F.col("input_tokens") * F.col("input_usd") / 1_000_000
            + F.col("output_limit") * F.col("output_usd") / 1_000_000,
        )
        .drop(*[c for c in price_list.columns if c != "model"])
    )
