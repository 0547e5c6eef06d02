"""Scores of retrieval and answers, for any number of runs in one pass."""

from pyspark.sql import Column, DataFrame, functions as F

from lakeqa.functions import text as text_functions
from lakeqa.scale import join_to_unique

K_VALUES = (1, 3, 5, 10, 100)


def first_relevant_rank(hits: DataFrame, qrels: DataFrame, keys=("query_id",)) -> DataFrame:
    """``(*keys, first_rank)`` for every judged question; null if no relevant table was found.

    Judged pairs that are not relevant keep their question in the count but match nothing.
    """
    keys = list(keys)
    relevant = qrels.select(*keys, "table_id", (F.col("rel") > 0).alias("_relevant"))
    return (
        relevant.join(hits.select(*keys, "table_id", "rank"), [*keys, "table_id"], "left")
        .groupBy(*keys)
        .agg(F.min(F.when(F.col("_relevant"), F.col("rank"))).alias("first_rank"))
    )


def top_k_accuracy(
    hits: DataFrame, qrels: DataFrame, k_values=K_VALUES, run_keys=(), digits: int = 5
) -> DataFrame:
    """Share of judged questions with a relevant table among their first k, for all k at once."""
    run_keys = list(run_keys)
    best = first_relevant_rank(hits, qrels, [*run_keys, "query_id"])
    found = [
        F.round(F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)), digits).alias(f"accuracy_at_{k}")
        for k in k_values
    ]
    return best.groupBy(*run_keys).agg(F.count("*").alias("num_questions"), *found)


def _tokens(normal_form: Column) -> Column:
    return F.filter(F.split(normal_form, " "), lambda t: t != "")


# Where one side has at most so many tokens, the other is first cut to those.
FEW_TOKENS = 8


def _token_f1(predicted: Column, truth: Column) -> Column:
    """Harmonic mean of precision and recall of two token lists; tokens are numbered, so repeats count."""

    def num_shared(a: Column, b: Column) -> Column:
        return F.size(F.array_intersect(text_functions.numbered(a), text_functions.numbered(b)))

    def known(a: Column, b: Column) -> Column:
        return F.filter(a, lambda token: F.array_contains(b, token))

    sizes = F.size(predicted), F.size(truth)
    shared = F.when(
        F.least(*sizes) <= FEW_TOKENS, num_shared(known(predicted, truth), known(truth, predicted))
    ).otherwise(num_shared(predicted, truth))
    return text_functions.let(
        shared, lambda n: F.when(n > 0, 2.0 * n / (sizes[0] + sizes[1])).otherwise(F.lit(0.0))
    )


def answer_scores(answers: DataFrame) -> DataFrame:
    """Per question: exact match and token F1, best over the ground truths, and relaxed match.

    Input ``(…, prediction, ground_truth array<string>)``. Everything happens inside the row.
    Relaxed match looks only at the first ground truth, and an empty one matches every answer.
    """
    prepared = answers.withColumns(
        {
            "_p": text_functions.answer_form(F.col("prediction")),
            "_t": F.transform("ground_truth", text_functions.answer_form),
        }
    ).withColumn("_equal", F.exists("_t", lambda t: t == F.col("_p")))
    first = text_functions.relaxed_form(F.get("ground_truth", F.lit(0)))
    best = text_functions.let(
        _tokens(F.col("_p")),
        lambda p: F.array_max(
            F.transform("_t", lambda t: text_functions.let(_tokens(t), lambda own: _token_f1(p, own)))
        ),
    )
    return prepared.withColumns(
        {
            "exact_match": F.col("_equal").cast("double"),
            # An equal truth with any token is the best there can be; nothing has to be counted then.
            "f1_score": F.when(F.col("_equal") & (F.col("_p") != ""), F.lit(1.0)).otherwise(best),
            "relaxed_match": F.contains(
                text_functions.relaxed_form(F.col("prediction")), first
            ).cast("double"),
        }
    ).drop("_p", "_t", "_equal")


def mean_answer_scores(scored: DataFrame, run_keys=()) -> DataFrame:
    return scored.groupBy(*run_keys).agg(
        F.count("*").alias("num_questions"),
        *[F.avg(name).alias(name) for name in ("exact_match", "f1_score", "relaxed_match")],
    )


def all_truths_contained(prediction: Column, truths: Column) -> Column:
    """Every ground truth is a literal part of the prediction, ignoring case, keeping punctuation."""
    return F.forall(truths, lambda t: F.contains(F.lower(prediction), F.lower(t)))


def split_by_difficulty(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions answered without any table are easy, the others hard.

    ``answers(partition, ord, id, prediction, answers)`` are closed-book predictions with their
    references, numbered; ``questions(partition, ord, id, answers, …)`` the source. An id alone is not
    unique, so both sides meet on partition, id and the whole answer list, and of equal questions
    the first in file order counts. Predictions without a source question drop out.
    """
    truths = text_functions.unquote_answers(F.col("answers"))
    # The long predictions are judged where they are; only the verdict is joined.
    judged = answers.withColumn("answers", truths).select(
        "partition",
        "id",
        "answers",
        F.col("ord").alias("_row"),
        F.when(all_truths_contained(F.col("prediction"), F.col("answers")), "easy")
        .otherwise("hard")
        .alias("difficulty"),
    )
    payload = [c for c in questions.columns if c not in ("partition", "id", "answers", "ord")]
    first = questions.groupBy("partition", "id", "answers").agg(
        F.min_by(F.struct("ord", *payload), "ord").alias("_q")
    )
    return join_to_unique(judged, first, ["partition", "id", "answers"], "_row").select(
        "partition",
        "id",
        "answers",
        *[F.col(f"_q.{c}").alias(c) for c in payload],
        "difficulty",
    )
