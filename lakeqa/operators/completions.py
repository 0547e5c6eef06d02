"""Request exchange: digest, lookup of known responses, completion of the missing ones."""

from pyspark.sql import Column, DataFrame, functions as F

from lakeqa import schemas
from lakeqa.operators import fetch
from lakeqa.scale import cut_lineage

PROVIDER = "openai"


def request_text(request: Column) -> Column:
    return F.to_json(request, {"ignoreNullFields": "false"})


def with_digests(requests: DataFrame, provider: str = PROVIDER) -> DataFrame:
    """Add ``request_hash``, the identity of a request, and ``request_check``, a second digest.

    Lookups move and compare these two digests; the prompt text itself stays where it is.
    """
    text = request_text(F.col("request"))
    return requests.withColumns(
        {
            "provider": F.lit(provider),
            "request_hash": F.sha2(F.concat(F.lit(provider), F.lit("-"), text), 256),
            "request_check": F.md5(text),
        }
    )


_KEYS = ["request_hash", "provider", "request_check"]


def known_responses(store: DataFrame) -> DataFrame:
    """A store that several writers appended to: for each ``request_hash`` a map from check to response.

    Of differing responses to one request that with the smallest digest counts. Grouping is by
    ``request_hash`` alone, so a store that is bucketed by it stays where it is.
    """
    digest = F.sha2(F.to_json("response"), 256)
    one = store.where("response IS NOT NULL").groupBy(*_KEYS).agg(F.min_by("response", digest).alias("response"))
    entry = F.struct(_check(), F.col("response"))
    return one.groupBy("request_hash").agg(F.map_from_entries(F.collect_list(entry)).alias("_known"))


def _check() -> Column:
    return F.concat_ws("-", "request_check", "provider")


def look_up(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Requests (with digests) with their stored ``response``, null where there is none.

    Responses that several writers or a repeated append stored for one request count once, so no
    request is doubled. A bucketed store is not moved; the requests are, with the columns that are used
    afterwards (a prompt that nobody reads stays behind).
    """
    found = requests.join(known_responses(store), "request_hash", "left")
    return found.withColumn("response", F.try_element_at("_known", _check())).drop("_known")


def misses(requests: DataFrame, store: DataFrame, payload: str = "request") -> DataFrame:
    """Distinct requests without a stored response, their digests and ``payload``.

    Digests meet the store first; those that it lacks are written. Prompts of known requests stay where
    they are, those that are missing move once; repeated ones collapse in the tasks before that.
    """
    known = known_responses(store).select("request_hash", F.map_keys("_known").alias("_checks"))
    digests = requests.select(*_KEYS).distinct().join(known, "request_hash", "left")
    absent = cut_lineage(
        digests.where(~F.coalesce(F.array_contains("_checks", _check()), F.lit(False))).select("request_hash")
    )
    wanted = fetch.rows_of_ids(requests.select(*_KEYS, payload), absent, "request_hash")
    return wanted.groupBy(*_KEYS).agg(F.first(payload).alias(payload))


def complete(missing: DataFrame, complete_batch, num_tasks: int | None = None, call_size: int = 64) -> DataFrame:
    """``(digests, response, failure)``: ``complete_batch(list of request dicts) -> list of response dicts``.

    ``missing`` has the digests and ``request``, or ``request_text``. The function gets at most
    ``call_size`` requests at once. Where it raises, its requests get the error as ``failure`` and
    no response, so the replies of other calls aren't lost with it. It belongs to the user and need
    not give the same reply twice, so write the result before it is read
    (``sources.store.complete_into_store``).
    """
    import json

    import pandas as pd

    def ask(requests: list[dict]) -> tuple[list, str | None]:
        try:
            replies = complete_batch(requests)
        except Exception as error:  # whatever the user's function raises
            return [None] * len(requests), f"{type(error).__name__}: {error}"
        if len(replies) != len(requests):
            raise ValueError("a completion function must return one response per request")
        return [json.dumps(r) for r in replies], None

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), call_size):
                part = batch.iloc[at : at + call_size]
                replies, failure = ask([json.loads(text) for text in part["request_text"]])
                out = part.drop(columns="request_text")
                yield pd.DataFrame(out.assign(response_text=replies, failure=failure))

    text = F.col("request_text") if "request_text" in missing.columns else request_text(F.col("request"))
    texts = missing.select(*_KEYS, text.alias("request_text"))
    if num_tasks is not None:
        texts = texts.repartition(num_tasks, "request_hash")
    replied = texts.mapInPandas(
        run, "request_hash string, provider string, request_check string, response_text string, failure string"
    )
    return replied.select(
        *_KEYS, F.from_json("response_text", schemas.RESPONSE).alias("response"), "failure"
    )
