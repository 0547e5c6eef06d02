"""Explicit schemas of everything that is read from or written to files."""

from pyspark.sql import types as T

_strings = T.ArrayType(T.StringType())
_text_cell = T.StructType([T.StructField("text", T.StringType())])

# Lake table with header paths and row headers ("aitqa" form).
AITQA_TABLE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("column_header", T.ArrayType(_strings)),
        T.StructField("row_header", T.ArrayType(_strings)),
        T.StructField("data", T.ArrayType(_strings)),
    ]
)

# Lake table with text objects ("nqtables" form); url and alternative ids are never read.
NQ_TABLE = T.StructType(
    [
        T.StructField("tableId", T.StringType()),
        T.StructField("documentTitle", T.StringType()),
        T.StructField("columns", T.ArrayType(_text_cell)),
        T.StructField(
            "rows",
            T.ArrayType(T.StructType([T.StructField("cells", T.ArrayType(_text_cell))])),
        ),
    ]
)

# `answers` may be a list or a single string, so it is read as JSON text.
AITQA_QUESTION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("table_id", T.StringType()),
        T.StructField("answers", T.StringType()),
    ]
)

NQ_QUESTION = T.StructType(
    [
        T.StructField("table", T.StructType([T.StructField("tableId", T.StringType())])),
        T.StructField(
            "questions",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("originalText", T.StringType()),
                        T.StructField(
                            "answer",
                            T.StructType([T.StructField("answerTexts", T.StringType())]),
                        ),
                    ]
                )
            ),
        ),
    ]
)

MESSAGE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
)

REQUEST = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("messages", T.ArrayType(MESSAGE)),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("max_tokens", T.IntegerType()),
        T.StructField("seed", T.LongType()),
    ]
)

USAGE = T.StructType(
    [
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField(
            "prompt_tokens_details",
            T.StructType([T.StructField("cached_tokens", T.LongType())]),
        ),
    ]
)

# A failed completion has no model (and usually an error text).
RESPONSE = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField(
            "choices", T.ArrayType(T.StructType([T.StructField("message", MESSAGE)]))
        ),
        T.StructField("usage", USAGE),
        T.StructField("error", T.StringType()),
    ]
)

RESPONSE_STORE = T.StructType(
    [
        T.StructField("request_hash", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("request_check", T.StringType()),
        T.StructField("response", RESPONSE),
    ]
)

_metrics = T.MapType(T.StringType(), T.DoubleType())

# One record per run; long relations (hits, answers) stay in their own Parquet tables.
RUN_RECORD = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("cutoff_context_ctr", T.LongType()),
        T.StructField("processed_queries_ctr", T.LongType()),
        T.StructField("retrieval_results", _metrics),
        T.StructField(
            "qa_results",
            T.StructType(
                [
                    T.StructField("exact_match", T.DoubleType()),
                    T.StructField("relaxed_match", T.DoubleType()),
                    T.StructField("f1_score", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("total_llm_cost", T.DoubleType()),
        T.StructField(
            "config",
            T.StructType(
                [
                    T.StructField("config_name", T.StringType()),
                    T.StructField("exp", T.StringType()),
                    T.StructField(
                        "zoom",
                        T.StructType(
                            [
                                T.StructField(
                                    "next_focus_sizes",
                                    T.ArrayType(
                                        T.StructType(
                                            [
                                                T.StructField("num_tables", T.IntegerType()),
                                                T.StructField("num_rows", T.IntegerType()),
                                            ]
                                        )
                                    ),
                                )
                            ]
                        ),
                    ),
                ]
            ),
        ),
    ]
)
