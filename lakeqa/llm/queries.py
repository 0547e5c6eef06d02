"""Registered queries: each applies one operator to its whole table and derives the contract's columns."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeqa.llm import conversation_repair, decontaminate, divergence, html_text, language, metric_search, mixing, ngram_join, packing, secrets, token_files, urls, warc
from lakeqa.scale import new_shared_path

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.archive_pages(table(spark, sf_dir, "pages"))
    records = warc.read_archives(spark, manifest, with_payload=False)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("bigint"))
    return records.select(
        as_id("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        as_id("refers_to").alias("refers_to"),
    )


RULES = (
    # Fixed values of the contract: host, path, verdict.
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(*[F.lit(v).alias(n) for v, n in zip(rule, ("host", "path", "verdict"), strict=True)])
                    for rule in RULES
                ]
            )
        )
    )
    judged = urls.judge_urls(table(spark, sf_dir, "pages"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), unnamed=True)
    hit = F.aggregate("hit_words", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.train(docs))
    joined = lambda kept: F.array_join(
        F.transform(
            F.filter("findings", kept),
            lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string")),
        ),
        ",",
    )
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]],
        F.sha2(joined(lambda f: f["kind"] != "model"), 256).alias("base_sha256"),
        joined(lambda f: f["kind"].isNotNull()).alias("spans"),
        count("model").alias("n_model"),
    )


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def digest_share(column: str, parts: int):
    """crc32 of an id as text, by ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs.where(digest_share("doc_id", 5) != 0))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", (digest_share("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score"
    )


@query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_text.extract(pages, html_text.learn(pages.select("html")))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = digest_share("doc_id", 7) == 2
    scored = mixing.score_texts(docs, docs.where(~held_out).select("text"))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


@query
def op2_metric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = metric_search.top_k(vectors, vectors.where("vec_id % 50 = 0"))
    return found.select("query_id", "rank", "vec_id", "score")


@query
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = new_shared_path(spark, "tokens")
    token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_files.check_sums(token_files.read_token_files(spark, folder))


def damage(turns: DataFrame) -> DataFrame:
    """The contract's damage by a digest of id and turn; a dropped turn stays as a row that isn't present."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit(""))
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        (F.col("kind") != 0).alias("present"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(damage(table(spark, sf_dir, "conversations")), present="present")


@query
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))
