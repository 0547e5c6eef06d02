"""Run records to reports: names into columns, rounding at the edge, flat and pivoted tables."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Report layouts.
ACCURACIES = ("Accuracy@1", "Accuracy@3", "Accuracy@10", "Accuracy@100")
MODELS = ("gpt-4o-mini-2024-07-18", "gpt-4o-2024-11-20")
COST = "llm_cost (ct)"
FLAT_REPORTS = {
    "retrieval": ("retriever", "reranker", "zoom", "linearization", "template"),
    "zoom": ("template", "next_focus_sizes"),
    "metadata": ("retriever", "reranker", "zoom", "linearization", "metadata"),
}
PIVOT_REPORTS = {
    "tqa": (("retriever", "reranker", "zoom", "num_context"), ("exact_match", COST)),
    "template": (("template",), ("exact_match",)),
    "linear": (("linearization",), ("exact_match",)),
}


def component(config_name: Column, name) -> Column:
    """Value of ``name=value`` in a run name; class paths keep what follows their last dot."""
    prefix = F.concat(F.lit(name) if isinstance(name, str) else name, F.lit("="))
    part = F.get(
        F.filter(F.split(config_name, r"\s+"), lambda p: F.startswith(p, prefix)), F.lit(0)
    )
    class_path = F.contains(part, F.lit(".")) & F.contains(part, F.lit("lib"))
    return F.when(class_path, F.substring_index(part, ".", -1)).otherwise(
        F.substring_index(part, "=", -1)
    )


def components(runs: DataFrame) -> DataFrame:
    """``(run_id, component, value)`` for every name found in a run's name."""
    return (
        runs.select("run_id", "config_name", F.explode(F.split("config_name", r"\s+")).alias("part"))
        .where(F.contains("part", F.lit("=")))
        .select("run_id", "config_name", F.substring_index("part", "=", 1).alias("component"))
        .distinct()
        .select("run_id", "component", component(F.col("config_name"), F.col("component")).alias("value"))
    )


def component_names(runs: DataFrame) -> DataFrame:
    return components(runs).select("component").distinct()


def runs_with(records: DataFrame, **wanted: str) -> DataFrame:
    """Runs whose name has all the wanted component values."""
    for name, value in wanted.items():
        records = records.where(component(F.col("config.config_name"), name) == value)
    return records


def records_of(documents: DataFrame) -> DataFrame:
    """Run records from run files of any shape (``sources.store.read_run_documents``).

    Metrics are taken by whatever names a file has; what a file lacks is null.
    """
    get = lambda path, kind: F.try_variant_get("document", path, kind)
    sizes = "array<struct<num_tables:int,num_rows:int>>"
    config = F.struct(
        get("$.config.config_name", "string").alias("config_name"),
        get("$.config.exp", "string").alias("exp"),
        F.struct(get("$.config.zoom.next_focus_sizes", sizes).alias("next_focus_sizes")).alias("zoom"),
    )
    return documents.select(
        F.coalesce(get("$.run_id", "string"), F.col("path")).alias("run_id"),
        *[get(f"$.{c}", "bigint").alias(c) for c in COUNTERS],
        get("$.retrieval_results", "map<string,double>").alias("retrieval_results"),
        get("$.qa_results", "map<string,double>").alias("qa_results"),
        get("$.total_llm_cost", "double").alias("total_llm_cost"),
        config.alias("config"),
        "path",
    )


def metric_names(records: DataFrame) -> list[str]:
    """All metrics that some record has, in order of name; a name is one row whatever the number of runs."""
    both = F.concat(*[F.coalesce(F.map_keys(c), F.array().cast("array<string>")) for c in ("retrieval_results", "qa_results")])
    return sorted(r["name"] for r in records.select(F.explode(both).alias("name")).distinct().collect())


def full_report(records: DataFrame) -> DataFrame:
    """A row for each of ``records_of``: every component of the run names and every metric, whatever they are."""
    named = records.select("run_id", F.col("config.config_name").alias("config_name"))
    names = sorted(r["component"] for r in component_names(named).collect())
    metrics = metric_names(records)
    values = [F.coalesce(*[F.try_element_at(c, F.lit(m)) for c in ("retrieval_results", "qa_results")]) for m in metrics]
    return records.select(
        "run_id",
        *[component(F.col("config.config_name"), n).alias(n) for n in names],
        focus_text(F.col("config.zoom.next_focus_sizes")).alias("next_focus_sizes"),
        *[F.round(v, 5).alias(m) for v, m in zip(values, metrics, strict=True)],
    )


def focus_text(sizes: Column) -> Column:
    """Zoom stages as text, for example ``-1rows-> 10 -5rows-> 3``; '' without zoom."""
    parts = F.transform(
        sizes,
        lambda s: F.concat(
            F.lit("-"), s["num_rows"].cast("string"), F.lit("rows-> "), s["num_tables"].cast("string")
        ),
    )
    return F.coalesce(F.array_join(parts, " "), F.lit(""))


def report_rows(records: DataFrame, names=None) -> DataFrame:
    """One row per run: components, stage sizes, metrics rounded to two digits, cost in cents.

    Without ``names`` the components are those that the layouts need and all that the runs' names hold.
    """
    if names is None:
        named = records.select("run_id", F.col("config.config_name").alias("config_name"))
        found = {r["component"] for r in component_names(named).collect()}
        names = [*COMPONENTS, *sorted(found - {*COMPONENTS, "next_focus_sizes"})]
    return records.select(
        *[component(F.col("config.config_name"), n).alias(n) for n in names],
        focus_text(F.col("config.zoom.next_focus_sizes")).alias("next_focus_sizes"),
        *[F.round(F.try_element_at("retrieval_results", F.lit(m)), 2).alias(m) for m in ACCURACIES],
        *[F.round(F.col("qa_results")[m], 2).alias(m) for m in ("exact_match", "f1_score")],
        F.round(F.col("total_llm_cost") * 100, 2).alias(COST),
    ).withColumn("num_context", F.col("num_context").cast("int"))


COMPONENTS = (
    "exp", "retriever", "reranker", "zoom", "generator", "model", "num_context", "linearization",
    "template", "metadata",
)


def flat_report(records: DataFrame, experiment: str) -> DataFrame:
    """The rows of one experiment, its own columns, sorted on all of them."""
    columns = [*FLAT_REPORTS[experiment], *ACCURACIES, COST]
    rows = report_rows(records).where(F.col("exp") == experiment)
    return rows.select(*columns).orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in columns])


def pivot_report(records: DataFrame, experiment: str, models=MODELS) -> DataFrame:
    """Components down, ``metric|model`` across, in a fixed order; two runs in one cell are an error.

    Each cell is the single value found for it, so the pivot is one grouping with no wide shuffle.
    """
    index, metrics = PIVOT_REPORTS[experiment]
    rows = report_rows(records).where(F.col("exp") == experiment)

    def cell(metric: str, model: str) -> Column:
        here = F.col("model") == model
        return F.when(
            F.count_if(here) > 1, F.raise_error(F.lit("several runs for one cell")).cast("double")
        ).otherwise(F.max(F.when(here, F.col(f"`{metric}`"))))

    cells = [cell(m, model).alias(f"{m}|{model}") for m in metrics for model in models]
    return rows.groupBy(*index).agg(*cells).orderBy(*index)


def run_counters(answers: DataFrame, run_keys=("run_id",)) -> DataFrame:
    """Contexts that were cut and questions processed, per run."""
    return answers.groupBy(*run_keys).agg(
        F.count_if("was_cut").alias("cutoff_context_ctr"),
        F.count("*").alias("processed_queries_ctr"),
    )


def off_size_selections(sizes: DataFrame, num_tables: int, run_keys=("run_id",)) -> DataFrame:
    """How many questions had a zoom selection of another size than asked for."""
    return sizes.groupBy(*run_keys).agg(
        F.count_if(F.col("num_selected") != num_tables).alias("off_size_ctr")
    )


# Counters that a record may have; the first two always.
COUNTERS = (
    "cutoff_context_ctr", "processed_queries_ctr", "off_size_ctr", "failed_replies_ctr", "prompt_tokens", "completion_tokens",
)


def run_records(
    configs: DataFrame, retrieval: DataFrame, answers: DataFrame, counters: DataFrame, costs: DataFrame,
    k_values=(1, 3, 5, 10, 100),
) -> DataFrame:
    """One nested record per run from per-run relations, each already one row per ``run_id``."""
    accuracy = F.map_from_arrays(
        F.array(*[F.lit(f"Accuracy@{k}") for k in k_values]),
        F.array(*[F.col(f"accuracy_at_{k}") for k in k_values]),
    )
    parts = [
        configs,
        retrieval.select("run_id", accuracy.alias("retrieval_results")),
        answers.select(
            "run_id", F.struct("exact_match", "relaxed_match", "f1_score").alias("qa_results")
        ),
        counters,
        costs.select("run_id", F.col("cost_per_question").alias("total_llm_cost")),
    ]
    joined = reduce(lambda a, b: a.join(b, "run_id", "left"), parts)
    return joined.select(
        "run_id",
        *[c for c in COUNTERS if c in counters.columns],
        "retrieval_results",
        "qa_results",
        "total_llm_cost",
        "config",
    )
