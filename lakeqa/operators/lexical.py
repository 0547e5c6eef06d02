"""Lexical retrieval: an inverted index by document range, corpus statistics and BM25.

Relations
    docs        (ord, table_id)                          ord runs from 0 without gaps
    ranges      (ords, fields)                           one row per range of tables, see RANGES
    term_stats  (field, term, df, cf, idf)
    field_stats (field, num_docs, avg_len, avg_idf)      one row per field

One pass over the text makes the ranges, which are written. A range holds the postings of some hundred
tables that follow each other, by term, and for each term what its best posting there can be worth.
Statistics are sums over the ranges' terms; no posting is ever shuffled. Questions are scored range
by range inside tasks, which skip the ranges that cannot reach a question's k-th score any more.
"""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from lakeqa.functions import text as text_functions
from lakeqa.scale import BROADCAST_BYTES, cut_lineage, small_batches, wide_rows

# The scoring constants of the reference results.
K1 = 0.9
B = 0.4
EPSILON = 0.01

SCORE_DIGITS = 9

# Tables in a range at most. A range of long texts ends after the first table that passes RANGE_WORDS.
RANGE_TABLES = 512
RANGE_WORDS = 1 << 20
# Ranges, of one or two megabytes mostly, that a reader of the written index decodes at once.
GROUP_RANGES = 4
# Question weights that go to the tasks in one pass over the index.
TILE_BYTES = BROADCAST_BYTES
# Products of question weights and postings that a task holds at once, and candidates before it cuts them.
HELD_PRODUCTS = 1 << 19
HELD_CANDIDATES = 1 << 17
# Terms of ranges that a task adds up at once.
HELD_TERMS = 1 << 18

# Postings of a range lie by term, then table; ``docs`` are places in ``ords``. ``peak_tf`` and ``least_len``
# are, for each term, the largest count and the shortest table of its postings: no posting is worth
# more than one that has both. Binary columns are little-endian integers of 32 bits, ords of 64.
RANGES = (
    "ords binary, fields array<struct<field: string, lens: binary, terms: array<string>, dfs: array<int>, "
    "cfs: array<bigint>, docs: binary, tfs: binary, peak_tf: binary, least_len: binary>>"
)
_FIELD_STATS = pa.schema([("field", pa.string()), ("num_docs", pa.int64()), ("avg_len", pa.float64()), ("avg_idf", pa.float64())])
_POSTINGS = "field string, term string, ord bigint, tf bigint, doc_len bigint"

# From distinct words to the normal form of each.
Normalizer = Callable[[list[str]], list[str]]


@dataclass
class LexicalIndex:
    docs: DataFrame
    ranges: DataFrame
    term_stats: DataFrame
    field_stats: DataFrame
    num_fields: int
    # whether any term can weigh less than zero, which needs a field whose mean weight does
    below_zero: bool
    num_docs: int
    # for the words of the questions, as for those of the tables
    normalizer: Normalizer | None = None
    stop_words: tuple = ()


def field_words(
    tables: DataFrame, fields: dict[str, str], stop_words=text_functions.ENGLISH_STOP_WORDS
) -> DataFrame:
    """``(field, ord, words)``: one row per table and indexed field, nothing moved."""
    entries = F.array(
        *[
            F.struct(
                F.lit(field).alias("field"),
                text_functions.content_words(column, stop_words).alias("words"),
            )
            for field, column in fields.items()
        ]
    )
    return tables.select("ord", F.explode(entries).alias("_f")).select("_f.field", "ord", "_f.words")


def raw_postings(documents: DataFrame) -> DataFrame:
    """Count words inside each row: a table's own words never have to be shuffled to be counted."""
    ordered, starts = F.col("_ordered"), F.col("_starts")
    counted = F.transform(
        starts,
        lambda begin, i: F.struct(
            F.get(ordered, begin).alias("term"),
            text_functions.run_length(ordered, starts, begin, i).cast("bigint").alias("tf"),
        ),
    )
    return (
        documents.withColumn("_ordered", F.sort_array("words"))
        .withColumn("_starts", text_functions.run_starts(ordered))
        .select(
            "field", "ord", F.size(ordered).cast("bigint").alias("doc_len"),
            F.explode(counted).alias("_p"),
        )
        .select("field", "_p.term", "ord", "_p.tf", "doc_len")
    )


class _Words:
    """Normal forms of the words of a task, each found once; stop words have none."""

    # normal forms held: the words of a few ranges, however many words the lake has
    BOUND = 1 << 16

    def __init__(self, normalizer: Normalizer | None, stop_words):
        self.normalizer, self.known = normalizer, {}
        self.stop_words = pa.array(sorted(set(stop_words)), pa.string())

    def normal(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Sorted normal forms of the distinct ``words``, and the place of each word's there (-1: none)."""
        stopped = pc.is_in(words, value_set=self.stop_words).to_numpy(zero_copy_only=False)
        normal = words
        if self.normalizer is not None:
            if len(self.known) > self.BOUND:
                self.known.clear()
            listed = words.to_pylist()
            fresh = [w for w in listed if w not in self.known]
            self.known.update(zip(fresh, self.normalizer(fresh), strict=True))
            normal = pa.array([self.known[w] for w in listed], pa.string())
        coded = normal.filter(pa.array(~stopped)).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        places = np.full(len(words), -1, np.int64)
        places[~stopped] = rank[coded.indices.to_numpy(zero_copy_only=False)]
        return coded.dictionary.take(pa.array(order)), places


def _word_lists(spaced: pa.Array) -> pa.ListArray:
    """The words of each of the ``spaced`` texts, see ``text_functions.spaced_words``."""
    lists = pc.split_pattern(spaced, " ")
    kept = pc.binary_length(lists.values).to_numpy(zero_copy_only=False) > 0
    ends = np.concatenate([[0], np.cumsum(kept)])[lists.offsets.to_numpy()]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists.values.filter(pa.array(kept)))


def _field_of_range(name: str, lists: pa.ListArray, words: _Words) -> dict:
    """The postings of one field of a range; ``lists`` are the words of its tables."""
    offsets = lists.offsets.to_numpy()
    coded = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
    terms, places = words.normal(coded.dictionary)
    term = places[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(lists)), np.diff(offsets))[term >= 0]
    term = term[term >= 0]
    lens = np.bincount(doc, minlength=len(lists))
    met, tfs = np.unique(term * len(lists) + doc, return_counts=True)
    docs = met % max(1, len(lists))
    starts = np.searchsorted(met, np.arange(len(terms)) * len(lists))
    summed = lambda by, values: by.reduceat(values, starts) if len(starts) else values[:0]
    little = lambda values: np.asarray(values, "<i4").tobytes()
    return {
        "field": name,
        "lens": little(lens),
        "terms": terms,
        "dfs": np.diff(starts, append=len(met)).astype(np.int32),
        "cfs": summed(np.add, tfs),
        "docs": little(docs),
        "tfs": little(tfs),
        "peak_tf": little(summed(np.maximum, tfs)),
        "least_len": little(summed(np.minimum, lens[docs])),
    }


_FIELD_TYPE = pa.struct(
    [("field", pa.string()), ("lens", pa.binary()), ("terms", pa.list_(pa.string())), ("dfs", pa.list_(pa.int32())),
     ("cfs", pa.list_(pa.int64())), ("docs", pa.binary()), ("tfs", pa.binary()), ("peak_tf", pa.binary()), ("least_len", pa.binary())]
)


def _fields_column(fields: list[dict]) -> pa.Array:
    """A list column of one row without taking its terms through Python."""
    columns = []
    for member in _FIELD_TYPE:
        values = [f[member.name] for f in fields]
        if pa.types.is_list(member.type):
            ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
            flat = pa.concat_arrays([v if isinstance(v, pa.Array) else pa.array(v, member.type.value_type) for v in values])
            columns.append(pa.ListArray.from_arrays(pa.array(ends), flat))
        else:
            columns.append(pa.array(values, member.type))
    return pa.ListArray.from_arrays(pa.array([0, len(fields)], pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_FIELD_TYPE)))


def document_ranges(tables: DataFrame, fields: dict[str, str], normalizer: Normalizer | None, stop_words) -> DataFrame:
    """RANGES of ``tables(ord, …)``, made where the text lies: marked in the JVM, cut and counted in blocks.

    What lies between words becomes a blank in the JVM, as its regular expressions say what a word is;
    a string for each word is made nowhere. Each distinct word of a task meets the stop words and the
    normalizer once.
    """
    texts = tables.select(
        F.col("ord").cast("bigint").alias("ord"),
        *[text_functions.spaced_words(F.col(c)).alias(f"w{i}") for i, c in enumerate(fields.values())],
    )
    names = list(fields)

    def build(batches):
        words = _Words(normalizer, stop_words)
        for batch in batches:
            lists = [_word_lists(batch.column(i + 1)) for i in range(len(names))]
            sizes = sum(np.diff(w.offsets.to_numpy()) for w in lists)
            held = np.cumsum(sizes)
            at = 0
            while at < batch.num_rows:
                before = int(held[at - 1]) if at else 0
                end = min(at + RANGE_TABLES, int(np.searchsorted(held, before + RANGE_WORDS)) + 1, batch.num_rows)
                made = [_field_of_range(n, w.slice(at, end - at), words) for n, w in zip(names, lists, strict=True)]
                ords = np.asarray(batch.column(0).slice(at, end - at).to_numpy(), "<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([ords], pa.binary()), _fields_column(made)], names=["ords", "fields"])
                at = end

    return texts.mapInArrow(build, RANGES)


def _ranges_of(batches):
    """Ords and fields of each range in a stream; a field's terms stay an Arrow array."""
    for batch in batches:
        for row in range(batch.num_rows):
            ords = np.frombuffer(batch.column(0)[row].as_py(), "<i8")
            own = batch.column(1)[row].values
            fields = []
            for i in range(len(own)):
                field = {}
                for member in _FIELD_TYPE:
                    value = own.field(member.name)[i]
                    if pa.types.is_binary(member.type):
                        field[member.name] = np.frombuffer(value.as_py(), "<i4")
                    elif pa.types.is_list(member.type):
                        field[member.name] = value.values
                    else:
                        field[member.name] = value.as_py()
                fields.append(field)
            yield ords, fields


def _summed_terms(batches):
    """(field, term, df, cf) added up over some of a task's ranges at a time, in blocks."""

    def summed(parts: list[pa.Table]) -> list[pa.RecordBatch]:
        added = pa.concat_tables(parts).group_by(["field", "term"]).aggregate([("df", "sum"), ("cf", "sum")])
        return added.select(["field", "term", "df_sum", "cf_sum"]).rename_columns(["field", "term", "df", "cf"]).to_batches(max_chunksize=50_000)

    parts, held = [], 0
    for batch in batches:
        own = batch.column(0).flatten()
        for i in range(len(own)):
            terms, dfs, cfs = (own.field(n)[i].values for n in ("terms", "dfs", "cfs"))
            name = pa.array([own.field("field")[i].as_py()]).take(pa.array(np.zeros(len(terms), np.int64)))
            parts.append(pa.table({"field": name, "term": terms, "df": dfs.cast(pa.int64()), "cf": cfs}))
            held += len(terms)
            if held > HELD_TERMS:
                yield from summed(parts)
                parts, held = [], 0
    if parts:
        yield from summed(parts)


def _field_stats(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """From an Arrow table, as plain rows would be read by Python workers of another kind, a further one a core."""
    columns = zip(*rows, strict=True) if rows else [()] * len(_FIELD_STATS)
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, _FIELD_STATS.types, strict=True)], schema=_FIELD_STATS))


def statistics(ranges: DataFrame, num_docs: int) -> tuple[DataFrame, DataFrame, bool]:
    """``(term_stats, field_stats, below_zero)``; sums over the ranges' terms are written and not repeated."""
    needed = F.transform("fields", lambda f: F.struct(*[f[n].alias(n) for n in ("field", "terms", "dfs", "cfs")]))
    summed = ranges.select(needed.alias("fields")).mapInArrow(_summed_terms, "field string, term string, df bigint, cf bigint")
    with small_batches(ranges.sparkSession):
        counted = cut_lineage(summed.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")))
    idf = F.log(num_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    # One row per indexed field comes back, however large the lake.
    per_field = counted.groupBy("field").agg(
        F.lit(num_docs), F.sum("cf") / num_docs, F.avg(idf)
    )
    rows = [tuple(r) for r in per_field.collect()]
    field_stats = _field_stats(ranges.sparkSession, rows)
    below_zero = any(avg_idf < 0 for *_, avg_idf in rows)
    # Common terms with a negative weight get a small share of the mean weight instead. The mean
    # is over all terms, before this replacement.
    low = F.lit(None).cast("double")
    for name, *_, avg_idf in rows:
        low = F.when(F.col("field") == name, EPSILON * avg_idf).otherwise(low)
    term_stats = counted.select("field", "term", "df", "cf", F.when(idf < 0, low).otherwise(idf).alias("idf"))
    return term_stats, field_stats, below_zero


def build_index(
    tables: DataFrame,
    fields: dict[str, str],
    stop_words=text_functions.ENGLISH_STOP_WORDS,
    normalizer: Normalizer | None = None,
) -> LexicalIndex:
    """Index ``tables(ord, table_id, …)``; ``fields`` maps field names to text columns.

    ``normalizer`` is None, or a function from a list of distinct words to their normal forms.
    """
    docs = tables.select("ord", "table_id")
    with small_batches(tables.sparkSession):
        ranges = cut_lineage(document_ranges(tables, fields, normalizer, stop_words), GROUP_RANGES)
    num_docs = ranges.agg(F.coalesce(F.sum(F.octet_length("ords") / 8), F.lit(0)).cast("bigint")).first()[0]
    term_stats, field_stats, below_zero = statistics(ranges, num_docs)
    return LexicalIndex(
        docs, ranges, term_stats, field_stats, len(fields), below_zero, num_docs, normalizer, tuple(stop_words)
    )


def normal_postings(index: LexicalIndex) -> DataFrame:
    """All postings under their normal forms, taken out of the ranges in place."""

    def unpack(batches):
        for ords, fields in _ranges_of(batches):
            for field in fields:
                dfs = field["dfs"].to_numpy()
                for at in range(0, len(dfs), 10_000):
                    begin, size = int(dfs[:at].sum()), int(dfs[at : at + 10_000].sum())
                    docs = field["docs"][begin : begin + size]
                    which = np.repeat(np.arange(at, min(at + 10_000, len(dfs))), dfs[at : at + 10_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([field["field"]] * size, pa.string()), field["terms"].take(pa.array(which)), pa.array(ords[docs]),
                         pa.array(field["tfs"][begin : begin + size].astype(np.int64)), pa.array(field["lens"][docs].astype(np.int64))],
                        names=["field", "term", "ord", "tf", "doc_len"],
                    )

    return index.ranges.mapInArrow(unpack, _POSTINGS)


def write_index(index: LexicalIndex, path: str) -> None:
    """Persist an index once per corpus and linearization; read back, it is searched as it was when built."""
    wide_rows(index.ranges, GROUP_RANGES).parquet(f"{path}/ranges")
    index.docs.write.parquet(f"{path}/docs")
    index.term_stats.write.partitionBy("field").parquet(f"{path}/term_stats")
    index.field_stats.write.parquet(f"{path}/field_stats")


def read_index(
    spark: SparkSession, path: str, stop_words=text_functions.ENGLISH_STOP_WORDS, normalizer: Normalizer | None = None
) -> LexicalIndex:
    """A stored index; stop words and normalizer are those it was built with."""
    docs, ranges, term_stats, stored = (
        spark.read.parquet(f"{path}/{name}") for name in ("docs", "ranges", "term_stats", "field_stats")
    )
    per_field = [tuple(r) for r in stored.select("field", "num_docs", "avg_len", "avg_idf").collect()]
    field_stats = _field_stats(spark, per_field)
    below_zero = any(avg_idf < 0 for *_, avg_idf in per_field)
    return LexicalIndex(
        docs, ranges, term_stats, field_stats, len(per_field), below_zero, docs.count(), normalizer, tuple(stop_words)
    )


def question_terms(
    questions: DataFrame, stop_words=text_functions.ENGLISH_STOP_WORDS, normalizer: Normalizer | None = None
) -> DataFrame:
    """``(query_id, term, qtf)``: repeated question words count repeatedly."""
    words = questions.select(
        "query_id", F.explode(text_functions.content_words("query_text", stop_words)).alias("term")
    )
    if normalizer is not None:

        def normal(batches):
            known = _Words(normalizer, ())
            for batch in batches:
                coded = batch.column(1).dictionary_encode()
                terms, places = known.normal(coded.dictionary)
                taken = terms.take(pa.array(places[coded.indices.to_numpy(zero_copy_only=False)]))
                yield pa.RecordBatch.from_arrays([batch.column(0), taken], names=["query_id", "term"])

        words = words.select(F.col("query_id").cast("string").alias("query_id"), "term").mapInArrow(normal, "query_id string, term string")
    return words.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _weights(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """``(field, term, query_id, weight)`` of the question terms that the lake has."""
    return index.term_stats.join(F.broadcast(terms), "term").select(
        "field", "term", "query_id", (F.col("qtf") * F.col("idf")).alias("weight")
    )


class Asked:
    """The weights of some questions, by field and term."""

    def __init__(self, rows: list[tuple[str, str, str, float]], field_stats: dict[str, float]):
        """``rows`` are field, term, question, weight; ``field_stats`` the mean length of each field."""
        rows = sorted(rows)
        self.questions = sorted({r[2] for r in rows})
        number = {q: i for i, q in enumerate(self.questions)}
        self.fields = {}
        for name, mean in field_stats.items():
            own = [r for r in rows if r[0] == name]
            terms = sorted({r[1] for r in own})
            place = {t: i for i, t in enumerate(terms)}
            size = np.bincount([place[r[1]] for r in own], minlength=len(terms)) if own else np.zeros(0, np.int64)
            self.fields[name] = (
                pa.array(terms, pa.string()),
                np.concatenate([[0], np.cumsum(size)]).astype(np.int64),
                np.array([number[r[2]] for r in own], np.int64),
                np.array([r[3] for r in own], np.float64),
                mean,
            )


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of several slices one after the other, and the slice that each is of."""
    which = np.repeat(np.arange(len(starts)), sizes)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return starts[which] + inner, which


class RangeScorer:
    """The best ``k`` tables of each question over the ranges met so far.

    ``skipped`` counts pairs of a question and a range that were not scored as their bound is below the
    question's k-th score, ``scored`` those that were. With ``zeros`` tables that score zero compete too.
    """

    def __init__(self, asked: Asked, k: int, num_fields: int, zeros: bool = False):
        self.asked, self.k, self.num_fields, self.zeros = asked, k, num_fields, zeros
        count = len(asked.questions)
        self.least = np.full(count, -np.inf)
        self.whom, self.what, self.value = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.num_fresh = self.skipped = self.scored = 0
        # Unmatched tables can only be among the best where zeros compete or matches weigh less.
        self.need_match = not zeros and not any((w < 0).any() for *_, w, _ in asked.fields.values())

    def add(self, ords: np.ndarray, fields: list[dict]) -> None:
        matched, bound = [], np.zeros(len(self.asked.questions))
        for field in fields:
            terms, ends, whom, weight, mean = self.asked.fields[field["field"]]
            place = pc.index_in(field["terms"], value_set=terms).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(~np.isnan(place)) if place.dtype.kind == "f" else np.arange(len(place))
            if not len(at):
                continue
            term = place[at].astype(np.int64)
            asking, of = _spread(ends[term], ends[term + 1] - ends[term])
            peak = _worth(field["peak_tf"][at], field["least_len"][at], mean)
            bound += np.bincount(whom[asking], np.maximum(weight[asking], 0) * peak[of], len(bound))
            matched.append((field, at, term, mean))
        open_now = np.round(bound / self.num_fields, SCORE_DIGITS) + 10.0**-SCORE_DIGITS >= self.least
        if self.need_match:
            open_now &= bound > 0
        self.skipped += int((~open_now).sum())
        self.scored += int(open_now.sum())
        if not open_now.any():
            return
        rows = np.flatnonzero(open_now)
        row = np.full(len(open_now), -1, np.int64)
        row[rows] = np.arange(len(rows))
        step = max(1, HELD_PRODUCTS // max(1, len(ords)))
        for begin in range(0, len(rows), step):
            self._score(ords, matched, rows[begin : begin + step], row - begin, min(step, len(rows) - begin))
        if self.num_fresh > max(HELD_CANDIDATES, len(self.asked.questions) * self.k):
            self.cut()

    def _score(self, ords, matched, questions, row, count) -> None:
        """Whole scores of the tables of a range for ``questions``, whose rows are ``row``."""
        scores = np.zeros(count * len(ords))
        for field, at, term, mean in matched:
            _, ends, whom, weight, _ = self.asked.fields[field["field"]]
            begins = np.concatenate([[0], np.cumsum(field["dfs"].to_numpy())]).astype(np.int64)
            pairs = (ends[term + 1] - ends[term]) * (begins[at + 1] - begins[at])
            parts = np.searchsorted(np.cumsum(pairs), np.arange(0, pairs.sum(), HELD_PRODUCTS), "right")
            for first, last in zip(parts, [*parts[1:], len(at)], strict=True):
                own, asks = at[first:last], term[first:last]
                asking, of = _spread(ends[asks], ends[asks + 1] - ends[asks])
                inside = (row[whom[asking]] >= 0) & (row[whom[asking]] < count)
                asking, of = asking[inside], of[inside]
                posting, pair = _spread(begins[own[of]], begins[own[of] + 1] - begins[own[of]])
                docs = field["docs"][posting]
                worth = _worth(field["tfs"][posting], field["lens"][docs], mean)
                cell = row[whom[asking[pair]]] * len(ords) + docs
                scores += np.bincount(cell, weight[asking[pair]] * worth, len(scores))
        scores = (scores / self.num_fields).reshape(count, len(ords))
        near = np.round(scores, SCORE_DIGITS)
        kept = near >= self.least[questions][:, None]
        if not self.zeros:
            kept &= near != 0
        q, d = np.nonzero(kept)
        self.fresh.append((questions[q], ords[d], scores[q, d]))
        self.num_fresh += len(q)

    def cut(self) -> None:
        """Keeps the best ``k`` of each question: by score, ties by file order."""
        columns = zip((self.whom, self.what, self.value), *self.fresh, strict=True)
        whom, what, value = (np.concatenate(c) for c in columns)
        order = np.lexsort((what, -np.round(value, SCORE_DIGITS), whom))
        sorted_whom = whom[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_whom, sorted_whom)
        order, place = order[place < self.k], place[place < self.k]
        self.whom, self.what, self.value = whom[order], what[order], value[order]
        last = place == self.k - 1
        self.least[self.whom[last]] = np.round(self.value[last], SCORE_DIGITS)
        self.fresh, self.num_fresh = [], 0


def _worth(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def best_in_tasks(index: LexicalIndex, terms: DataFrame, k: int, zeros: bool = False) -> DataFrame:
    """``(query_id, ord, score)``: the best ``k`` tables of every question in every task, written.

    ``terms`` are those of ``question_terms``, written. Weights go to the tasks, at most about TILE_BYTES in one pass over the ranges; more questions take
    more passes. No pair of a question and a table moves before it is among the best of its task.
    """
    # A term's weights are its row once for each field; so measuring the terms bounds what is sent.
    size = F.octet_length("term") + F.octet_length("query_id") + 64
    total = index.num_fields * terms.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()[0]
    tiles = max(1, -(-total // TILE_BYTES))
    means = {r["field"]: r["avg_len"] for r in index.field_stats.collect()}
    spark, num_fields = index.ranges.sparkSession, index.num_fields
    found = None
    for tile in range(tiles):
        own = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(tiles)) == tile) if tiles > 1 else terms
        rows = _weights(index, own)
        sent = spark.sparkContext.broadcast(
            Asked([tuple(r) for r in rows.select("field", "term", "query_id", "weight").collect()], means)
        )

        def best(batches, sent=sent):
            asked = sent.value
            scorer = RangeScorer(asked, k, num_fields, zeros)
            for ords, fields in _ranges_of(batches):
                scorer.add(ords, fields)
            scorer.cut()
            ids = pa.array(asked.questions, pa.string()).take(pa.array(scorer.whom))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(scorer.what), pa.array(scorer.value)], names=["query_id", "ord", "score"]
            )

        with small_batches(spark):
            part = cut_lineage(index.ranges.mapInArrow(best, "query_id string, ord bigint, score double"))
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def rank_tables(scored: DataFrame, k: int) -> DataFrame:
    """Best ``k`` tables per question, ties by file order; cut per partition before the exchange."""
    order = W.partitionBy("query_id").orderBy(F.round("score", SCORE_DIGITS).desc(), "ord")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "ord", F.col("rank").cast("bigint").alias("rank"), "score")
    )


_CHUNK = 4096


def zero_fill(questions: DataFrame, off_zero: DataFrame, num_docs: int, k: int, complete: bool = False) -> DataFrame:
    """Add unmatched tables at score 0, lowest ``ord`` first, where fewer than ``k`` score above 0.

    Of the first k + b tables, b being how many score below zero, at least as many as are missing
    score exactly zero; so no higher ordinal is ever needed. With ``complete`` only questions
    without any row need tables.
    """
    counts = off_zero.groupBy("query_id").agg(
        F.count_if(F.col("score") > 0).alias("above"), F.count_if(F.col("score") < 0).alias("below")
    )
    upto = (
        questions.select("query_id")
        .join(counts, "query_id", "left")
        .where(F.col("above").isNull() if complete else F.coalesce("above", F.lit(0)) < k)
        .select("query_id", F.least(k + F.coalesce("below", F.lit(0)), F.lit(num_docs)).alias("upto"))
        .where("upto > 0")
    )
    chunks = upto.select(
        "query_id",
        "upto",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(upto - 1) div {_CHUNK}"))).alias("c"),
    )
    positions = chunks.select(
        "query_id",
        F.explode(
            F.sequence(F.col("c") * _CHUNK, F.least((F.col("c") + 1) * _CHUNK, F.col("upto")) - 1)
        ).alias("ord"),
    )
    filler = positions.join(off_zero.select("query_id", "ord"), ["query_id", "ord"], "left_anti")
    return off_zero.select("query_id", "ord", "score").unionByName(
        filler.select("query_id", "ord", F.lit(0.0).alias("score"))
    )


def bm25_hits(questions: DataFrame, index: LexicalIndex, k: int = 100, fill: bool = True) -> DataFrame:
    """``hits(query_id, table_id, rank, score)``: BM25 over one field, or the mean of several.

    All tables compete, so with ``fill`` a question always gets min(k, number of tables) hits.
    """
    terms = cut_lineage(question_terms(questions, index.stop_words, index.normalizer))
    # Where scores can be below zero, unmatched tables compete in the tasks. Else a question's best
    # k matches are all its matches whenever it has to be filled.
    zeros = fill and index.below_zero
    matches = cut_lineage(rank_tables(best_in_tasks(index, terms, k, zeros), k))
    # Ordinals back to ids for ranked rows only: at most k per question, so measuring the questions
    # bounds what is sent to the tables.
    asked = questions.agg(
        F.count("*").alias("n"), F.coalesce(F.max(F.octet_length("query_id")), F.lit(0)).alias("id_bytes")
    ).first()
    if fill and matches.count() < asked["n"] * min(k, index.num_docs):
        matches = rank_tables(zero_fill(questions, matches, index.num_docs, k, zeros), k)
    small = asked["n"] * k * (asked["id_bytes"] + 64) <= BROADCAST_BYTES
    return (F.broadcast(matches) if small else matches).join(index.docs, "ord").select(
        "query_id", "table_id", "rank", "score"
    )
