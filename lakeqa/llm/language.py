"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

BINS = 1 << 16
# Documents that the regression is fitted on, dealt evenly to the languages: a bound for any corpus.
SAMPLE_DOCS = 4000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.02, 4
UNKNOWN = "und"
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins and counts of the 1- to 3-grams of the lower-cased characters of a whole text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    one = points * _MIX[0]
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _MIX[1] + points[1:] * _MIX[2]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _MIX[1] + points[2:] * _MIX[2]
    bins = np.concatenate([one, two, three])
    bins = ((bins ^ (bins >> np.uint32(16))) * _MIX[2]) >> np.uint32(16)
    counts = np.bincount(bins, minlength=BINS)
    used = np.flatnonzero(counts)
    return used, counts[used]


class LanguageModel:
    """Weights by bin and language, the bins' inverse document frequencies, and a temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf = languages, idf
        self.weights = np.zeros((BINS, len(languages)))
        self.temperature = 1.0

    def vector(self, used: np.ndarray, counts: np.ndarray) -> np.ndarray:
        values = (1 + np.log(counts)) * self.idf[used]
        return values / max(1e-12, math.sqrt(float(values @ values)))

    def fit(self, rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 5) -> LanguageModel:
        """Follow the regularised leader, with elastic net, example after example; every tenth row is
        kept for the temperature."""
        size = len(self.languages)
        lead, squares = np.zeros((BINS, size)), np.zeros((BINS, size))
        draw = np.random.default_rng(seed)
        held = [r for i, r in enumerate(rows) if i % 10 == 9]
        fitted = [r for i, r in enumerate(rows) if i % 10 != 9]

        def weights(at) -> np.ndarray:
            z = lead[at]
            shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
            return -shrunk / ((BETA + np.sqrt(squares[at])) / ALPHA + L2)

        for _ in range(EPOCHS):
            for i in draw.permutation(len(fitted)).tolist():
                label, used, counts = fitted[i]
                x = self.vector(used, counts)
                w = weights(used)
                slope = _softmax(x @ w)
                slope[label] -= 1
                g = x[:, None] * slope
                grown = squares[used] + g * g
                lead[used] += g - (np.sqrt(grown) - np.sqrt(squares[used])) / ALPHA * w
                squares[used] = grown
        self.weights = weights(slice(None))
        if held:
            logits = np.array([self.vector(u, c) @ self.weights[u] for _, u, c in held])
            labels = np.array([label for label, _, _ in held])
            self.temperature = float(min(np.geomspace(0.05, 20, 121), key=lambda t: _loss(logits / t, labels)))
        return self

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; ``und`` and 0 for null and for texts without a letter."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        used, counts = gram_counts(text)
        chances = _softmax(self.vector(used, counts) @ self.weights[used] / self.temperature)
        best = int(chances.argmax())
        return self.languages[best], float(chances[best])


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _loss(logits: np.ndarray, labels: np.ndarray) -> float:
    """Against targets a little short of certain, as one more right and one wrong row would make them:
    rows that are all told apart don't prove that none ever will be mistaken."""
    logs = np.log(_softmax(logits) + 1e-12)
    doubt = 1 / (len(labels) + 2)
    right = logs[np.arange(len(labels)), labels]
    return float(-((1 - doubt) * right + doubt * (logs.sum(1) - right) / max(1, logs.shape[1] - 1)).mean())


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _texts(column: pa.Array) -> list[str | None]:
    return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """The model from ``docs`` (text, lang). Rows with null text or lang teach nothing.

    Document frequencies come from all rows: each task sums its own, BINS numbers at most. The
    weights come from at most ``sample_docs`` rows, drawn for each language by a digest of the
    text, so the draw doesn't depend on partitions.
    """
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = np.zeros(BINS, np.int64), 0
        for batch in _parts(batches):
            for text in _texts(batch.column(0)):
                sums[gram_counts(text)[0]] += 1
                total += 1
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([*used.tolist(), -1], pa.int64()), pa.array([*sums[used].tolist(), total], pa.int64())], names=["bin", "n"])

    found = rows.select("text").mapInArrow(frequencies, "bin bigint, n bigint")
    sums = {r["bin"]: r["n"] for r in found.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    total = sums.pop(-1, 0)
    idf = np.full(BINS, math.log(1 + total) + 1)
    for at, n in sums.items():
        idf[at] = math.log((1 + total) / (1 + n)) + 1
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(shares)
    model = LanguageModel(languages, idf)
    if not languages:
        return model
    quota = max(1, sample_docs // len(languages))
    scale = 1_000_003
    # Somewhat more than the quota is drawn, as digests only nearly keep to their share.
    bound = F.create_map(*[F.lit(v) for k, n in shares.items() for v in (k, min(scale, 1 + int(scale * 1.2 * quota / n)))])
    digest = F.xxhash64("text", F.lit(11))
    drawn = rows.where(F.pmod(digest, F.lit(scale)) < bound[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            counted = [gram_counts(t) for t in _texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([u.astype(np.uint16).tobytes() for u, _ in counted], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in counted], pa.binary())], names=["lang", "digest", "used", "counts"])

    # Copies share a digest; one of each is enough, and keeps a hot text from filling the sample.
    sample = drawn.select("text", "lang", digest.alias("digest")).dropDuplicates(["lang", "digest"])
    sample = sample.mapInArrow(count, "lang string, digest bigint, used binary, counts binary")
    by_language: dict[str, list] = {}
    for row in sorted(sample.limit(3 * sample_docs).toLocalIterator(), key=lambda r: (r["lang"], r["digest"])):
        own = by_language.setdefault(row["lang"], [])
        if len(own) < quota:
            own.append((languages.index(row["lang"]), np.frombuffer(bytes(row["used"]), np.uint16).astype(np.int64), np.frombuffer(bytes(row["counts"]), np.uint32).astype(np.float64)))
    deal = [r for own in by_language.values() for r in own]
    order = np.random.default_rng(3).permutation(len(deal))
    return model.fit([deal[i] for i in order.tolist()])


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to ``docs``; columns of those names are replaced. Rows don't move."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            found = [held.value.predict(t) for t in _texts(batch.column(batch.schema.get_field_index(text)))]
            arrays = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*kept, "lang_pred", "score"])

    return rows.mapInArrow(judge, T.StructType([*rows.schema, *T.StructType.fromDDL("lang_pred string, score double")]))
