"""The model-free default embedder: hashed word counts, weighted by rarity, as an estimator and its model."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F, types as T

from lakeqa.functions import text as text_functions


class _Settings(Params):
    num_features = Param(Params._dummy(), "num_features", "length of the vectors", TypeConverters.toInt)
    stop_words = Param(Params._dummy(), "stop_words", "words that don't count", TypeConverters.toListString)

    def _buckets(self, texts: DataFrame) -> DataFrame:
        """``texts`` with ``_buckets``, the place of each of its lower-cased words by crc32."""
        words = text_functions.content_words("_lowered", tuple(self.getOrDefault("stop_words")))
        size = self.getOrDefault("num_features")
        return texts.withColumn("_lowered", F.lower("text")).withColumn(
            "_buckets", F.transform(words, lambda w: (F.crc32(w) % size).cast("int"))
        ).drop("_lowered")


class HashedIdf(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Learns how rare each place is among the texts of a column ``text``."""

    @keyword_only
    def __init__(self, *, num_features=256, stop_words=()):
        super().__init__()
        self._set(num_features=num_features, stop_words=list(stop_words))

    def _fit(self, texts: DataFrame) -> "HashedIdfModel":
        """Weights log((n + 1) / (d + 1)) with d of all n texts having a word at the place."""
        rows = self._buckets(texts.select("text"))
        held = rows.select(F.explode(F.array_distinct("_buckets")).alias("at")).groupBy("at").count()
        # One number for each place comes back, however many texts there are.
        found, total = {r["at"]: r["count"] for r in held.collect()}, texts.count()
        size = self.getOrDefault("num_features")
        weights = [float(np.log((total + 1) / (found.get(at, 0) + 1))) for at in range(size)]
        return HashedIdfModel(num_features=size, stop_words=self.getOrDefault("stop_words"), weights=weights)


class HashedIdfModel(Model, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``vector``: a text's word counts by place times their weights, of length one (or zero).

    The weights are part of the model and go with it into ``save(path)`` and out of ``HashedIdfModel.load``;
    so vectors of one model can be compared whenever and in whatever order they were made.
    """

    weights = Param(Params._dummy(), "weights", "weight of each place", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, num_features=256, stop_words=(), weights=()):
        super().__init__()
        self._set(num_features=num_features, stop_words=list(stop_words), weights=list(weights))

    @property
    def model_id(self) -> str:
        """A digest of all that the vectors depend on."""
        settings = [self.getOrDefault(n) for n in ("num_features", "stop_words", "weights")]
        return hashlib.sha256(repr(["hashed-idf", *settings]).encode()).hexdigest()[:16]

    def _transform(self, texts: DataFrame) -> DataFrame:
        weights = np.array(self.getOrDefault("weights"))
        rows = self._buckets(texts)
        at = rows.columns.index("_buckets")
        schema = T.StructType([*texts.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

        def vectors(batches):
            for batch in batches:
                for begin in range(0, batch.num_rows, 1000):
                    part = batch.slice(begin, 1000)
                    lists = part.column(at)
                    doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                    places = doc * len(weights) + lists.flatten().to_numpy(zero_copy_only=False)
                    counts = np.bincount(places.astype(np.int64), minlength=len(lists) * len(weights))
                    weighted = counts.reshape(len(lists), -1) * weights
                    lengths = np.linalg.norm(weighted, axis=1, keepdims=True)
                    unit = (weighted / np.where(lengths > 0, lengths, 1)).astype(np.float32)
                    ends = np.arange(len(lists) + 1, dtype=np.int32) * len(weights)
                    made = pa.ListArray.from_arrays(pa.array(ends), pa.array(unit.ravel()))
                    kept = [c for i, c in enumerate(part.columns) if i != at]
                    names = [n for i, n in enumerate(part.schema.names) if i != at]
                    yield pa.RecordBatch.from_arrays([*kept, made], names=[*names, "vector"])

        return rows.mapInArrow(vectors, schema)

    __call__ = Model.transform
