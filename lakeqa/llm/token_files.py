"""Token ids of documents as sorted ORC files: written by shard, read by stripe, pruned by their metadata."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeqa.scale import broadcast_if_small, cut_lineage

END_ID = 2
SHARD_TOKENS = 1 << 27
LEAST_SHARD_TOKENS = 1 << 20
STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1000
# Text that a task encodes at once; words are encoded once in it.
CHUNK_BYTES = 6 << 20
PLACED_ROWS = 1000
# Pieces, the first it meets, whose ids a worker keeps for all its chunks: some MB.
KEPT_PIECES = 1 << 18
# Every character that some definition calls white space, for both kinds of regular expressions.
_SPACE = "\\s\u0085\u00a0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff\x1c-\x1f\x0b"
_UNSAFE = f" [{_SPACE}]|[{_SPACE}] |^ | $"
_SAFE_BLANK = re.compile(f"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")
_MARKS = ".,!?;:"


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Slices of ``values``, one behind the other."""
    kind = np.int32 if len(values) < 1 << 30 and sizes.sum() < 1 << 30 else np.int64
    places = np.repeat((starts - (np.cumsum(sizes) - sizes)).astype(kind), sizes)
    places += np.arange(len(places), dtype=kind)
    return values[places]


class PieceEncoder:
    """Ids of whole texts, each distinct piece between blanks encoded once.

    A byte-level vocabulary never joins what lies before a blank to what lies behind it, if neither
    neighbour of the blank is white space; only there texts are cut. A token that starts with the
    vocabulary's sign of a blank then starts a piece, so many pieces are encoded in one call. Marks
    behind a letter are encoded apart, as no token has both.
    """

    def __init__(self, definition: str, end_id: int | None = None):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_str(definition)
        vocabulary = self.encoder.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        self.starts[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.ending = [] if end_id is None else [end_id]
        self.kept = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [c.ids for c in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(c) for c in coded], np.int64)
        return np.array([i for c in coded for i in c], np.uint32), sizes

    def _with_blanks(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that stand behind a blank."""
        ids, sizes = [], []
        for at in range(0, len(pieces), 2000):
            part = pieces[at : at + 2000]
            own, _ = self._one_by_one([" " + " ".join(part)])
            begins = np.flatnonzero(self.starts[own])
            if len(begins) == len(part) and begins[0] == 0:
                counts = np.diff(begins, append=len(own))
            else:
                own, counts = self._one_by_one([" " + piece for piece in part])
            ids.append(own)
            sizes.append(counts)
        return np.concatenate(ids or [np.zeros(0, np.uint32)]), np.concatenate(sizes or [np.zeros(0, np.int64)])

    def _behind_blanks(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces that stand behind a blank; those that are kept are looked up."""
        kept, ids, sizes = self.kept
        place = pc.index_in(pieces, value_set=kept)
        fresh = place.is_null().to_numpy(zero_copy_only=False)
        new = self._with_blanks(pieces.filter(pa.array(fresh)).to_pylist())
        ids, sizes = np.concatenate([ids, new[0]]), np.concatenate([sizes, new[1]])
        place = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[fresh] = len(kept) + np.arange(int(fresh.sum()))
        more = min(int(fresh.sum()), KEPT_PIECES - len(kept))
        if more > 0:
            count = len(kept) + more
            texts = pa.concat_arrays([kept, pieces.filter(pa.array(fresh))[:more]])
            self.kept = texts, ids[: int(sizes[:count].sum())].copy(), sizes[:count].copy()
        return _gathered(ids, (np.cumsum(sizes) - sizes)[place], sizes[place]), sizes[place]

    def _encode(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        begins = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values
        rest = np.ones(len(flat), bool)
        rest[begins[:-1]] = False
        inner, first = flat.filter(pa.array(rest)).dictionary_encode(), flat.take(pa.array(begins[:-1])).dictionary_encode()
        pieces = inner.dictionary
        stems = pc.utf8_rtrim(pieces, characters=_MARKS)
        last = pc.utf8_slice_codeunits(stems, -1)
        marked = pc.and_(pc.not_equal(stems, pieces), pc.and_(pc.utf8_is_alpha(last), pc.less_equal(last, "\u024f")))
        base = pc.if_else(marked, stems, pieces).dictionary_encode()
        tails = pc.if_else(marked, pc.struct_field(pc.extract_regex(pieces, f"(?P<t>[{_MARKS}]*)$"), "t"), "").dictionary_encode()
        number = lambda coded: coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # The ids of a distinct piece are those of its stem and of its marks.
        halves = [self._behind_blanks(base.dictionary), self._one_by_one(tails.dictionary.to_pylist())]
        ids, sizes = (np.concatenate(column) for column in zip(*halves, strict=True))
        codes = np.stack([number(base), len(halves[0][1]) + number(tails)], axis=1)
        whole = _gathered(ids, (np.cumsum(sizes) - sizes)[codes.ravel()], sizes[codes.ravel()]), sizes[codes].sum(axis=1)
        parts = [whole, self._one_by_one(first.dictionary.to_pylist()), (np.array(self.ending, np.uint32), np.array([len(self.ending)]))]
        ids, sizes = (np.concatenate(column) for column in zip(*parts, strict=True))
        # The end of a document is one more piece of it.
        at = begins[:-1] + np.arange(len(lists))
        places = np.full(len(flat) + len(lists), len(sizes) - 1, np.int64)
        inside = np.ones(len(places), bool)
        inside[at] = inside[begins[1:] + np.arange(len(lists))] = False
        places[inside] = number(inner)
        places[at] = len(pieces) + number(first)
        counts = sizes[places]
        totals = np.add.reduceat(counts, at) if len(lists) else np.zeros(0, np.int64)
        return _gathered(ids, (np.cumsum(sizes) - sizes)[places], counts), totals

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` (no nulls), joined, with the end id behind each, and their counts."""
        unsafe = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        cut = [_SAFE_BLANK.split(t) for t in texts.filter(pa.array(unsafe)).to_pylist()]
        parts = [self._encode(pc.split_pattern(texts.filter(pa.array(~unsafe)), " ")), self._encode(pa.array(cut, pa.list_(pa.string())))]
        ids, sizes = (np.concatenate(column) for column in zip(*parts, strict=True))
        # Back into the order of the texts.
        order = np.argsort(np.argsort(unsafe, kind="stable"), kind="stable")
        return _gathered(ids, (np.cumsum(sizes) - sizes)[order], sizes[order]), sizes[order]


@lru_cache(maxsize=1)
def _encoder(definition: str, end_id: int | None) -> PieceEncoder:
    """One for all tasks of a worker: reading a vocabulary takes as long as some MB of text."""
    return PieceEncoder(definition, end_id)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, uid, n_tokens, ids_crc32, width and ids of every row of ``docs`` (doc_id, text), written once.

    ``ids`` are compressed little-endian integers of ``width`` bytes: two where the vocabulary allows
    it, else four. ``uid`` tells rows apart that share a doc_id; the table is written, so it stays.
    """
    definition = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())
    names = ("doc_id", "uid", "n_tokens", "ids_crc32")
    schema = pa.schema([*((n, pa.int64()) for n in names), ("width", pa.int8()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(definition.value, end_id)
        width = 2 if max(len(encoder.starts) - 1, end_id) < 1 << 16 else 4
        squeeze = _codec().compress
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = lengths[at - 1] if at else 0
                part = batch.slice(at, max(1, int(np.searchsorted(lengths, before + CHUNK_BYTES, "right")) - at))
                at += part.num_rows
                ids, sizes = encoder.encode(pc.fill_null(part.column(1), ""))
                raw, narrow = memoryview(ids.astype("<u4")).cast("B"), memoryview(ids.astype(f"<u{width}")).cast("B")
                ends = np.cumsum(sizes).tolist()
                spans = list(zip([0, *ends], ends))
                columns = [
                    part.column(0),
                    pa.array(np.arange(uid, uid + len(sizes))),
                    pa.array(sizes),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans], pa.int64()),
                    pa.array(np.full(len(sizes), width, np.int8)),
                    pa.array([squeeze(narrow[width * a : width * b], asbytes=True) for a, b in spans], pa.binary()),
                ]
                uid += len(sizes)
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    fields = ", ".join(f"{n} bigint" for n in names) + ", width tinyint, ids binary"
    return cut_lineage(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(encode, fields))


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Writes the ids of all ``docs`` (doc_id, text) under ``folder`` and returns its shards.

    ``tokenizer`` is the path of a byte-level tokenizers file; each document is its ids and
    ``end_id``, null text that end alone. ``folder/ids`` holds ORC files of doc_id, shard, place,
    n_tokens, ids: documents ascend by doc_id over all shards (null first; rows of one doc_id by
    length and checksum of their ids, so only equal ones are in any order), and ``place`` counts
    the ids before a document in its shard. Integers are run-length encoded; each stripe has a row
    index and a Bloom filter on doc_id. ``folder/shards`` holds a row for each shard: shard, n_docs,
    n_tokens, first_id, last_id and base, the ids before it in the corpus. Other columns of ``docs``
    are not looked at; an empty table writes no document and no shard.

    The sort is by range of (doc_id, length, checksum, uid), so copies of one doc_id, or of one
    document, spread over as many shards as they need.
    """
    spark = docs.sparkSession
    coded = encode_documents(docs, tokenizer, end_id)
    total = coded.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    smaller = min(spark.sparkContext.defaultParallelism, -(-total // LEAST_SHARD_TOKENS))
    shards = max(1, -(-total // shard_tokens), smaller)
    order = ["doc_id", "n_tokens", "ids_crc32", "uid"]
    schema = pa.schema(
        [("doc_id", pa.int64()), ("shard", pa.int32()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before, loosen = TaskContext.get().partitionId(), 0, _codec().decompress
        slices = (b.slice(at, PLACED_ROWS) for b in batches for at in range(0, b.num_rows, PLACED_ROWS))
        for batch in slices:
            doc_id, n_tokens, width, packed = batch.columns
            each = width[0].as_py()
            sizes = (each * n_tokens.to_numpy()).tolist()
            raw = b"".join(loosen(p, n, asbytes=True) for p, n in zip(packed.to_pylist(), sizes, strict=True))
            ids = pa.array(np.frombuffer(raw, f"<u{each}").astype(np.int32))
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_tokens.to_numpy())]).astype(np.int32)), ids)
            ends = before + np.cumsum(n_tokens.to_numpy())
            places = pa.array(ends - n_tokens.to_numpy())
            before = int(ends[-1])
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(np.full(batch.num_rows, shard, np.int32)), places, n_tokens, ids], schema=schema)

    ordered = coded.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    placed = ordered.select("doc_id", "n_tokens", "width", "ids").mapInArrow(
        place, "doc_id bigint, shard int, place bigint, n_tokens bigint, ids array<int>"
    )
    placed.write.options(
        **{
            "compression": "zstd",
            "orc.stripe.size": str(STRIPE_BYTES),
            "orc.rows.between.memory.checks": "200",
            "orc.create.index": "true",
            "orc.row.index.stride": str(ROW_INDEX_STRIDE),
            "orc.bloom.filter.columns": "doc_id",
            "orc.bloom.filter.fpp": "0.01",
        }
    ).orc(f"{folder}/ids")
    told = _ids(spark, folder).groupBy("shard").agg(
        F.count("*").alias("n_docs"),
        F.sum("n_tokens").alias("n_tokens"),
        F.min("doc_id").alias("first_id"),
        F.max("doc_id").alias("last_id"),
    )
    rows, base = [], 0
    for row in told.orderBy("shard").toLocalIterator():
        rows.append((*row, base))
        base += row["n_tokens"]
    fields = "shard int, n_docs bigint, n_tokens bigint, first_id bigint, last_id bigint, base bigint"
    spark.createDataFrame(rows, fields).coalesce(1).write.parquet(f"{folder}/shards")
    return read_shards(spark, folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    fields = "shard int, n_docs bigint, n_tokens bigint, first_id bigint, last_id bigint, base bigint"
    return spark.read.schema(fields).parquet(f"{folder}/shards")


def _ids(spark: SparkSession, folder: str) -> DataFrame:
    fields = "doc_id bigint, shard int, place bigint, n_tokens bigint, ids array<int>"
    return spark.read.schema(fields).orc(f"{folder}/ids")


def read_token_files(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids of the documents under ``folder``; of all, or of a bounded list of ids.

    A task reads the stripes that start in its split. Asked for ids, the reader skips files by
    their smallest and largest id, stripes by theirs and by Bloom filter, and row groups likewise.
    ``start`` counts the ids of all documents before one, over all shards.
    """
    rows = _ids(spark, folder)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    bases = broadcast_if_small(read_shards(spark, folder).select("shard", "base"))
    start = (F.col("base") + F.col("place")).alias("start")
    return rows.join(bases, "shard").select("doc_id", start, "n_tokens", "ids")


def check_sums(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the ids as read (little-endian unsigned 32-bit)."""

    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            offsets = ids.offsets.to_numpy()
            values = np.ascontiguousarray(ids.values.to_numpy(), "<i4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    fields = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return documents.select("doc_id", "start", "ids").mapInArrow(sums, fields)
