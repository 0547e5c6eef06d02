"""Best-fit packing of token pieces into sequences, with lower bounds that certify the bin counts."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lakeqa.scale import cut_lineage

CAPACITY = 2048
GROUP_ROWS = 100_000
ROUNDS = 6
# Bins with more than this share left empty give their documents to the next round.
LOOSE_SHARE = 0.002
# Text that a task encodes at once; words are encoded once in it.
CHUNK_BYTES = 16 << 20
# Words whose ids are put in place at once.
GATHERED_CODES = 1 << 16
END_ID = 0
_MARKS = b".,!?;:"


class WordEncoder:
    """Ids of texts, joined, each distinct word of a chunk encoded once.

    Words of letters, the marks behind them apart, are encoded many at a time: their last token
    ends with the vocabulary's mark of a word's end, so the ids can be told apart. Other words, and
    all where the vocabulary has no such mark, are encoded one by one.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_str(definition)
        vocabulary = self.encoder.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _one_by_one(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode("utf-8", "replace") for w in words]
        coded = [c.ids for c in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(c) for c in coded], np.int64)
        return np.array([i for c in coded for i in c], np.uint32), sizes

    def _together(self, stems: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for at in range(0, len(stems), 2000):
            part = stems[at : at + 2000]
            ids, _ = self._one_by_one([b" ".join(part)])
            ends = np.flatnonzero(self.last[ids]) + 1
            fits = len(ends) == len(part) and ends[-1] == len(ids)
            parts.append((ids, np.diff(ends, prepend=0)) if fits else self._one_by_one(part))
        return _joined(parts)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, joined, and how many each has."""
        stems, others, tails = {}, {}, {b"": 0}
        halves = np.empty((len(words), 2), np.int64)
        for at, word in enumerate(words):
            stem = word.rstrip(_MARKS)
            if stem.isalpha():
                key = stem.lower()
            elif stem and not stem.isascii() and _letters(stem):
                key = stem
            else:
                halves[at] = -1 - others.setdefault(word, len(others)), 0
                continue
            halves[at] = stems.setdefault(key, len(stems)), tails.setdefault(word[len(stem) :], len(tails))
        ids, sizes = _joined([self._together(list(stems)), self._one_by_one(list(others)), self._one_by_one(list(tails))])
        first = halves[:, 0]
        codes = np.stack([np.where(first < 0, len(stems) - 1 - first, first), len(stems) + len(others) + halves[:, 1]], axis=1)
        return _gathered(ids, sizes, codes.ravel()), sizes[codes].sum(axis=1)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``texts`` (no nulls), joined, an end id behind each, and how many each has with it."""
        lists = pc.ascii_split_whitespace(texts)
        begins = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        # Blanks at an end of a text leave empty words there.
        known = self.words(coded.dictionary.cast(pa.binary()).to_pylist())
        ids, sizes = _joined([known, (np.array([END_ID], np.uint32), np.ones(1, np.int64))])
        ends = begins[1:] + np.arange(len(lists))
        codes = np.empty(len(lists.values) + len(lists), np.int64)
        inside = np.ones(len(codes), bool)
        inside[ends] = False
        codes[ends] = len(sizes) - 1
        codes[inside] = coded.indices.to_numpy(zero_copy_only=False)
        counts = np.add.reduceat(sizes[codes], begins[:-1] + np.arange(len(lists))) if len(lists) else begins[:0]
        return _gathered(ids, sizes, codes), counts


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([np.zeros(0, np.uint32), *(p[0] for p in parts)])
    return ids, np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])


def _gathered(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The sequences of ``codes``, one behind the other; sequence c has ``sizes[c]`` of the joined ``ids``.

    Places are worked out for GATHERED_CODES codes at a time; those of all would be several times the result.
    """
    starts, parts = np.cumsum(sizes) - sizes, []
    for at in range(0, len(codes), GATHERED_CODES):
        part = codes[at : at + GATHERED_CODES]
        counts = sizes[part]
        places = np.repeat(starts[part] - (np.cumsum(counts) - counts), counts)
        places += np.arange(len(places))
        parts.append(ids[places])
    return np.concatenate([ids[:0], *parts])


def _letters(stem: bytes) -> bool:
    """Whether the tokenizer's normal form of this word is one run of letters, as the word is."""
    try:
        text = stem.decode()
    except UnicodeDecodeError:
        return False
    return text.isalpha() and unicodedata.is_normalized("NFC", text) and text.lower().isalpha()


def tokenize(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Pieces of all documents (doc_id, text): uid, doc_id, piece, start, length, ids_crc32, and ids on request.

    ``tokenizer`` is the path of a tokenizers file whose ids never span white space; each distinct word
    of a chunk of texts is encoded once. A document is its ids and an end id; null text is empty. Only
    longer documents are cut, at multiples of ``capacity``. ``uid`` tells rows apart where doc_ids repeat
    or are null; the pieces are written once, so it stays.
    """
    definition = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    schema = pa.schema(list(zip(names, kinds, strict=True))[: 7 if with_ids else 6])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = WordEncoder(definition.value)
        uid = TaskContext.get().partitionId() << 33

        for batch in batches:
            lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = lengths[at - 1] if at else 0
                part = batch.slice(at, max(1, int(np.searchsorted(lengths, before + CHUNK_BYTES, "right")) - at))
                at += part.num_rows
                ids, counts = encoder.texts(pc.fill_null(part.column(1), ""))
                raw = memoryview(ids.astype("<u4")).cast("B")
                pieces = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(counts[doc] - start, capacity)
                begin = (4 * ((np.cumsum(counts) - counts)[doc] + start)).tolist()
                spans = [raw[a : a + 4 * n] for a, n in zip(begin, length.tolist(), strict=True)]
                columns = [
                    pa.array(np.arange(uid, uid + len(doc))),
                    part.column(0).take(pa.array(doc)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array([zlib.crc32(span) for span in spans], pa.int64()),
                    *([pa.array([bytes(span) for span in spans], pa.binary())] if with_ids else []),
                ]
                uid += len(doc)
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    fields = "uid bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return cut_lineage(rows.mapInArrow(cut, fields + ", ids binary" * with_ids))


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins needed at least for ``counts[l]`` items of each length l, by dual feasible functions.

    The identity; for every e up to half, the function that rounds items over capacity - e up to a
    whole bin and items under e down to nothing; and the stair functions with k steps. Each keeps
    any set of items that fits one bin at a sum of one at most, so its sum over all items bounds
    the number of bins.
    """
    lengths = np.arange(capacity + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    volume = np.cumsum(counts * lengths)
    items = np.cumsum(counts)
    best = -(-int(volume[-1]) // capacity)
    e = np.arange(1, capacity // 2 + 1)
    big = items[-1] - items[capacity - e]
    middle = volume[capacity - e] - volume[e - 1]
    best = max(best, int((big - (-middle // capacity)).max(initial=0)))
    for k in range(1, 33):
        whole, rest = np.divmod((k + 1) * lengths, capacity)
        # In units of 1 / (k * capacity), to stay with integers.
        value = np.where(rest == 0, k * lengths, whole * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first, into the fullest bin that it fits."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, opened = 0, 0  # bit r of rooms: some bin has room for exactly r
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            held = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, held = capacity, opened
            opened += 1
        bins[item], offsets[item] = held, capacity - room
        if room > need:
            by_room[room - need].append(held)
            rooms |= 1 << (room - need)
    return bins, offsets


def _packed(rows: DataFrame, turn: int, capacity: int, group_rows: int) -> DataFrame:
    """One round: pieces dealt to groups of about ``group_rows`` by a digest, each packed by itself."""
    groups = max(1, -(-rows.count() // group_rows))
    loose = capacity * LOOSE_SHARE

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        lengths = group["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        fills = np.bincount(bins, lengths)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        # A certified group lets go only what a fuller bin elsewhere may take; one with a gap all that isn't full.
        room = capacity - fills > (loose if len(fills) <= bound else 0)
        first = (turn << 52) + (int(group["part"].iloc[0]) << 26)
        return pd.DataFrame({"uid": group["uid"], "length": lengths, "sequence_id": first + bins, "offset": offsets, "loose": room[bins]})

    dealt = rows.select(
        "uid", "length", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(groups)).alias("part")
    )
    fields = "uid bigint, length bigint, sequence_id bigint, offset bigint, loose boolean"
    return cut_lineage(dealt.groupBy("part").applyInPandas(pack, fields))


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    group_rows: int = GROUP_ROWS,
    with_ids: bool = False,
) -> DataFrame:
    """Packs all ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on request), a row
    for each piece; other columns of ``docs`` are not looked at, repeated rows are packed each.
    Pieces that fill a sequence are one. The rest is dealt to groups that are packed by best fit
    decreasing and certified by a lower bound. Until the total meets the bound of all pieces, bins
    with room give their documents up, those mix with the ones of other groups and are packed anew;
    a round that gains nothing is not kept, and ends the exchange.
    """
    pieces = tokenize(docs, tokenizer, capacity, with_ids)
    rest = pieces.where(F.col("length") < capacity).select("uid", "length")
    counts = np.zeros(capacity + 1, np.int64)
    for row in rest.groupBy("length").count().collect():  # capacity rows at most
        counts[row["length"]] = row["count"]
    bound = lower_bound(counts, capacity)
    bins = lambda rows: rows.where("offset = 0").count()
    open_rows = _packed(rest, 1, capacity, group_rows)
    settled, total = None, bins(open_rows)
    for turn in range(2, ROUNDS + 2):
        if total <= bound:
            break
        again = _packed(open_rows.where("loose"), turn, capacity, group_rows)
        gained = bins(open_rows.where("loose")) - bins(again)
        if gained <= 0:
            break
        firm = open_rows.where("NOT loose")
        settled = firm if settled is None else settled.unionByName(firm)
        open_rows, total = again, total - gained
    placed = open_rows if settled is None else settled.unionByName(open_rows)
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    full = pieces.where(F.col("length") == capacity).select(
        *kept, F.col("uid").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    shared = pieces.join(placed.select("uid", "sequence_id", "offset"), "uid")
    return full.unionByName(shared.select(*kept, "sequence_id", "offset"))
