"""Benchmark decontamination: an FM-index over each shard of documents, searched for all test windows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakeqa.scale import cut_lineage, small_batches

WINDOW = 10
# So much benchmark text is searched for in one pass over the documents; more takes more passes.
BLOCK_BYTES = 16 << 20
SAMPLE_EVERY = 16
# Text of the documents that a task indexes at once, of whole texts. An index takes some tens of bytes a word.
SHARD_BYTES = 4 << 20

_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD_BYTES else 0x20 for c in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SPANS = "array<struct<start:bigint,end:bigint>>"


def words_of(body: bytes | None) -> list[bytes]:
    return body.translate(_TO_WORDS).split() if body else []


def in_order(ids: set[str | None]) -> list[str | None]:
    """Sorted ids; null, if there, is last."""
    return sorted(ids - {None}) + [None] * (None in ids)


class FMIndex:
    """Suffix order, wavelet ranks and sampled positions of a text of symbols; 0 separates and is never searched."""

    def __init__(self, text: np.ndarray, sample_every: int = SAMPLE_EVERY):
        if len(text) and text[-1]:
            text = np.append(text, 0)
        n = len(text)
        breaks = text == 0
        self.order = self._suffix_order(text, breaks)
        before = np.roll(text, 1)
        if n:
            before[0] = 0
        self.last = before[self.order]
        symbols = int(text.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.levels = []
        column = self.last
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = (column >> bit) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - ones)])
            self.levels.append((bit, zeros, zeros[-1]))
            column = np.concatenate([column[ones == 0], column[ones == 1]])
        # Kept: every sample_every-th position, and starts of runs, where a walk to the left ends.
        kept = (self.order % sample_every == 0) | (self.last == 0)
        self.kept, self.kept_before = kept, np.concatenate([[0], np.cumsum(kept)])
        self.samples = self.order[kept]
        del self.order

    @staticmethod
    def _suffix_order(text: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """By prefix doubling. Separators differ by place, so no comparison runs past one."""
        n = len(text)
        if n == 0:
            return np.empty(0, np.int64)
        rank = np.where(breaks, np.cumsum(breaks) - 1, int(breaks.sum()) + text).astype(np.int64)
        width = 1
        while True:
            after = np.zeros(n, np.int64)
            if width < n:
                after[: n - width] = rank[width:] + 1
            key = rank * (max(n, int(rank.max())) + 2) + after
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1:
                return order
            width *= 2

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the last column before each place."""
        low, high = np.zeros(len(places), np.int64), places.astype(np.int64)
        for bit, zeros, total in self.levels:
            one = ((symbols >> bit) & 1).astype(bool)
            low0, high0 = zeros[low], zeros[high]
            low = np.where(one, total + low - low0, low0)
            high = np.where(one, total + high - high0, high0)
        return high - low

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all windows (one a line, equal lengths), by backward search."""
        low = np.zeros(len(windows), np.int64)
        high = np.full(len(windows), len(self.last), np.int64)
        alive = np.arange(len(windows))
        for column in range(windows.shape[1] - 1, -1, -1):
            symbols = windows[alive, column]
            known = symbols < len(self.first) - 1
            low[alive[~known]] = high[alive[~known]] = 0
            alive, symbols = alive[known], symbols[known]
            low[alive] = self.first[symbols] + self.rank(symbols, low[alive])
            high[alive] = self.first[symbols] + self.rank(symbols, high[alive])
            alive = alive[low[alive] < high[alive]]
        found = np.zeros(len(windows), bool)
        found[alive] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk left until a sampled one."""
        rows, steps = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.kept[rows])
        while len(walking):
            symbols = self.last[rows[walking]]
            rows[walking] = self.first[symbols] + self.rank(symbols, rows[walking])
            steps[walking] += 1
            walking = walking[~self.kept[rows[walking]]]
        return self.samples[self.kept_before[rows]] + steps


class Phrases:
    """The windows of a block of benchmark items, over the block's own vocabulary (numbers from 1)."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple, set[str | None]] = {}
        for item, body in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(body)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[at : at + window]), set()).add(item)
        self.by_length = {
            n: (np.array(own, np.int64).reshape(len(own), n), [in_order(owners[w]) for w in own])
            for n in {len(w) for w in owners}
            if (own := [w for w in owners if len(w) == n])
        }
        self.shortest = min(self.by_length, default=0)

    def find(self, bodies: list[bytes | None]) -> tuple[list[int], list[list], list[set]]:
        """Of each text: its number of words, the word spans of windows in it, and their items."""
        counts, hits, items = [], [[] for _ in bodies], [set() for _ in bodies]
        columns, starts, at = [], [], 0
        for body in bodies:
            words = words_of(body)
            counts.append(len(words))
            starts.append(at)
            columns.append(np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words)))
            columns.append(np.zeros(1, np.int64))
            at += len(words) + 1
        if not self.by_length or not bodies:
            return counts, hits, items
        text = np.concatenate(columns)
        # A run of benchmark words too short for any window can hold none: the index leaves it out.
        edge = np.diff(np.concatenate([[0], text != 0, [0]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - begin >= self.shortest
        cover = np.zeros(len(text) + 1, np.int64)
        cover[begin[long]] += 1
        cover[np.minimum(end[long] + 1, len(text))] -= 1  # with the separator after it
        origin = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        index, starts = FMIndex(text[origin]), np.array(starts)
        for length, (windows, owners) in self.by_length.items():
            low, high = index.search(windows)
            sizes = high - low
            if not sizes.sum():
                continue
            which = np.repeat(np.arange(len(windows)), sizes)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which]
            places = origin[index.locate(rows)]
            docs = np.searchsorted(starts, places, side="right") - 1
            for doc, place, own in zip(docs.tolist(), (places - starts[docs]).tolist(), which.tolist(), strict=True):
                hits[doc].append((place, place + length))
                items[doc].update(owners[own])
        return counts, hits, items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def text_spans(body: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as spans of code points."""
    bounds = [m.span() for m in _WORD.finditer(body)]
    place = lambda at: len(body[:at].decode("utf-8", "replace"))
    return [(place(bounds[a][0]), place(bounds[b - 1][1])) for a, b in spans]


def shards_of(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``size`` bytes of ``text``, a row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends, at = np.cumsum(lengths.to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            count = max(1, int(np.searchsorted(ends, before + size, "right")) - at)
            yield batch.slice(at, count)
            at += count


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    text: str = "text",
    unnamed: bool = False,
) -> DataFrame:
    """Adds ``n_words``, ``hit_words``, ``hit_items`` and ``spans`` to ``docs``; columns of those names are replaced.

    Words are runs of letters a-z (A-Z lower-cased), digits and characters beyond ASCII. A window is
    ``window`` consecutive words of a benchmark item (item_id, text), or all of a shorter item; an
    item without words, or with null text, has none, and one with null id only if ``unnamed``: all
    such items are then one, a null at the end of ``hit_items`` (so it counts in its size and is not
    in its joined text). ``hit_words`` are the merged word spans
    inside any occurrence of a window, ``spans`` the same as code points of the text, ``hit_items``
    the item ids, as sorted strings. Null texts have no words. Documents of about SHARD_BYTES of text,
    or one document, are a shard with an index of its own, so rows never move. The
    benchmark is read in blocks of at most about ``block_bytes``, each a further pass.
    """
    named = F.lit(True) if unnamed else F.col("item_id").isNotNull()
    items = benchmark.where(named & F.col("text").isNotNull()).select(
        F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("body")
    )
    total = items.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    added = ("n_words", "hit_words", "hit_items", "spans")
    kept = [c for c in docs.columns if c not in added]
    out = docs.select(*[F.col(f"`{c}`") for c in kept])
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = {"n_words": pa.int64(), "hit_words": pair, "hit_items": pa.list_(pa.string()), "spans": pair}
    schema = T.StructType.fromDDL(
        f"n_words bigint, hit_words {SPANS}, hit_items array<string>, spans {SPANS}"
    )
    shard_bytes = SHARD_BYTES
    as_rows = lambda spans: [{"start": a, "end": b} for a, b in spans]

    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == block)
        phrases = Phrases([(r["item"], bytes(r["body"])) for r in mine.toLocalIterator()], window)

        def find(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            for batch in shards_of(batches, text, shard_bytes):
                held = dict(zip(batch.schema.names, batch.columns, strict=True))
                bodies = held[text].cast(pa.binary()).to_pylist()
                counts, hits, found = phrases.find(bodies)
                rows = {c: [] for c in added}
                earlier = held["hit_words"].to_pylist() if "hit_words" in held else repeat([])
                known = held["hit_items"].to_pylist() if "hit_items" in held else repeat([])
                for body, n, new, own, old, ids in zip(bodies, counts, hits, found, earlier, known):
                    spans = merge_spans([*new, *((s["start"], s["end"]) for s in old)])
                    rows["n_words"].append(n)
                    rows["hit_words"].append(as_rows(spans))
                    rows["hit_items"].append(in_order({*own, *ids}))
                    rows["spans"].append(as_rows(text_spans(body, spans)) if spans else [])
                arrays = [held[c] for c in kept] + [pa.array(rows[c], kinds[c]) for c in added]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *added])

        out = out.mapInArrow(find, T.StructType([*docs.select(*[F.col(f"`{c}`") for c in kept]).schema, *schema]))
    return out


def replace_spans(text: Column, spans: Column, filler: str = " ") -> Column:
    """``text`` with ``filler`` in place of each of the sorted, disjoint ``spans`` (code points)."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda i: F.substring(
            text,
            F.when(i == 0, F.lit(1)).otherwise(F.get(spans, i - 1)["end"] + 1).cast("int"),
            (
                F.coalesce(F.get(spans, i.cast("int"))["start"], F.length(text).cast("bigint"))
                - F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
            ).cast("int"),
        ),
    )
    return F.when(F.size(spans) > 0, F.array_join(pieces, filler)).otherwise(text)


def replaced_length(text: Column, spans: Column, filler: str = " ") -> Column:
    """Code points of what ``replace_spans`` gives."""
    gone = F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return F.length(text) - gone + F.size(spans) * len(filler)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every benchmark passage cut out of ``text``, those of items without an id too;
    ``n_chars``, if there, follows.

    Documents without a hit keep their text unchanged. A document that is left without words goes;
    one that had none before stays. The passages are written beside the texts.
    """
    with small_batches(docs.sparkSession):
        found = cut_lineage(find_contamination(docs, benchmark, window, unnamed=True))
    hit = F.aggregate("hit_words", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    left = found.where((hit == 0) | (hit < F.col("n_words")))
    new = {"text": replace_spans(F.col("text"), F.col("spans"))}
    if "n_chars" in docs.columns:
        length = replaced_length(F.col("text"), F.col("spans")).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.size("spans") > 0, length).otherwise(F.col("n_chars"))
    return left.withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])
