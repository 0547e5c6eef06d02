"""Language-model scoring: online logistic mixing of hashed-context bit predictors, beside word counts."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lakeqa.scale import cut_lineage, small_batches

# Contexts of 1 to 5 bytes; each has so many pages (a power of two) of counts for a half byte.
ORDERS = (1, 2, 3, 4, 5)
PAGE_BITS = (14, 16, 18, 18, 18)
SPAN = max(ORDERS)
START, END = 0xFE, 0xFF  # bytes that UTF-8 never has
PRIOR = 0.4
# A gate for each bit, number of orders that know the context, and how often the longest of them saw it.
SEEN_SIZES = 4
GATES = 8 * (len(ORDERS) + 1) * SEEN_SIZES
STEPS = 33  # places of the refinement's table between stretched chances of -8 and 8
CHUNK = 4 << 20
SCORE_CHUNK = 3 << 20
# Slots of the page tables that are worked out at once.
PART_SLOTS = 1 << 20
# Words that every task holds (16 bytes each); the counts of all others are met by a join. So few that also a
# corpus of some tens of MB has more, and that the occurrences of the others grow as the text does.
HELD_WORDS = 1 << 18
SIZE_STEPS = 8  # classes of words by count for each doubling of it
END_WORD = b" "  # no word holds a space
WORD, GRAM = 0, 1
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def word_keys(words) -> np.ndarray:
    """64-bit digests; words are told apart by them."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64).view(np.int64)


def chunks_of(bodies: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together."""
    first, held = 0, 0
    for i, body in enumerate(bodies):
        held += len(body)
        if held >= size:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(bodies):
        yield first, len(bodies)


def windows_of(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of every byte and every end: itself and the SPAN bytes before, as one number; and where each text starts."""
    pad, end = bytes([START]) * SPAN, bytes([END])
    joined = np.frombuffer(pad + b"".join(b + end + pad for b in bodies), np.uint8)
    shifted = joined.astype(np.uint64)
    windows = shifted.copy()
    for back in range(1, SPAN + 1):
        np.left_shift(shifted, np.uint64(8), out=shifted)
        windows[back:] |= shifted[: len(joined) - back]
    del shifted
    sizes = np.array([len(b) + 1 for b in bodies], np.int64)
    starts = np.cumsum(sizes) - sizes
    keep = np.ones(len(joined), bool)
    pads = np.concatenate([[0], SPAN * np.arange(1, len(bodies) + 1) + starts + sizes]).astype(np.int64)
    keep[pads[:, None] + np.arange(SPAN)] = False
    return windows[keep], starts


def _pages(windows: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Pages of an order's context for the next byte's upper half, and for its lower after that."""
    order, bits = ORDERS[at], PAGE_BITS[at]
    context = (windows >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1)
    out = []
    for half in (np.uint64(0), ((windows >> np.uint64(4)) & np.uint64(15)) + np.uint64(1)):
        mixed = (context * np.uint64(32) + half + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((mixed >> np.uint64(64 - bits)).astype(np.int64))
    return out[0], out[1]


def _first_slots() -> np.ndarray:
    return np.cumsum([0, *(16 << b for b in PAGE_BITS)])


class MixModel:
    """Counts of half bytes by page; weights by gate; the refinement's table."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.weights = np.tile(np.array([0.3] * len(ORDERS) + [0.0]), (GATES, 1))
        self.refined: np.ndarray | None = None
        self._nodes = self._stretched = None
        self._in_task = False

    def __getstate__(self):
        # Most slots of a small corpus are empty, and every executor keeps a file of what is sent.
        return self.__dict__ | {"_nodes": None, "_stretched": None, "counts": zlib.compress(self.counts.data, 1)}

    def __setstate__(self, state):
        self.__dict__ = state | {"counts": np.frombuffer(zlib.decompress(state["counts"]), np.int32)}
        self._in_task = True

    def _node_parts(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Of some pages after the other, the nodes of their binary trees: how often 0 and 1 followed."""
        for at in range(0, len(self.counts), PART_SLOTS):
            pages = self.counts[at : at + PART_SLOTS].reshape(-1, 16).astype(np.float32)
            zero, one = np.zeros_like(pages), np.zeros_like(pages)
            for depth in range(4):
                width = 8 >> depth
                for k in range(1 << depth):
                    left = 2 * width * k
                    zero[:, (1 << depth) + k] = pages[:, left : left + width].sum(1)
                    one[:, (1 << depth) + k] = pages[:, left + width : left + 2 * width].sum(1)
            yield slice(at, at + PART_SLOTS), zero.ravel(), one.ravel()

    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every page and every node of its binary tree: how often 0 and 1 followed."""
        if self._nodes is None:
            zero, one = (np.empty(len(self.counts), np.float32) for _ in range(2))
            for part, zeros, ones in self._node_parts():
                zero[part], one[part] = zeros, ones
            self._nodes = zero, one
            if self._in_task:
                self.counts = None  # a task that learns needs no more than the nodes
        return self._nodes

    def stretched(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every node: its stretched chance, and 0 where it was never seen, else one more than its size's class."""
        if self._stretched is None:
            chance, size = np.empty(len(self.counts), np.float32), np.empty(len(self.counts), np.uint8)
            for part, zero, one in self._node_parts():
                chance[part] = np.log((one + PRIOR) / (zero + PRIOR))
                both = zero + one
                classes = np.minimum(np.log2(np.maximum(both, 1)) / 2, SEEN_SIZES - 1).astype(np.uint8)
                size[part] = np.where(both > 0, classes + 1, 0)
            self._stretched = chance, size
            if self._in_task:
                self.counts = None  # a task that scores needs no more than this
        return self._stretched

    @staticmethod
    def _bits(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the 8 bits of each window's byte: the bit, its node in the half byte, the part of the byte before it."""
        symbols = (windows & np.uint64(255)).astype(np.int32)
        shape = (len(windows), 8)
        bits, node = np.empty(shape, np.int32), np.empty(shape, np.int32)
        halves = symbols >> 4, symbols & 15
        for h, half in enumerate(halves):
            for depth in range(4):
                bits[:, 4 * h + depth] = (half >> (3 - depth)) & 1
                node[:, 4 * h + depth] = (1 << depth) + (half >> (4 - depth))
        partial = np.concatenate([node[:, :4], 16 * (1 + halves[0][:, None]) + node[:, 4:]], axis=1) % 272
        return bits, node, partial

    @staticmethod
    def _slots(windows: np.ndarray, node: np.ndarray, k: int, first: int) -> np.ndarray:
        slots = np.empty_like(node)
        for half, pages in enumerate(_pages(windows, k)):
            slots[:, 4 * half : 4 * half + 4] = (pages * 16 + first).astype(np.int32)[:, None]
        slots += node
        return slots

    def values(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mixed stretched chances, bits and parts of bytes, for the 8 bits of each window's byte."""
        chance, sizes = self.stretched()
        bits, node, partial = self._bits(windows)
        first, parts = _first_slots(), []
        seen, size = np.zeros(node.shape, np.uint8), np.zeros(node.shape, np.uint8)
        for k in range(len(ORDERS)):
            slots = self._slots(windows, node, k, int(first[k]))
            parts.append(chance.take(slots, mode="clip"))
            known = sizes.take(slots, mode="clip")
            there = known > 0
            seen += there
            np.copyto(size, known, where=there)
        gates = (np.arange(8, dtype=np.int32) * (len(ORDERS) + 1) + seen) * SEEN_SIZES + (np.maximum(size, 1) - 1)
        weights = self.weights.T.astype(np.float32)
        value = weights[-1].take(gates, mode="clip")
        for part, weight in zip(parts, weights[:-1], strict=True):
            value += part * weight.take(gates, mode="clip")
        return np.clip(value, -7.99, 7.99).ravel(), bits.ravel(), partial.ravel()

    def inputs(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Stretched chances (bit, order), gates, bits and parts of bytes for the 8 bits of each window's byte.

        One occurrence of the window itself is taken out of all counts, so that in training each bit
        is predicted from the others.
        """
        zero, one = self.nodes()
        bits, node, partial = self._bits(windows)
        shape = node.shape
        stretched = np.empty((*shape, len(ORDERS)), np.float32)
        seen, sizes = np.zeros(shape, np.int64), np.zeros(shape, np.float32)
        first = _first_slots()
        for k in range(len(ORDERS)):
            slots = self._slots(windows, node, k, int(first[k]))
            n0, n1 = zero[slots], one[slots]
            n1, n0 = np.maximum(n1 - bits, 0), np.maximum(n0 - (1 - bits), 0)
            stretched[:, :, k] = np.log((n1 + PRIOR) / (n0 + PRIOR))
            both = n0 + n1
            seen += both > 0
            sizes = np.where(both > 0, both, sizes)
        size = np.minimum(np.log2(np.maximum(sizes, 1)) / 2, SEEN_SIZES - 1).astype(np.int64)
        gates = (np.arange(8) * (len(ORDERS) + 1) + seen) * SEEN_SIZES + size
        return stretched.reshape(-1, len(ORDERS)), gates.ravel(), bits.ravel(), partial.ravel()

    def mixed(self, stretched: np.ndarray, gates: np.ndarray) -> np.ndarray:
        w = self.weights[gates]
        return np.clip(np.einsum("nk,nk->n", stretched, w[:, :-1]) + w[:, -1], -7.99, 7.99)

    def train_online(self, windows: np.ndarray, counts: np.ndarray, rate: float, batch: int = 8192, seed: int = 1) -> np.ndarray:
        """One pass of online steps over windows, each weighted by its count; returns each gate's weight."""
        load = np.zeros(GATES)
        for rows in np.array_split(np.random.default_rng(seed).permutation(len(windows)), max(1, len(windows) // batch)):
            stretched, gates, bits, _ = self.inputs(windows[rows])
            x = np.column_stack([stretched, np.ones(len(stretched))])
            weight = np.repeat(counts[rows].astype(np.float64), 8)
            p = 1 / (1 + np.exp(-self.mixed(stretched, gates)))
            slope, curve = weight * (p - bits), weight * p * (1 - p)
            for k in range(x.shape[1]):
                down = np.bincount(gates, slope * x[:, k], GATES)
                bend = np.bincount(gates, curve * x[:, k] ** 2, GATES)
                self.weights[:, k] -= rate * down / (len(ORDERS) * bend + 1.0)
            load += np.bincount(gates, weight, GATES)
        return load

    def _places(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = (value + 8) * ((STEPS - 1) / 16)
        low = np.minimum(place.astype(np.int64), STEPS - 2)
        return low, place - low

    def refinement_sums(self, windows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights and ones by partial byte and place of the mixed chance, shared by the two nearest places."""
        sums = np.zeros((2, 272 * STEPS))
        for at in range(0, len(windows), 20_000):
            part = windows[at : at + 20_000]
            stretched, gates, bits, partial = self.inputs(part)
            low, share = self._places(self.mixed(stretched, gates))
            weight = np.repeat(counts[at : at + 20_000], 8).astype(np.float64)
            for step, portion in ((0, weight * (1 - share)), (1, weight * share)):
                slots = partial * STEPS + low + step
                sums[0] += np.bincount(slots, portion, 272 * STEPS)
                sums[1] += np.bincount(slots, portion * bits, 272 * STEPS)
        return sums

    def set_refinement(self, total: np.ndarray, ones: np.ndarray, strength: float = 20.0) -> None:
        centre = 1 / (1 + np.exp(-np.linspace(-8, 8, STEPS)))
        prior = np.tile(centre, 272)
        self.refined = (ones + strength * prior) / (total + strength)

    def byte_costs(self, windows: np.ndarray) -> np.ndarray:
        """Minus log10 of the chance of each window's byte after the bytes before it."""
        costs = np.empty(len(windows))
        for at in range(0, len(windows), 20_000):
            part = windows[at : at + 20_000]
            value, bits, partial = self.values(part)
            chance = 1 / (1 + np.exp(-value))
            if self.refined is not None:
                low, share = self._places(value)
                slots = partial * STEPS + low
                refined = self.refined[slots] * (1 - share) + self.refined[slots + 1] * share
                chance = (chance + refined) / 2
            chance = np.clip(np.where(bits == 1, chance, 1 - chance), 1e-6, 1)
            costs[at : at + 20_000] = -np.log10(chance).reshape(-1, 8).sum(1)
        return costs


def _lowered(column: pa.Array) -> list[bytes]:
    return [(b or b"").translate(_LOWER) for b in column.cast(pa.binary()).to_pylist()]


def count_corpus(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written counts of all words (word, n) and of all windows (gram, n) of ``docs`` (text).

    One scan gathers both, summed by chunk and by task before they are moved; a word or window that
    every document has is one row a task.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = _lowered(batch.column(0))
            words: Counter = Counter()
            for first, last in chunks_of(bodies, CHUNK):
                part = bodies[first:last]
                for body in part:
                    words.update(body.split())
                grams, counts = np.unique(windows_of(part)[0], return_counts=True)
                yield rows_of(GRAM, grams.view(np.int64), counts)
            words[END_WORD] += len(bodies)
            yield rows_of(WORD, word_keys(words), np.fromiter(words.values(), np.int64))

    def rows_of(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["kind", "key", "n"])

    rows = docs.select("text").mapInArrow(gather, "kind tinyint, key bigint, n bigint")
    with small_batches(docs.sparkSession):
        sums = cut_lineage(rows.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    return (
        sums.where(F.col("kind") == WORD).select(F.col("key").alias("word"), "n"),
        sums.where(F.col("kind") == GRAM).select(F.col("key").alias("gram"), "n"),
    )


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()


def train_mixer(grams: DataFrame) -> MixModel:
    """The model, from the counts of all windows.

    Page counts are sums over all windows. The mixing weights are learned online, in each task on
    its windows, and averaged by what each gate saw, twice; the refinement is sums again. The
    driver gets the model's own numbers: at most a row for each slot of its pages, a bound that
    doesn't depend on the corpus.
    """
    session, first = grams.sparkSession, _first_slots()

    def to_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, counts = _arrays(batch)
            low, high = (windows & np.uint64(15)).astype(np.int64), ((windows >> np.uint64(4)) & np.uint64(15)).astype(np.int64)
            for k in range(len(ORDERS)):
                upper, lower = _pages(windows, k)
                slots = np.concatenate([upper * 16 + high, lower * 16 + low])
                used, place = np.unique(slots, return_inverse=True)
                sums = np.bincount(place, np.concatenate([counts, counts]))
                yield pa.RecordBatch.from_arrays([pa.array(used + first[k], pa.int64()), pa.array(sums.astype(np.int64))], names=["slot", "n"])

    sums = grams.mapInArrow(to_slots, "slot bigint, n bigint").groupBy("slot")
    found = sums.agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n")).select(F.col("slot").cast("int"), "n").toArrow()
    counts = np.zeros(int(first[-1]), np.int32)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    model = MixModel(counts)

    for rate in (1.0, 0.5):
        held = session.sparkContext.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch], held=held, rate=rate) -> Iterator[pa.RecordBatch]:
            held.value.nodes()  # once a worker
            own = MixModel.__new__(MixModel)
            own.__dict__ = held.value.__dict__ | {"weights": held.value.weights.copy()}
            load = np.zeros(GATES)
            for batch in batches:
                load += own.train_online(*_arrays(batch), rate)
            if load.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(GATES)), pa.array(load), *[pa.array(own.weights[:, k] * load) for k in range(len(ORDERS) + 1)]], names=["gate", "load", *[f"w{k}" for k in range(len(ORDERS) + 1)]])

        names = [f"w{k}" for k in range(len(ORDERS) + 1)]
        fields = "gate bigint, load double, " + ", ".join(f"{n} double" for n in names)
        learned = grams.mapInArrow(learn, fields).groupBy("gate").agg(F.sum("load").alias("load"), *[F.sum(n).alias(n) for n in names])
        for row in learned.collect():
            if row["load"] > 0:
                model.weights[row["gate"]] = [row[n] / row["load"] for n in names]
        held.destroy()

    held = session.sparkContext.broadcast(model)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 272 * STEPS))
        for batch in batches:
            sums += held.value.refinement_sums(*_arrays(batch))
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[0][used]), pa.array(sums[1][used])], names=["place", "total", "ones"])

    table = np.zeros((2, 272 * STEPS))
    found = grams.mapInArrow(refine, "place bigint, total double, ones double").groupBy("place")
    for row in found.agg(F.sum("total").alias("total"), F.sum("ones").alias("ones")).collect():
        table[:, row["place"]] = row["total"], row["ones"]
    held.destroy()
    model.set_refinement(*table)
    return model


def score_texts(docs: DataFrame, training: DataFrame) -> DataFrame:
    """Scores every row of ``docs`` (text and any other columns), learning from ``training`` (text).

    Adds n_tokens, n_known, train_tokens, base_score and score; columns of those names are
    replaced. Null text is empty: one token, the end. ``score`` is log10 of the model's probability
    of the lower-cased text's UTF-8 bytes and its end. Rows that repeat are scored each. Without
    training rows every count is 0 and the model is uniform.

    Words are told apart by 64-bit digests. The most frequent ones, HELD_WORDS at most, go to every
    task; the others meet their counts in a join, a row an occurrence, so no key there is frequent
    in training.
    """
    words, grams = count_corpus(training)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    size_class = F.floor(F.log2("n") * SIZE_STEPS)
    sizes = words.groupBy(size_class.alias("size")).agg(F.count("*").alias("v")).collect()
    held, limit = 0, 64 * SIZE_STEPS
    for row in sorted(sizes, key=lambda r: -r["size"]):
        held += row["v"]
        if held > HELD_WORDS:
            break
        limit = row["size"]
    frequent = size_class >= limit
    found = words.where(frequent).toArrow()
    order = np.argsort(found.column("word").to_numpy())
    known = found.column("word").to_numpy()[order], np.log10(found.column("n").to_numpy()[order] + 1.0)
    model = train_mixer(grams)
    context = docs.sparkSession.sparkContext
    shared, table = context.broadcast(model), context.broadcast(known)
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [c for c in docs.columns if c not in added]
    body = docs.select(*[F.col(f"`{c}`") for c in kept])
    given = [c for c in kept if c != "text"]
    names = [*given, "_uid", "n_tokens", "_known", "_base", "score", "_rare"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, (keys, logs) = shared.value, table.value
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            bodies = _lowered(batch.column(batch.schema.get_field_index("text")))
            batch = batch.select(given)
            for first, last in chunks_of(bodies, SCORE_CHUNK):
                part = bodies[first:last]
                windows, starts = windows_of(part)
                codes, distinct = pd.factorize(windows)
                del windows
                scores = -np.add.reduceat(mixer.byte_costs(distinct)[codes], starts)
                del codes, distinct
                split = [[*text.split(), END_WORD] for text in part]
                sizes = np.array([len(w) for w in split], np.int64)
                words_here = word_keys(w for own in split for w in own)
                owner = np.repeat(np.arange(len(part)), sizes)
                place = np.minimum(np.searchsorted(keys, words_here), max(0, len(keys) - 1))
                there = keys[place] == words_here if len(keys) else np.zeros(len(place), bool)
                base = np.bincount(owner[there], logs[place[there]], len(part))
                found = np.bincount(owner[there], minlength=len(part))
                bounds = np.concatenate([[0], np.cumsum(sizes - found)]).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(bounds), pa.array(words_here[~there]))
                uids = uid + np.arange(len(part))
                uid += len(part)
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns, pa.array(uids), pa.array(sizes), pa.array(found.astype(np.int64)), pa.array(base.astype(np.float64)), pa.array(scores), rare], names=names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in body.schema if f.name != "text"]
    fields += ["_uid bigint", "n_tokens bigint", "_known bigint", "_base double", "score double", "_rare array<bigint>"]
    with small_batches(docs.sparkSession, SCORE_CHUNK):
        scored = cut_lineage(body.mapInArrow(score, ", ".join(fields)))
    met = (
        scored.select("_uid", F.explode("_rare").alias("word"))
        .join(words.where(~frequent), "word")
        .groupBy("_uid")
        .agg(F.count("*").alias("_more"), F.sum(F.log10(F.col("n") + 1)).alias("_rest"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    size = math.log10(total["n"] + total["v"] + 1)
    return scored.join(met, "_uid", "left").select(
        *[F.col(f"`{c}`") for c in given],
        "n_tokens",
        (F.col("_known") + zero(F.col("_more"))).alias("n_known"),
        F.lit(total["n"]).cast("bigint").alias("train_tokens"),
        (F.col("_base") + zero(F.col("_rest")) - F.col("n_tokens") * size).alias("base_score"),
        "score",
    )
