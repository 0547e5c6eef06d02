"""N-gram Jaccard join: segments of the shingle universe, one-deletion neighbourhoods, parity sketches, exact checks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakeqa.llm.components import connected
from lakeqa.scale import broadcast_if_small, cut_lineage

WORDS = 3
PERCENT = 90
# Segments whose one-deletion neighbourhoods are indexed; one in how many segments is spare; and the
# chance, for the cost of a lookup, that a document without a common origin has a given shingle.
DELETION_SEGMENTS = 1
SPARE_SHARE = 8
SHARED_CHANCE = 0.3
# Keys of all sets take two to three times the space of the texts while they are dealt; near copies are
# dropped from texts that a pipeline also holds elsewhere, so there a part of the keys is dealt at a time.
KEEP_TURNS = 2
# A task checks at most two blocks of a family against each other.
BLOCK_SHINGLES = 1_000_000
BLOCK_SETS = 1024
# And compares the sketches of two such blocks, so many sets of one with so many of the other at once.
SKETCH_BYTES = 2 << 20
SKETCH_SETS = 8192
SKETCH_TILE = 1 << 20
SLICE_BYTES = 8 << 20

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
INDEX, PROBE, EDGE = 0, 1, 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles_of(body: bytes | None, words: int) -> np.ndarray:
    """Sorted 64-bit digests of the distinct word n-grams; of the whole sequence where it is shorter."""
    from xxhash import xxh3_64_intdigest

    found = body.translate(_LOWER).split() if body else []
    digests = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    if len(found) < words:
        short = np.array([xxh3_64_intdigest(digests.tobytes(), len(found))], np.uint64)
        return short if found else np.empty(0, np.uint64)
    grams = digests[: len(found) - words + 1].copy()
    for k in range(1, words):
        grams = _mix(grams) * _M1 + digests[k : len(found) - words + 1 + k]
    return np.unique(_mix(grams))


def set_digest(shingles: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(shingles.tobytes())


@lru_cache(maxsize=None)
def band_starts(percent: int) -> tuple[int, ...]:
    """Least sizes of the bands: a set links only with sets of its own band and the neighbouring ones."""
    starts = [1]
    while starts[-1] < 1 << 40:
        # Never narrower than for 90 %: bands have eight bits, and wider ones are right as well.
        starts.append(-(-starts[-1] * 100 // min(percent, 90)))
    return tuple(starts)


def band_of(size, percent: int):
    return np.searchsorted(band_starts(percent), size, side="right") - 1


@lru_cache(maxsize=None)
def differences(band: int, percent: int) -> int:
    """The most shingles in which two linked sets differ if the larger is in this band."""
    largest = band_starts(percent)[band + 1] - 1
    return (100 - percent) * 2 * largest // (100 + percent)


@lru_cache(maxsize=None)
def sketch_bits(band: int, percent: int) -> int:
    """Bits of a sketch in this band: a power of two, four times the differences or more.

    Sets without a common origin differ in nearly half of so many, which is more than linked sets may.
    """
    return max(64, 1 << max(0, 4 * differences(band, percent) - 1).bit_length())


def sketch_of(shingles: np.ndarray, percent: int) -> bytes:
    """Whether the number of shingles is odd in each of a power of two of buckets.

    Two sets differ by a shingle at least for each bucket in which their sketches do. A sketch folds to
    half its bits; it has those of the band above its own, the wider of the two where it is compared.
    """
    if not len(shingles):
        return b""
    bits = sketch_bits(int(band_of(len(shingles), percent)) + 1, percent)
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def spare_segments(most: int) -> int:
    """Segments beyond one more than the differences: so many may each set give up."""
    return 1 + (most + 1) // SPARE_SHARE


def allocation(sizes: np.ndarray, deletable: int, spare: int) -> np.ndarray:
    """Threshold of each segment for a probe; with one added to each they sum to one more than the differences.

    The ``spare`` segments that most sets share by chance (those with the fewest shingles) are given
    up, -1; the others are looked up exactly, 0. Of these, one more is given up for each segment that
    can take one deletion, 1, at less cost; the sum stays, and with it the pigeonhole. Costs are
    chances of meeting a set without a common origin, over all the lookups.
    """
    thresholds = np.zeros(len(sizes), np.int64)
    exact = SHARED_CHANCE ** sizes.astype(float)
    thresholds[np.argsort(sizes, kind="stable")[:spare]] = -1
    exact[thresholds < 0] = 0
    wide = sorted((i for i in range(deletable) if not thresholds[i]), key=lambda i: -sizes[i])
    for i in np.argsort(-exact, kind="stable").tolist():
        if not wide:
            break
        j = wide[0]
        wider = (sizes[j] + 1) * SHARED_CHANCE ** max(0.0, float(sizes[j]) - 1)
        if i == j or thresholds[i] or exact[i] <= wider:
            break
        thresholds[i], thresholds[j] = -1, 1
        wide.pop(0)
    return thresholds


def keys_of(shingles: np.ndarray, percent: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(band, keys, roles): what a set is indexed under and probes, in its band and in the next.

    Pairs are found in the band of the larger set, where the smaller may come from the band below;
    so sets probe in their own band, and are indexed in it and the next.
    """
    own, out = int(band_of(len(shingles), percent)), []
    for band in (own, own + 1):
        most = differences(band, percent)
        if most == 0:
            continue  # linked sets are equal here
        spare = spare_segments(most)
        parts = most + 1 + spare
        segment = ((_mix(shingles * _M1) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        weights = _mix(shingles[order] + _M3)
        bounds = np.searchsorted(segment[order], np.arange(parts + 1))
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weights, dtype=np.uint64)])
        content = running[bounds[1:]] - running[bounds[:-1]]
        base = (np.arange(parts, dtype=np.uint64) * np.uint64(2) + np.uint64(band << 32)) * _M1
        key = lambda s, at, other=0: _mix(s + base[at] + np.uint64(other) * _M2)
        deletable = min(DELETION_SEGMENTS, parts)
        exact, everywhere = key(content, slice(None)), np.arange(parts)
        keys, roles = [exact], [np.full(parts, INDEX)]
        thresholds = allocation(np.diff(bounds), deletable, spare) if band == own else None
        if thresholds is not None:
            roles[0] = np.where(thresholds[everywhere] >= 0, PROBE, INDEX)
        for j in range(deletable):
            without = content[j] - weights[bounds[j] : bounds[j + 1]]
            keys.append(key(without, j, 1))
            roles.append(np.full(len(without), INDEX))
            if thresholds is not None and thresholds[j] > 0:
                keys += [key(content[j : j + 1], j, 1), key(without, j)]
                roles += [np.full(1, PROBE), np.full(len(without), PROBE)]
        out.append((band, np.concatenate(keys), np.concatenate(roles).astype(np.int8)))
    return out


def _bodies(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes, or of one row that is larger."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def document_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Written: doc_id, n (size of the set), digest and sketch of the set, for every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles_of(b, words) for b in _bodies(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([sketch_of(s, percent) for s in sets], pa.binary())], names=["doc_id", "n", "digest", "sketch"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return cut_lineage(rows.mapInArrow(measure, "doc_id bigint, n bigint, digest binary, sketch binary"))


# A vertex is 54 bits of a set's digest, then 8 of the band and 2 of the role: two numbers a row are
# all that is dealt. Equal bits of different sets only add candidates.
_ROLE, _BAND = 3, 255 << 2


def _vertex(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True) & ~1023


def candidate_edges(docs: DataFrame, words: int, percent: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """(band, a, b): of all sets that meet under a key which one of them probes, a star.

    All keys take ``turns`` calls, each of which deals the keys of its ``turn``.

    Each task first
    joins the sets of a slice of its own that meet, and passes one of them on for each key, so a key
    that very many sets have is a row a slice when rows are dealt by key; keys are then read as
    sorted runs, of which only the first set is held.
    """
    def batch_of(key: np.ndarray, vertex: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(vertex)], names=["key", "vertex"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen: set[bytes] = set()
            keys, vertices = [], []
            for body in _bodies(batch.column(0)):
                shingles = shingles_of(body, words)
                if not len(shingles) or (digest := set_digest(shingles)) in seen:
                    continue
                seen.add(digest)
                for band, own, role in keys_of(shingles, percent):
                    keys.append(own)
                    vertices.append(_vertex(digest) + (band << 2) + role.astype(np.int64))
            if not keys:
                continue
            key, vertex = np.concatenate(keys), np.concatenate(vertices)
            del keys, vertices
            if turns > 1:
                mine = key % np.uint64(turns) == turn
                key, vertex = key[mine], vertex[mine]
            key = key.view(np.int64)
            if not len(key):
                continue
            order = np.lexsort((-(vertex & _ROLE), key))
            key, vertex = key[order], vertex[order]
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
            met = ~fresh & (vertex[head] & _ROLE == PROBE)
            linked = met & (vertex[head] | _ROLE != vertex | _ROLE)
            if linked.any():
                star = np.unique(np.stack([vertex[head][linked] | _ROLE, vertex[linked] & ~_ROLE | EDGE], 1), axis=0)
                yield batch_of(star[:, 0], star[:, 1])
            rest = np.flatnonzero(~met)
            for at in range(0, len(rest), 200_000):
                yield batch_of(key[rest[at : at + 200_000]], vertex[rest[at : at + 200_000]])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, lead, probed = None, 0, False
        for batch in batches:
            key, vertex = (c.to_numpy() for c in batch.columns)
            done = vertex & _ROLE == EDGE
            out = [np.stack([key[done], vertex[done]], 1)]
            key, vertex = key[~done], vertex[~done]
            if len(key):
                fresh = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
                head = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), -1))
                first = np.where(head >= 0, vertex[head], lead)
                ask = np.where(head >= 0, vertex[head] & _ROLE == PROBE, probed)
                linked = ~fresh & ask & (first | _ROLE != vertex | _ROLE)
                out.append(np.stack([first[linked], vertex[linked]], 1))
                last_key, lead, probed = key[-1], int(first[-1]), bool(ask[-1])
            rows = np.unique(np.concatenate(out) & ~_ROLE, axis=0)
            if len(rows):
                band = ((rows[:, 1] & _BAND) >> 2).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(rows[:, 0] & ~1023), pa.array(rows[:, 1] & ~1023)], names=["band", "a", "b"])

    rows = docs.select("text").mapInArrow(emit, "key bigint, vertex bigint")
    probes_first = F.col("vertex").bitwiseAND(F.lit(_ROLE)).desc()
    dealt = rows.repartition("key").sortWithinPartitions("key", probes_first, "vertex")
    return dealt.mapInArrow(meet, "band int, a bigint, b bigint")


def _hooked(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label``, the first of each group, once the groups of every ``a`` and its ``b`` are one."""
    while True:
        a, b = label[a], label[b]
        apart = a != b
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def near_sets(members: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A star for all sets of one family, or of two blocks of it, that sketches of pairs connect.

    ``members``: band, block, across (two blocks, not one), digest, n, sketch. Linked sets differ by no more shingles than their
    sizes allow, so neither in more bits: all that link are connected, and few others.
    """
    members = members.sort_values(["n", "digest"], ignore_index=True)
    size, n, band = len(members), members["n"].to_numpy(), int(members["band"].iloc[0])
    words = sketch_bits(band, percent) // 64
    sketches = np.empty((words, size), np.uint64)
    for at, sketch in enumerate(members["sketch"]):
        sketches[:, at] = np.bitwise_xor.reduce(np.frombuffer(sketch, "<u8").reshape(-1, words), axis=0)
    # Of sets that are both from the band below, those of that band are told.
    own = band_of(n, percent) == band
    across = bool(members["across"].iloc[0])
    first = members["block"].to_numpy() == members["block"].min()
    rows, others = (np.flatnonzero(first), np.flatnonzero(~first)) if across else (np.arange(size),) * 2
    sizes, label = n[others], np.arange(size)
    step = max(1, SKETCH_TILE // max(1, len(others)))
    for at in range(0, len(rows), step):
        tile = rows[at : at + step]
        # The smaller set has this share of the larger one at least.
        least = np.searchsorted(sizes, -(-n[tile[0]] * percent // 100)) if across else at
        against = others[least : np.searchsorted(sizes, n[tile[-1]] * 100 // percent, "right")]
        if not len(against):
            continue
        most = (100 - percent) * (n[tile[-1]] + n[against[-1]]) // (100 + percent)
        differ = np.zeros((len(tile), len(against)), np.uint16 if words < 1024 else np.int32)
        if not across:
            np.fill_diagonal(differ, most + 1)  # a set and itself
        for word in sketches:
            differ += np.bitwise_count(word[tile, None] ^ word[None, against])
            if differ.min() > most:
                break
        a, b = np.nonzero(differ <= most)
        differ, a, b = differ[a, b].astype(np.int64), tile[a], against[b]
        near = (differ * (100 + percent) <= (100 - percent) * (n[a] + n[b])) & (own[a] | own[b])
        label = _hooked(label, a[near], b[near])
    digests, some = members["digest"].to_numpy(), label != np.arange(size)
    return pd.DataFrame({"band": np.full(some.sum(), band, np.int32), "a": digests[some], "b": digests[label[some]]})


def check_pairs(members: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links among the sets of one family, or between two blocks of it: exact, from whole sets.

    ``members``: band, block, across (two blocks, not one), digest, n, copies, shingles. A row for each set with links: one set of
    what it is connected to here, and its number of linked documents.
    """
    members = members.drop_duplicates(["digest", "block"]).sort_values(["block", "digest"], ignore_index=True)
    sets = [np.frombuffer(s, np.uint64) for s in members["shingles"]]
    size, n = len(sets), members["n"].to_numpy()
    owner = np.repeat(np.arange(size, dtype=np.int32), n)
    terms = np.concatenate(sets)
    del sets
    order = np.argsort(terms, kind="stable")
    terms, owner = terms[order], owner[order]
    del order
    # Runs of equal shingles are the columns; those of one set alone are in no intersection.
    fresh = np.concatenate([[True], terms[1:] != terms[:-1]])
    starts = np.flatnonzero(fresh)
    runs = np.diff(np.append(starts, len(terms)))
    kept = np.repeat(runs > 1, runs)
    shared = np.flatnonzero(runs > 1)
    place = np.repeat(np.arange(len(shared), dtype=np.int32), runs[shared])
    owner = owner[kept]
    del terms, fresh, kept
    common = np.zeros((size, size), np.float32)
    step = 2048
    for at in range(0, len(shared), step):
        a, b = np.searchsorted(place, [at, at + step])
        dense = np.zeros((size, min(step, len(shared) - at)), np.float32)
        dense[owner[a:b], place[a:b] - at] = 1
        common += dense @ dense.T
    linked, own_band = np.zeros((size, size), bool), band_of(n, percent)
    for at in range(0, size, 256):
        rows = slice(at, at + 256)
        enough = common[rows].astype(np.int64) * (100 + percent) >= percent * (n[rows, None] + n[None, :])
        # The band of the larger set is the larger of the bands.
        linked[rows] = enough & (np.maximum(own_band[rows, None], own_band[None, :]) == int(members["band"].iloc[0]))
    del common
    np.fill_diagonal(linked, False)
    if members["across"].iloc[0]:
        block = members["block"].to_numpy()
        linked &= block[:, None] != block[None, :]
    copies = members["copies"].to_numpy()
    links = np.array([int(copies[row].sum()) for row in linked])
    label = np.arange(size)
    while True:
        near = np.array([min(own, label[row].min(initial=size)) for own, row in zip(label, linked, strict=True)])
        near = near[near]
        if (near == label).all():
            break
        label = near
    some = links > 0
    digests = members["digest"].to_numpy()
    return pd.DataFrame({"a": digests[some], "b": digests[label[some]], "links": links[some].astype(np.int64)})


def link_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of ``docs`` (doc_id, text).

    Two documents link when ``percent`` % of the union of their shingle sets is common to both;
    ``component_id`` is the smallest doc_id that links lead to, the own included, and ``n_links`` the
    number of rows linked with. Null, empty and blank texts have no shingles and no links. Rows that
    repeat a doc_id are documents each; null ids are larger than any. Other columns are not looked at.

    Documents with equal sets are one class with a count. Classes that share a segment of the
    shingle universe, or one but for a deletion, come into one family for each band of sizes.
    A line that many documents have makes a family of them; sketches of pairs cut families down to
    sets that may link, and those are checked exactly. Both go block against block in large families.
    """
    return _linked(docs, words, percent).drop("digest")


def _linked(docs: DataFrame, words: int, percent: int, turns: int = 1) -> DataFrame:
    """What ``link_documents`` gives, and the digest of each row's set; keys are dealt in ``turns``."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sets = document_sets(docs, words, percent)
    classes = cut_lineage(
        sets.where("n > 0")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("head"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    )
    edges = reduce(
        DataFrame.unionByName, [cut_lineage(candidate_edges(docs, words, percent, turn, turns).distinct()) for turn in range(turns)]
    )
    node = lambda c: F.xxhash64("band", c)
    nodes = edges.select("band", F.explode(F.array("a", "b")).alias("vertex")).distinct()
    labels = connected(edges.select(node("a").alias("a"), node("b").alias("b")))
    nodes = nodes.withColumn("node", node("vertex")).join(labels, "node").select("band", "vertex", F.col("label").alias("family"))
    members = cut_lineage(
        nodes.join(classes.withColumn("vertex", _half_digest("digest")), "vertex").select("band", "family", "digest", "head", "copies", "n", "sketch")
    )

    def compare(lot: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([near_sets(family, percent) for _, family in lot.groupby(["band", "family"], sort=True)], ignore_index=True)

    sketched = _dealt(members, F.octet_length("sketch"), SKETCH_BYTES, SKETCH_SETS).select("band", "family", "block", "across", "digest", "n", "sketch", "lot")
    near = cut_lineage(sketched.groupBy("lot").applyInPandas(compare, "band int, a binary, b binary"))
    labels = connected(near.select(node("a").alias("a"), node("b").alias("b")))
    members = cut_lineage(
        members.withColumn("node", node("digest"))
        .join(labels, "node")
        .select("band", F.col("label").alias("family"), "digest", "head", "copies", "n")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles_of(b, words) for b in _bodies(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["digest", "shingles"])

    # Ids, not texts, move as long as the ids are measured to be few.
    wanted = broadcast_if_small(members.select(F.col("head").alias("id")).distinct())
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["id"]), "left_semi").select("text")
    whole = texts.mapInArrow(read, "digest binary, shingles binary")
    work = _dealt(members, F.col("n"), BLOCK_SHINGLES, BLOCK_SETS).select("band", "family", "block", "across", "digest", "copies", "n", "lot")
    work = work.join(whole, "digest")

    def check(lot: pd.DataFrame) -> pd.DataFrame:
        found = [check_pairs(family, percent) for _, family in lot.groupby(["band", "family"], sort=True)]
        return pd.concat(found, ignore_index=True)

    found = cut_lineage(work.groupBy("lot").applyInPandas(check, "a binary, b binary, links bigint"))
    joined = connected(found.select("a", "b").where("a <> b"))
    heads = joined.join(classes, joined["node"] == classes["digest"]).groupBy("label").agg(F.min("head").alias("component"))
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    told = (
        joined.join(heads, "label")
        .join(counts, joined["node"] == counts["a"], "left")
        .select(F.col("node").alias("digest"), "component", "links")
    )
    classes = cut_lineage(classes.join(told, "digest", "left").select("digest", "head", "copies", "component", "links"))
    out = sets.join(classes, "digest", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        "doc_id",
        "digest",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "head")).alias("component_id"),
        F.when(F.col("n") == 0, zero).otherwise(F.col("copies") - 1 + F.coalesce("links", zero)).alias("n_links"),
    )


def _dealt(members: DataFrame, load: Column, most: int, most_sets: int) -> DataFrame:
    """``members`` (band, family, digest) with block, across and lot: what one task gets has one lot.

    Families of more than ``most_sets`` sets, or ``most`` of ``load``, are cut into blocks.
    """
    loads = members.groupBy("band", "family").agg(F.sum(load).alias("load"), F.count("*").alias("sets"))
    blocks = F.greatest(F.ceil(F.col("load") / most), F.ceil(F.col("sets") / most_sets)).cast("int")
    loads = loads.withColumn("blocks", blocks)
    small = loads.where("blocks = 1").agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0]
    lots = max(1, -(-small // (most // 2)))
    members = members.join(loads.select("band", "family", "blocks"), ["band", "family"])
    members = members.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    # A set goes to each pair of blocks that its block is in; small families share lots.
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = [F.least("block", "other"), F.greatest("block", "other")]
    lot = F.when(F.col("blocks") == 1, F.concat(F.lit("lot "), F.pmod(F.xxhash64("band", "family"), F.lit(lots)))).otherwise(
        F.concat_ws(" ", "band", "family", *pair)
    )
    return members.withColumns({"across": F.col("block") != F.col("other"), "lot": lot})


def _half_digest(column: str):
    """The bits of a digest that a vertex has: of its first eight bytes, little end first."""
    bytes_of = [F.hex(F.substring(column, i, 1)) for i in range(8, 0, -1)]
    return F.conv(F.concat(*bytes_of), 16, -10).cast("bigint").bitwiseAND(F.lit(~1023))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near copies: of each component the document with the smallest doc_id stays.

    Rows that repeat an id and a text are copies, and one stays; documents without an id or without
    words stay. Rows that repeat an id with different texts are documents each: those go whose own
    text is in a component with a smaller id, the others stay. Columns are those of ``docs``.
    """
    found = cut_lineage(_linked(docs, words, percent, KEEP_TURNS))
    found = found.where("doc_id IS NOT NULL AND n_shingles > 0")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("count"))
    repeated = cut_lineage(ids.where("count > 1").select("doc_id"))
    gone = found.where("component_id < doc_id")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if repeated.isEmpty():
        gone = broadcast_if_small(cut_lineage(gone.select("doc_id")))
        return docs.join(gone, "doc_id", "left_anti").select(*columns)
    few = broadcast_if_small(repeated)
    single = broadcast_if_small(cut_lineage(gone.join(few, "doc_id", "left_anti").select("doc_id")))
    kept = docs.join(few, "doc_id", "left_anti").join(single, "doc_id", "left_anti").select(*columns)
    # Only rows of repeated ids need their sets' digests.
    gone = broadcast_if_small(cut_lineage(gone.join(few, "doc_id").select("doc_id", F.col("digest").alias("_set")).distinct()))
    again = docs.join(few, "doc_id", "left_semi").select(*columns)
    names = [*docs.columns, "_set"]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [set_digest(shingles_of(b, words)) for b in _bodies(batch.column(batch.schema.get_field_index("text")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=names)

    again = again.mapInArrow(digests, T.StructType([*docs.schema, T.StructField("_set", T.BinaryType())]))
    again = again.join(gone, ["doc_id", "_set"], "left_anti").drop("_set").withColumn("_same", F.sha2("text", 256))
    return kept.unionByName(again.dropDuplicates(["doc_id", "_same"]).drop("_same").select(*columns))
