"""Divergence of sources within a language: exact vocabulary, then a recount through minimal perfect hashes."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from lakeqa.scale import broadcast_if_small, cut_lineage

LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
# Terms of a hash, at most about; fewer where a language has many sources, so a unit holds about as many counts.
UNIT_TERMS = 1 << 14
UNIT_COUNTS = 1 << 20
# Hashes sent to the executors at once; a larger vocabulary is counted in several passes.
HASH_BYTES = 64 << 20
HELD_TERMS = 500_000
DENSE_BYTES = 128 << 20
# A to Z become a to z, other ASCII a blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_LETTERS).split()


def _digests(keys: list[bytes]) -> np.ndarray:
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.uint64).reshape(-1, 2)


class PerfectHash:
    """A minimal perfect hash of a set of byte strings, with the strings themselves in slot order.

    Each level is a bit array of twice as many bits as keys reach it; a key stays at the first level
    where its position is its own, and its slot is the number of set bits before it. What no level
    places (chance of 128 equal bits) follows at the end and is searched for. The key stored at a slot
    tells whether a string is of the set.
    """

    LEVELS = 40

    def __init__(self, sizes: list[int], bits: np.ndarray, keys: pa.Array):
        self.sizes, self.bits, self.keys = sizes, bits, keys
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits))]).astype(np.int64)
        self.rest = {k.as_py(): self.before[-1] + i for i, k in enumerate(keys[int(self.before[-1]) :])}

    @staticmethod
    def _positions(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = digests[:, 0] + digests[:, 1] * np.uint64(2 * level + 1)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        return (mixed % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: list[bytes]) -> PerfectHash:
        """``keys`` are distinct."""
        digests, left, sizes, parts, placed = _digests(keys), np.arange(len(keys)), [], [], []
        while len(left) and len(sizes) < cls.LEVELS:
            size = -(-2 * len(left) // 64) * 64
            at = cls._positions(digests[left], len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            taken = np.zeros(size, np.uint8)
            taken[at[alone]] = 1
            placed.append(left[alone][np.argsort(at[alone])])
            parts.append(np.packbits(taken, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone]
        order = np.concatenate([*placed, left]) if len(keys) else []
        bits = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        return cls(sizes, bits, pa.array([keys[i] for i in order], pa.binary()))

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, words: list[bytes]) -> np.ndarray:
        """The slot of each word, -1 for words outside the set."""
        found = np.full(len(words), -1, np.int64)
        digests, left = _digests(words), np.arange(len(words))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self.starts[level] + self._positions(digests[left], level, size)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            held = self.bits[word]
            is_set = (held >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1)))
            found[left[is_set]] = (self.before[word] + below)[is_set]
            left = left[~is_set]
        for i in left.tolist() if self.rest else ():
            found[i] = self.rest.get(words[i], -1)
        if len(self):
            stored = self.keys.take(pa.array(np.maximum(found, 0)))
            found[~pc.equal(stored, pa.array(words, pa.binary())).to_numpy(zero_copy_only=False)] = -1
        return found

    def to_bytes(self) -> bytes:
        table = pa.table(
            {"sizes": [self.sizes], "bits": [self.bits.tobytes()], "keys": pa.array([self.keys.to_pylist()], pa.list_(pa.binary()))}
        )
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        row = pa.ipc.open_stream(raw).read_all()
        bits = np.frombuffer(row["bits"][0].as_py(), np.uint64)
        return cls(row["sizes"][0].as_py() or [], bits, row["keys"].chunk(0).flatten())


def _emitted(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def vocabulary(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term) of all terms that at least ``least`` rows of their language have; exact, written once.

    Tasks count the rows of each term before anything moves, so a term that all rows have is a few
    rows a task.
    """
    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def flush():
            for lang, terms in held.items():
                keys, counts = list(terms), list(terms.values())
                for at in range(0, len(keys), 50_000):
                    part = keys[at : at + 50_000]
                    yield _emitted(schema, [lang] * len(part), part, counts[at : at + 50_000])
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held[lang].update(set(terms_of(text)))
                if sum(map(len, held.values())) > HELD_TERMS:
                    yield from flush()
        yield from flush()

    counted = docs.select("text", "lang").mapInArrow(count, "lang string, term binary, n bigint")
    return cut_lineage(counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term"))


def build_hashes(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, shard, shards, hash): the terms of each language in perfect hashes of bounded size, written once.

    A term's shard is its crc32 modulo the ``shards`` of its language.
    """
    schema = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("shards", pa.int64()), ("hash", pa.binary())])
    least = F.lit(64).cast("bigint")
    wide = F.greatest(least, F.least(F.lit(UNIT_TERMS), F.floor(F.lit(UNIT_COUNTS) / F.col("sources"))))
    shares = (
        kept.groupBy("lang").agg(F.count("*").alias("terms"))
        .join(groups.groupBy("lang").agg(F.count("*").alias("sources")), "lang")
        .select("lang", F.ceil(F.col("terms") / wide).cast("bigint").alias("shards"))
    )
    dealt = kept.join(broadcast_if_small(shares), "lang").withColumn("shard", (F.crc32("term") % F.col("shards")).cast("int"))

    def build(unit: pa.Table) -> pa.Table:
        made = PerfectHash.build(unit["term"].to_pylist())
        first = [unit[c][0].as_py() for c in ("lang", "shard", "shards")]
        return pa.Table.from_batches([_emitted(schema, *([v] for v in (*first, made.to_bytes())))])

    return cut_lineage(dealt.groupBy("lang", "shard").applyInArrow(build, "lang string, shard int, shards bigint, hash binary"))


def _passes(hashes: DataFrame, hash_bytes: int) -> list[list[tuple[str, int]]]:
    """Shards by pass, each of at most ``hash_bytes`` (or one shard); names only, one for some thousand terms."""
    passes, held = [[]], 0
    for row in hashes.select("lang", "shard", F.octet_length("hash").alias("size")).orderBy("lang", "shard").toLocalIterator():
        if held and held + row["size"] > hash_bytes:
            passes.append([])
            held = 0
        passes[-1].append((row["lang"], row["shard"]))
        held += row["size"]
    return passes


def recount(docs: DataFrame, hashes: DataFrame, hash_bytes: int = HASH_BYTES) -> DataFrame:
    """(lang, source, shard, slot, n): occurrences of each kept term in each group that has it, written.

    The hashes are broadcast, at most ``hash_bytes`` at once; a larger vocabulary takes a pass over the
    corpus for each such part. Tasks add to dense arrays, one for a group and shard, and let their
    non-zero slots go when all arrays pass ``DENSE_BYTES`` and at the end.
    """
    spark = docs.sparkSession
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("shard", pa.int32()), ("slot", pa.int32()), ("n", pa.int64())])
    done = None
    for names in _passes(hashes, hash_bytes):
        wanted = spark.createDataFrame(names, "lang string, shard int")
        rows = hashes.join(F.broadcast(wanted), ["lang", "shard"]).collect()
        sent = spark.sparkContext.broadcast((
            {r["lang"]: r["shards"] for r in rows}, {(r["lang"], r["shard"]): bytes(r["hash"]) for r in rows}
        ))
        del rows

        def add(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            shards, packed = sent.value
            opened: dict[tuple[str, int], PerfectHash] = {}
            dense: dict[tuple[str, str, int], np.ndarray] = {}
            held: dict[tuple[str, str], Counter] = defaultdict(Counter)

            def resolve() -> None:
                for (lang, source), terms in held.items():
                    by_shard = defaultdict(list)
                    for term in terms:
                        by_shard[zlib.crc32(term) % shards[lang]].append(term)
                    for shard, words in by_shard.items():
                        key = (lang, shard)
                        if key not in packed:
                            continue
                        if key not in opened:
                            opened[key] = PerfectHash.from_bytes(packed[key])
                        slots = opened[key].slots(words)
                        counts = np.fromiter((terms[w] for w in words), np.int64, len(words))
                        at = (lang, source, shard)
                        if at not in dense:
                            dense[at] = np.zeros(len(opened[key]), np.int64)
                        dense[at][slots[slots >= 0]] += counts[slots >= 0]
                held.clear()

            def flush() -> Iterator[pa.RecordBatch]:
                for (lang, source, shard), counts in dense.items():
                    slots = np.flatnonzero(counts).astype(np.int32)
                    size = len(slots)
                    if size:
                        yield _emitted(schema, [lang] * size, [source] * size, np.full(size, shard, np.int32), slots, counts[slots])
                dense.clear()

            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    for text, lang, source in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        if lang in shards:
                            held[lang, source].update(terms_of(text))
                    if sum(map(len, held.values())) > HELD_TERMS:
                        resolve()
                    if sum(a.nbytes for a in dense.values()) > DENSE_BYTES:
                        yield from flush()
            resolve()
            yield from flush()

        fields = "lang string, source string, shard int, slot int, n bigint"
        counted = docs.select("text", "lang", "source").mapInArrow(add, fields)
        part = cut_lineage(counted.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n")))
        sent.destroy()
        done = part if done is None else done.unionByName(part)
    return done


def scaled_shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / total), digit by digit, so that nothing overflows below 9e15."""
    rest, result = counts + 1, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        result = result * 1000 + digit
        rest -= digit * total
    return 1 + result


def _gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _unit(counts: pa.Table, unit: pa.Table, schema: pa.Schema, top: int) -> pa.Table:
    """Partial sums of all pairs of sources, and the best terms of each source, of one shard of a language."""
    if not unit.num_rows:
        return schema.empty_table()
    lang = unit["lang"][0].as_py()
    keys = PerfectHash.from_bytes(unit["hash"][0].as_py()).keys
    sources = [s["source"] for s in unit["groups"][0].as_py()]
    totals = np.array([s["total"] for s in unit["groups"][0].as_py()], np.int64)
    dense = np.zeros((len(sources), len(keys)), np.int64)
    number = pc.index_in(counts["source"], pa.array(sources, pa.string())).to_numpy()
    dense[number, counts["slot"].to_numpy()] = counts["n"].to_numpy()
    terms = unit["terms"][0].as_py()
    shares = scaled_shares(dense, (totals + terms)[:, None])
    # Terms of other shards and sources are in the language's total only.
    of_lang = scaled_shares(dense.sum(axis=0), totals.sum() + terms)
    out: list[pa.RecordBatch] = []

    def put(source: str, part: str, items: list, values: np.ndarray) -> None:
        size = len(items)
        out.append(_emitted(schema, [lang] * size, [source] * size, [part] * size, items, values))

    for g, source in enumerate(sources):
        sums = _gain(shares[g], shares).sum(axis=1)
        others = [s for s in range(len(sources)) if s != g]
        put(source, "pair", [sources[s] for s in others], sums[others])
        more = np.flatnonzero((dense[g] > 0) & (shares[g] > of_lang))
        gains = _gain(shares[g][more], of_lang[more])
        if len(more) > top:
            least = np.partition(gains, -top)[-top]
            more, gains = more[gains >= least], gains[gains >= least]
        items = keys.take(pa.array(more)).to_pylist()
        best = sorted(range(len(items)), key=lambda i: (-int(gains[i]), items[i]))[:top]
        put(source, "term", [items[i].decode("utf-8", "replace") for i in best], gains[best])
    return pa.Table.from_batches(out, schema)


def audit_sources(
    docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, hash_bytes: int = HASH_BYTES
) -> DataFrame:
    """How far each source of ``docs`` (text, lang, source) is from the others of its language, and by which terms.

    Terms are runs of ASCII letters (as small ones) and characters beyond ASCII; a language keeps
    those that at least ``least`` of its rows have. A kept term's share in a group is
    1 + floor(10^9 (count + 1) / (N + V)), with N the group's occurrences of kept terms and V their
    number; the gain of p over q is floor((p - q)^2 / q). Returns lang, source, part, item, value, rank:
    for ``pair`` each other source of the language with the gains over it summed over all kept
    terms (0 where nothing is kept), for ``term`` the ``top`` terms with the largest gains over the
    whole language, of those that the group has and uses more than it. Ranks order by value, then
    item as UTF-8.

    Null text, lang and source are empty ones; repeated rows count each, ties of values are settled
    by the item; a text of any length is one row; other columns are not looked at; an empty table
    gives no row.

    A language's terms are split into shards, so one that has most rows is many tasks; each task
    holds about UNIT_COUNTS counts, as long as a language has fewer than 16,384 sources (its pairs alone
    are then 2.7e8 rows).
    """
    null_free = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(*map(null_free, ("text", "lang", "source")))
    groups = cut_lineage(rows.select("lang", "source").distinct())
    kept = vocabulary(rows, least)
    hashes = build_hashes(kept, groups)
    pairs = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    counts = recount(rows, hashes, hash_bytes)
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    listed = (
        groups.join(totals, ["lang", "source"], "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).cast("bigint").alias("total"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("groups"))
        .join(sizes, "lang")
    )
    units = hashes.join(broadcast_if_small(cut_lineage(listed)), "lang").select("lang", "shard", "hash", "groups", "terms")
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    found = cut_lineage(
        counts.groupBy("lang", "shard")
        .cogroup(units.groupBy("lang", "shard"))
        .applyInArrow(
            lambda left, right: _unit(left, right, schema, top),
            "lang string, source string, part string, item string, value bigint",
        )
    )
    summed = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    all_pairs = pairs.join(summed, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("bigint").alias("value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order).alias("rank")
    best = found.where("part = 'term'").select("*", rank).where(F.col("rank") <= top)
    return all_pairs.select("*", rank).unionByName(best)
