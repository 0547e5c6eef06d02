"""URL filter: longest matching rule, found by a cascade of Bloom filters instead of a join."""

from __future__ import annotations

import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lakeqa.scale import cut_lineage

BITS_PER_KEY = 10
# The filters travel inside the plan; a longer list than this allows is refused, not cut.
MAX_FILTER_BYTES = 64 * 1024 * 1024


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and for text without ``://``."""
    mark = F.instr(url, "://")
    rest = F.substring(url, mark + 3, F.length(url))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(raw) + 1, F.length(rest))
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    host = F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)
    there = F.coalesce(mark > 0, F.lit(False))
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every key a rule could have to fit this url, longest first, and of equal length the longest host.

    A key is a suffix of the host at a label's start, with a prefix of the path; only prefixes as
    long as some rule's path can fit.
    """
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    prefixes = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths)]),
        lambda p: p.isNotNull(),
    )
    ranked = lambda h, p: F.struct(
        (-F.length(h) - F.length(p)).alias("shorter"), F.length(p).alias("n"), F.concat(h, p).alias("key")
    )
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: ranked(h, p))))
    return F.transform(F.array_sort(F.array_distinct(keys)), lambda s: s["key"])


class Bloom:
    """One level: ``bits`` positions, seeded by the level's number, held as a binary literal."""

    def __init__(self, keys: DataFrame, level: int, bits_per_key: int = BITS_PER_KEY):
        self.level = level
        self.hashes = max(1, round(bits_per_key * math.log(2)))
        self.size = max(64, -(-keys.count() * bits_per_key // 8) * 8)
        if self.size // 8 > MAX_FILTER_BYTES:
            raise ValueError(f"{self.size // 8} bytes of filter; the bound is {MAX_FILTER_BYTES}")
        places = keys.select(F.explode(F.array(*self._places(F.col("key")))).alias("place"))
        set_bytes = places.groupBy(F.expr("place div 8").alias("at")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("place") % 8).cast("int"))).alias("bits")
        )
        held = bytearray(self.size // 8)
        for row in set_bytes.toLocalIterator():
            held[row["at"]] = row["bits"]
        self.held = F.lit(bytes(held))

    def _places(self, key: Column) -> list[Column]:
        one = F.pmod(F.xxhash64(key, F.lit(2 * self.level)), F.lit(self.size))
        two = F.pmod(F.xxhash64(key, F.lit(2 * self.level + 1)), F.lit(self.size))
        return [(one + i * two) % self.size for i in range(self.hashes)]

    def might_contain(self, key: Column) -> Column:
        def is_set(place: Column) -> Column:
            byte = F.conv(F.hex(F.substring(self.held, (place / 8).cast("int") + 1, F.lit(1))), 16, 10)
            return F.call_function("getbit", byte.cast("int"), (place % 8).cast("int")) == 1

        return reduce(lambda a, b: a & b, map(is_set, self._places(key)))


class Cascade:
    """Exact membership of ``listed`` for every key of ``universe``.

    Level 0 holds the listed keys, level 1 the universe's keys that level 0 takes wrongly, level 2
    the listed keys that level 1 takes wrongly, and so on until a level takes nothing wrongly. Both
    arguments have one column ``key``; nulls are no keys. The universe is never shuffled: only keys
    that pass level 0 are made distinct, on partial sums, so a key that every url has costs one row
    a task.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame, bits_per_key: int = BITS_PER_KEY):
        self.levels: list[Bloom] = []
        inside = cut_lineage(listed.where("key IS NOT NULL").distinct())
        if inside.isEmpty():
            return
        self.levels.append(Bloom(inside, 0, bits_per_key))
        passed = universe.where(self.levels[0].might_contain(F.col("key"))).distinct()
        wrong, other = cut_lineage(passed.join(inside, "key", "left_anti")), inside
        while not wrong.isEmpty():
            level = Bloom(wrong, len(self.levels), bits_per_key)
            self.levels.append(level)
            wrong, other = cut_lineage(other.where(level.might_contain(F.col("key")))), wrong

    def contains(self, key: Column) -> Column:
        """True for listed keys; exact for keys of the universe and for listed ones."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            leaves = F.lit(level.level % 2 == 1)
            answer = F.when(level.might_contain(key), answer).otherwise(leaves)
        return answer


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    unlisted: str = "allow",
    bits_per_key: int = BITS_PER_KEY,
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to ``pages``; columns of those names are replaced.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block). A rule fits its host and all
    subdomains if the url's path starts with the rule's; the longest wins, of equal length that with
    the longer host, and block where both are given for one key. The longest fitting key is the rule itself, so two exact memberships decide:
    is the key a rule, and is that rule a blocking one. Urls without a rule get ``unlisted``, null
    in ``rule``; null urls have empty host and path. Rules with null host or path are left out.
    Repeated rows stay; an empty table or rule list gives what that means.
    """
    parts = url_parts(F.col(f"`{url}`"))
    rules = cut_lineage(
        rules.where("host IS NOT NULL AND path IS NOT NULL").select(
            F.concat("host", "path").alias("key"), F.length("path").alias("n"), "verdict"
        )
    )
    lengths = [row["n"] for row in rules.select("n").distinct().collect()] or [0]
    keyed = pages.select(
        *[F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")],
        parts[0].alias("host"),
        parts[1].alias("path"),
    )
    keys = candidate_keys(F.col("host"), F.col("path"), lengths)
    universe = keyed.select(F.explode(keys).alias("key"))
    is_rule = Cascade(rules.select("key"), universe, bits_per_key)
    blocks = rules.where("verdict = 'block'").select("key")
    is_block = Cascade(blocks, rules.where("verdict <> 'block'").select("key"), bits_per_key)
    judged = keyed.withColumn("rule", F.get(F.filter(keys, is_rule.contains), F.lit(0)))
    verdict = F.when(is_block.contains(F.col("rule")), "block").otherwise("allow")
    return judged.withColumn("verdict", F.when(F.col("rule").isNull(), unlisted).otherwise(verdict))
