"""Rows of a large relation by a set of ids: pruned where they are read, then checked exactly."""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lakeqa.scale import BROADCAST_BYTES, fits_broadcast

BITS_PER_ID = 16
# Small filters would share too many places.
LEAST_FILTER_BYTES = 1 << 13
# The filter goes into the plan of every task; more ids than fit well only let more rows through.
MAX_FILTER_BYTES = 16 * 1024 * 1024


class IdFilter:
    """A Bloom filter of the distinct values of a column, summed up byte by byte in the tasks.

    Tasks add their own bits before anything moves, so what comes to the driver is the filter
    itself: at most MAX_FILTER_BYTES, however many ids there are.
    """

    def __init__(self, ids: DataFrame, column: str, max_bytes: int = MAX_FILTER_BYTES):
        count = ids.select(F.approx_count_distinct(column, 0.02)).first()[0]
        self.num_bits = 8 * min(max_bytes, max(LEAST_FILTER_BYTES, math.ceil(count * BITS_PER_ID / 8)))
        self.num_hashes = max(1, min(11, round(self.num_bits / max(1, count) * math.log(2))))
        places = ids.where(F.col(column).isNotNull()).select(F.explode(F.array(*self._places(F.col(column)))).alias("place"))
        summed = places.groupBy(F.expr("place div 8").alias("at")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("place") % 8).cast("int"))).alias("bits")
        )
        held = bytearray(self.num_bits // 8)
        for row in summed.toLocalIterator():
            held[row["at"]] = row["bits"]
        self.bits = F.lit(bytes(held))

    def _places(self, value: Column) -> list[Column]:
        first, step = (F.pmod(F.xxhash64(value, F.lit(seed)), F.lit(self.num_bits)) for seed in (1, 2))
        return [(first + i * step) % self.num_bits for i in range(self.num_hashes)]

    def might_hold(self, value: Column) -> Column:
        """True for every id of the filter, and for few others; false for null."""

        def is_set(place: Column) -> Column:
            byte = F.conv(F.hex(F.substring(self.bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10)
            return F.call_function("getbit", byte.cast("int"), (place % 8).cast("int")) == 1

        return value.isNotNull() & reduce(lambda a, b: a & b, map(is_set, self._places(value)))


def rows_of_ids(rows: DataFrame, ids: DataFrame, column: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The ``rows`` whose ``column`` is one of ``ids``; the others stay where they are read.

    Ids measured small are sent to the rows. More ids than that meet the rows in a shuffle, which only
    rows that pass the ids' Bloom filter take part in, so what moves grows with the ids.
    """
    wanted = ids.where(F.col(column).isNotNull()).select(column).distinct()
    if fits_broadcast(wanted, broadcast_bytes):
        return rows.join(F.broadcast(wanted), column, "left_semi").select(*rows.columns)
    passed = rows.where(IdFilter(ids, column).might_hold(F.col(column)))
    return passed.join(wanted.hint("merge"), column, "left_semi").select(*rows.columns)
