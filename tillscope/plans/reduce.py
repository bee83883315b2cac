"""Semi-join reduction: payments of the transactions that a filter leaves.

Payments have no date or store, so a filter on items does not reach them, and
the payment join would shuffle all of them.  A bitmap of the hashed ids of the
filtered items goes to the payments' scan instead: a payment whose bit is not
set cannot match and is dropped before the shuffle.  The bitmap has a fixed
size (``BITS`` bits, 8 MiB by default, in rows of 4 KiB), so its broadcast
is bounded whatever the data; with many more ids than bits it lets more payments
through, and the join that follows is exact in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap; a multiple of those of one row.
BITS = 1 << 26
ROW_BITS = 8 * 4096


def _bit(key: str, bits: int) -> Column:
    """The id's bit, from 1; ids of any type are hashed as text, as the join may compare them so."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(bits)) + 1


def id_bitmap(df: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """``_row, _bitmap``: the bits of the frame's ids, at most ``bits / ROW_BITS`` rows."""
    ids = df.where(F.col(key).isNotNull()).select(_bit(key, bits).alias("_bit")).distinct()
    return ids.groupBy(F.bitmap_bucket_number("_bit").alias("_row")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bitmap"))


def reduced(df: DataFrame, key: str, kept: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be one of ``kept``: all that are, and a few others."""
    maps = F.broadcast(id_bitmap(kept, key, bits))
    bit = _bit(key, bits)
    at = F.bitmap_bit_position(bit)
    both = df.join(maps, F.bitmap_bucket_number(bit) == maps["_row"])
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return both.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*(df[c] for c in df.columns))
