"""A one-bit filter that tells which rows a join can't take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places for each wanted row: one row in nine that isn't wanted passes.
SPARSE = 8
#: Most places; a power of two. The broadcast filter has at most MOST / 64 rows of two longs, 32 MB.
MOST = 1 << 27


def places(n: int) -> int | None:
    """Places for ``n`` wanted rows, a power of two; None if over MOST are wanted, where a filter passes most rows."""
    return None if n > MOST else min(MOST, 1 << max(16, (SPARSE * n - 1).bit_length()))


def marked(rows: DataFrame, wanted: DataFrame, column: str = "h") -> DataFrame:
    """``rows`` with ``_maybe``: false only if no row of ``wanted`` has the same ``column``.

    ``column`` is a bigint hash, not null; ``wanted`` should be cheap to count. The filter is built
    by sums before its shuffle and broadcast, its size bounded by MOST whatever the data. It only
    saves moving rows that no later join would take: beyond MOST wanted rows, all are marked.
    """
    size = places(wanted.count())
    if size is None:
        return rows.withColumn("_maybe", F.lit(True))
    place = F.pmod(column, F.lit(size))
    shift = f"CAST(pmod({column}, {size}) % 64 AS INT)"
    bits = wanted.select(F.shiftright(place, 6).alias("_word"), F.expr(f"shiftleft(1L, {shift})").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    found = rows.withColumn("_word", F.shiftright(place, 6)).join(F.broadcast(bits), "_word", "left")
    return found.withColumn("_maybe", F.coalesce(F.expr(f"(shiftright(_bits, {shift}) & 1) = 1"), F.lit(False))).drop("_word", "_bits")
