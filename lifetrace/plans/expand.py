"""Integer ranges turned into rows without arrays that grow with a range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_BITS = 16


def expanded(rows: DataFrame, first: str, last: str, out: str) -> DataFrame:
    """One row per number of [first, last], named ``out``; empty ranges give none.

    Most ranges fit in one array of at most 2^PIECE_BITS numbers. Wider ones are cut
    into pieces, from coarse to fine, so that no array is longer; the pieces are dealt
    over all tasks before they become rows. ``first`` and ``last`` are lost.
    """
    width = F.col(last) - F.col(first)
    kept = [c for c in rows.columns if c not in (first, last)]
    numbers = F.explode(F.sequence(F.col(first), F.col(last))).alias(out)
    narrow = rows.filter((width >= 0) & (width < (1 << PIECE_BITS)))
    pieces = rows.filter(width >= (1 << PIECE_BITS))
    for bits in range(63 // PIECE_BITS * PIECE_BITS, 0, -PIECE_BITS):
        whole = F.shiftleft(F.col("_piece"), bits)
        pieces = (
            pieces.withColumn("_piece", F.explode(F.sequence(F.shiftright(first, bits), F.shiftright(last, bits))))
            .withColumns({first: F.greatest(F.col(first), whole), last: F.least(F.col(last), whole + ((1 << bits) - 1))})
            .drop("_piece")
        )
    pieces = pieces.repartition(F.col(first), F.col(last))
    return narrow.select(*kept, numbers).unionByName(pieces.select(*kept, numbers))
