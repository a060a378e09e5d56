"""Finding the rows worth a shuffle: a bitmap of hashes, broadcast, before an exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap at most: 2^20 rows of a word and its bits, some 16 MB. A fuller bitmap lets more rows pass.
MOST_BITS = 1 << 26
#: Bits for each member, up to that: one in nine strangers passes.
BITS_EACH = 8


def mark_possible(df: DataFrame, value: Column, members: DataFrame) -> DataFrame:
    """``df`` with ``__possible``: true for every row whose ``value`` is among ``members``, and for few others.

    ``members`` has one column of 64-bit hashes and should be a written table, as it is counted first. An exact join of
    the possible rows must follow; it then moves them alone. A null value is never a member.
    """
    hashes = members.toDF("hash").filter("hash is not null")
    bits = min(MOST_BITS, max(64, 1 << (BITS_EACH * hashes.count() - 1).bit_length()))

    def place(hash_: Column) -> tuple[Column, Column]:
        at = F.pmod(hash_, F.lit(bits))
        return F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))

    word, bit = place(F.col("hash"))
    table = hashes.select(word.alias("__word"), bit.alias("bit")).groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    word, bit = place(value)
    found = df.withColumns({"__word": word, "__bit": bit}).join(F.broadcast(table), "__word", "left")
    possible = F.coalesce(F.col("__bits").bitwiseAND(F.col("__bit")) != 0, F.lit(False))
    return found.withColumn("__possible", possible).drop("__word", "__bit", "__bits")
