"""Sharding by a Feistel permutation of global row numbers. Built-in functions only.

Rows get the numbers 0 .. n - 1 in the order of their key, a keyed permutation
sends number to position, and position p is slot p div k of shard p mod k. Who
knows n, k and the key can compute the place of any row without looking at others,
and the counts of two shards differ by one at most.

Null keys sort first. Rows with equal order columns are equal in all that is used
here, so their order among themselves makes no difference. An empty table gives
no rows. Further columns of the input are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .shared import Kept

PRIME = 2**31 - 1
WALK = 64


def round_keys(key: int, rounds: int = 6) -> list[tuple[int, int, int]]:
    """Three numbers under PRIME for each round, from a linear congruence."""
    out, x = [], (key * 2654435761 + 12345) % PRIME
    for _ in range(rounds):
        three = []
        for _ in range(3):
            x = (x * 48271 + 11) % PRIME
            three.append(x or 1)
        out.append(tuple(three))
    return out


def sides(n: int) -> tuple[int, int]:
    """a and b with a * b >= n and less than a positions too many."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def feistel(number: Column, n: int, key: int) -> Column:
    """Where ``number`` (0 .. n - 1) goes, as an expression.

    Halves live in Z_a and Z_b, and each round adds a keyed mix of the one to the
    other, which can be undone whatever the mix is. A result of n or more (at most
    one in sqrt(n)) walks on through the permutation until it falls under n; WALK
    steps reach that for certain where n is small, and beyond a probability of
    n ** -32 otherwise; a row that doesn't arrive raises an error.
    """
    a, b = sides(n)
    keys = F.array(*[F.struct(F.lit(i % 2).alias("odd"), F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y"), F.lit(z).cast("long").alias("z")) for i, (x, y, z) in enumerate(round_keys(key))])
    p = F.lit(PRIME).cast("long")

    def mixed(v, k):
        t = (v * k["x"] + k["y"]) % p
        t = (t * t + k["z"]) % p
        return (t * k["y"] + k["x"]) % p

    def once(x):
        both = F.struct(div(x, b).alias("l"), (x % F.lit(b)).cast("long").alias("r"))
        done = F.aggregate(keys, both, lambda s, k: F.when(
            k["odd"] == 0, F.struct(((s["l"] + mixed(s["r"], k)) % F.lit(a)).cast("long").alias("l"), s["r"].alias("r"))
        ).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + mixed(s["l"], k)) % F.lit(b)).cast("long").alias("r"))))
        return F.aggregate(F.array(done), F.lit(0).cast("long"), lambda _, s: s["l"] * F.lit(b) + s["r"])

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(number), lambda x, _: F.when(x < F.lit(n), x).otherwise(once(x)))
    return F.when(walk < F.lit(n), walk).otherwise(F.raise_error(F.lit("the walk didn't arrive")).cast("long"))


def div(x: Column, by: int) -> Column:
    """x div by, exact over 64 bits."""
    return F.call_function("div", x, F.lit(by).cast("long")).cast("long")


def numbered(kept: Kept, df: DataFrame, order: list[str], into: str) -> tuple[DataFrame, int]:
    """``df`` with gapless global row numbers in the order of the columns, and their count.

    One range shuffle sorts; the sorted table is written, so that the counts of
    its parts and the numbers come from the same order; what is joined back is one
    offset for each part.
    """
    part, idx = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    laid = kept.put(df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    sizes = laid.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.put(sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("long")))
    n = starts.agg(F.sum("__n")).first()[0] or 0
    # one row for each part of the sort, so never more rows than it had tasks
    out = laid.withColumn("__part", part).join(F.broadcast(starts.select("__part", "__start")), "__part")
    return out.withColumn(into, F.col("__start") + idx).drop("__part", "__start", "__at"), int(n)


def shard_rows(docs: DataFrame, shards: int = 24, key: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, row_number, position, shard, slot) of every row.

    size is the UTF-8 bytes of the text plus 8. Null texts count as empty: size 8,
    crc32 0. The text itself isn't shuffled.
    """
    kept = Kept(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    light = docs.select(F.col(id_col).alias(id_col), (F.octet_length(text).cast("long") + F.lit(8)).alias("size"), F.crc32(text.cast(T.BinaryType())).cast("long").alias("text_crc32"))
    rows, n = numbered(kept, light, [id_col, "text_crc32", "size"], "row_number")
    rows = rows.withColumn("position", feistel(F.col("row_number"), n, key))
    return rows.withColumn("shard", (F.col("position") % shards).cast("int")).withColumn("slot", div(F.col("position"), shards))
