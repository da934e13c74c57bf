"""Reproducible shuffle and shards: a Feistel permutation with cycle walking over global row numbers.

Row numbers 0 to n-1 follow the order of a hash of the id (then id, then the rest of the row). The permutation of
[0, n) is an unbalanced Feistel network over Z_a x Z_b with a = ceil(sqrt(n)) and b = ceil(n / a); results at or beyond n
walk on along their cycle until they are below n. Fewer than a numbers lie beyond, so few rows walk at all. The place of
a row is the permuted number: shard = place mod shards, slot = place div shards. Both can be computed from the row
number alone, and the row number from shard and slot (`row_of`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.llm.common import let, stored, struct_row

ROUNDS = 6
#: Rows that one bucket of the numbering holds on average, and bits of buckets at most (their offsets are one small table).
BUCKET_ROWS, MOST_BITS = 512, 16


def domain(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n and a * b - n < a."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _div(x: Column, a: int) -> Column:
    """Whole division of longs, exact beyond 2^53 too."""
    return F.call_function("div", x, F.lit(a))


def _step(x: Column, a: int, b: int, seed: int) -> Column:
    """The Feistel network on 0 to a*b-1."""
    state = F.struct((x % a).alias("l"), _div(x, a).alias("r"))

    def turn(s: Column, i: int) -> Column:
        l, r = s["l"], s["r"]  # noqa: E741
        if i % 2 == 0:
            return F.struct(F.pmod(l + F.pmod(F.xxhash64(r, F.lit(seed), F.lit(i)), F.lit(a)), F.lit(a)).alias("l"), r.alias("r"))
        return F.struct(l.alias("l"), F.pmod(r + F.pmod(F.xxhash64(l, F.lit(seed), F.lit(i)), F.lit(b)), F.lit(b)).alias("r"))

    def rest(s: Column, i: int) -> Column:
        return s["l"] + s["r"] * a if i == ROUNDS else let(turn(s, i), lambda t: rest(t, i + 1))

    return let(state, lambda s: rest(s, 0))


def permuted(row: Column, n: int, seed: int) -> Column:
    """The place of a row number under the permutation of [0, n)."""
    a, b = domain(n)
    beyond = a * b - n
    first = _step(row, a, b, seed)
    if not beyond:
        return first
    # a cycle leaves [n, a*b) after as many steps as it has numbers, at most; only rows that land there walk
    return let(first, lambda x: F.when(x < n, x).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(beyond)), x, lambda y, _: F.when(y < n, y).otherwise(_step(y, a, b, seed)))))


def row_of(place: Column, n: int, seed: int) -> Column:
    """The row number at a place: the inverse of `permuted`."""
    a, b = domain(n)

    def back(x: Column) -> Column:
        def turn(s: Column, i: int) -> Column:
            l, r = s["l"], s["r"]  # noqa: E741
            if i % 2 == 0:
                return F.struct(F.pmod(l - F.pmod(F.xxhash64(r, F.lit(seed), F.lit(i)), F.lit(a)), F.lit(a)).alias("l"), r.alias("r"))
            return F.struct(l.alias("l"), F.pmod(r - F.pmod(F.xxhash64(l, F.lit(seed), F.lit(i)), F.lit(b)), F.lit(b)).alias("r"))

        def rest(s: Column, i: int) -> Column:
            return s["l"] + s["r"] * a if i < 0 else let(turn(s, i), lambda t: rest(t, i - 1))

        return let(F.struct((x % a).alias("l"), _div(x, a).alias("r")), lambda s: rest(s, ROUNDS - 1))

    beyond = a * b - n
    first = back(place)
    if not beyond:
        return first
    return let(first, lambda x: F.when(x < n, x).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(beyond)), x, lambda y, _: F.when(y < n, y).otherwise(back(y)))))


def numbered(df: DataFrame, id_col: str, name: str = "row") -> tuple[DataFrame, int]:
    """df with global row numbers from 0, and the number of rows.

    Equal rows are counted before they are shuffled and expanded in chunks afterwards, so a row that is repeated very
    often burdens no single task. One shuffle of the distinct rows; no row number depends on partitions.
    """
    cols = df.columns
    rows = df.groupBy(*cols).agg(F.count("*").alias("_n")) if cols else df
    rows = rows.withColumn("_h", F.xxhash64(id_col))
    n = df.count()
    bits = min(MOST_BITS, max(1, (n // BUCKET_ROWS).bit_length()))
    # buckets follow the order of the hash, so the order of rows is (hash, id, rest) all through
    rows = stored(rows.withColumn("_b", F.shiftright("_h", 64 - bits).cast("int")))
    sizes = rows.groupBy("_b").agg(F.sum("_n").alias("_s"))
    ahead = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 2^MOST_BITS rows at most
    offsets = sizes.select("_b", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_b").orderBy("_h", *cols).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_c", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(offsets), "_b")
    rows = rows.withColumn("_first", F.col("_o") + F.col("_c"))
    chunk = 1024
    many = rows.where(F.col("_n") > chunk).withColumn("_k", F.explode(F.sequence(F.lit(0), ((F.col("_n") - 1) / chunk).cast("long")))).repartition("_first", "_k")
    few = rows.where(F.col("_n") <= chunk).withColumn("_k", F.lit(0).cast("long"))
    at = F.col("_first") + F.col("_k") * chunk
    end = F.least(at + chunk, F.col("_first") + F.col("_n"))
    out = few.unionByName(many).select(*cols, F.explode(F.sequence(at, end - 1)).alias(name))
    return out, n


def feistel_shards(df: DataFrame, shards: int, id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """df with `row`, `shard` and `slot`: counts of shards differ by one at most, slots of a shard are gapless from 0.

    The assignment depends on the set of rows, shards and seed only, not on partitions or order. Null ids are hashed like
    any value; equal rows get neighbouring row numbers and are interchangeable. An empty table gives an empty result. df
    should hold narrow columns (ids, sizes, checksums): the rows are shuffled once. Its column names are free, but for
    row, shard and slot.
    """
    rows, n = numbered(struct_row(df), f"row.`{id_col}`", "number")
    place = permuted(F.col("number"), max(n, 1), seed)
    return rows.withColumn("place", place).select("row.*", F.col("number").alias("row"), (F.col("place") % shards).cast("int").alias("shard"), _div(F.col("place"), shards).alias("slot"))
