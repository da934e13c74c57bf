"""Running values along an order, for keys that may hold more rows than a task.

Rows are dealt by ranges of key and order, each range is scanned on its own, and what the ranges before it end with is
carried in: a key has at most one row a range there, so that table stays small whatever a key holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.operators.lineage import checkpointed

#: Rows of one key that a window scans in one task; keys with more go over ranges.
WINDOW_ROWS = 1 << 20


def _ascending(order: list[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def scanned(df: DataFrame, by: list[str], order: list[Column | str], before: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with, for each name of `before`, a value over the rows of its key that precede it in the order.

    before: name -> (kind, value): `sum` (0 before the first row), `max` and `last` (null before it); `last` is the value
    of the row just before, null too where that is null. The order must leave no ties, else tied rows come in any order.
    Null keys are a key. The result is the same however many ranges a key lies in.
    """
    keys = F.struct(*by) if by else F.lit(0)
    r = df.withColumn("_k", keys).withColumns({f"_v_{n}": v for n, (_, v) in before.items()})
    # written once: ranges are sampled, and a second run might cut elsewhere
    r = checkpointed(r.repartitionByRange("_k", *_ascending(order)).withColumn("_p", F.spark_partition_id()))
    own = Window.partitionBy("_p", "_k").orderBy(*_ascending(order))
    until = own.rowsBetween(Window.unboundedPreceding, -1)
    local = {f"_l_{n}": {"sum": F.sum(f"_v_{n}").over(until), "max": F.max(f"_v_{n}").over(until), "last": F.lag(F.struct(f"_v_{n}")).over(own)}[kind] for n, (kind, _) in before.items()}
    r = r.withColumns({"_n": F.row_number().over(own), **local})
    ends = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(F.struct(c), "_n")}
    total = r.groupBy("_k", "_p").agg(*[ends[kind](f"_v_{n}").alias(f"_t_{n}") for n, (kind, _) in before.items()])
    past = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = {"sum": lambda c: F.sum(c).over(past), "max": lambda c: F.max(c).over(past), "last": lambda c: F.last(c).over(past)}
    total = total.select("_k", "_p", *[carry[kind](F.col(f"_t_{n}")).alias(f"_c_{n}") for n, (kind, _) in before.items()])
    j = r.join(total, ["_k", "_p"])
    both = {
        "sum": lambda n: F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)),
        "max": lambda n: F.greatest(f"_l_{n}", f"_c_{n}"),
        "last": lambda n: F.coalesce(f"_l_{n}", f"_c_{n}")[f"_v_{n}"],
    }
    return j.select(*[F.col(f"`{c}`") for c in df.columns], *[both[kind](n).alias(n) for n, (kind, _) in before.items()])


def largest(df: DataFrame, by: list[str]) -> int:
    """Rows of the largest key; 0 without rows. Counted in each task before the shuffle."""
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def numbered(df: DataFrame, by: list[str], order: list[Column | str], name: str, most: int = WINDOW_ROWS) -> DataFrame:
    """df with name: 0, 1, ... along the order of each key; by a window where no key has more than `most` rows, else over ranges."""
    if largest(df, by) <= most:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    return scanned(df, by, order, {name: ("sum", F.lit(1))}).withColumn(name, F.col(name).cast("long"))


def dense_ranks(df: DataFrame, by: list[str], value: str, name: str, most: int = WINDOW_ROWS) -> DataFrame:
    """(by, value, name): the distinct values of each key with their place 0, 1, ... in ascending order."""
    return numbered(df.select(*by, value).distinct(), by, [value], name, most)


def front(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, x, y): the points of each key that no other one reaches in both x and y; of equal x the highest y, null ones left out."""
    top = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x).agg(F.max(y).alias(y))
    return scanned(top, by, [F.desc(x)], {"_above": ("max", F.col(y))}).where(F.col("_above").isNull() | (F.col(y) > F.col("_above"))).drop("_above")


def sessions(df: DataFrame, by: list[str], at: str, order: list[str], max_gap: int, name: str, most: int = WINDOW_ROWS) -> DataFrame:
    """df with name: the number, from 0, of the stretch of its key without a gap in `at` of more than max_gap; `at` leads the order."""
    fresh = lambda last: F.coalesce(F.col(at) - last > max_gap, F.lit(False)).cast("int")
    if largest(df, by) <= most:
        w = Window.partitionBy(*by).orderBy(at, *order)
        return df.withColumn("_new", fresh(F.lag(at).over(w))).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    step = scanned(df, by, [at, *order], {"_last": ("last", F.col(at))}).withColumn("_new", fresh(F.col("_last"))).drop("_last")
    return scanned(step, by, [at, *order], {"_past": ("sum", F.col("_new"))}).withColumn(name, (F.col("_past") + F.col("_new")).cast("long")).drop("_past", "_new")


def quantiles(df: DataFrame, value: str, shares: list[float], most: int = WINDOW_ROWS) -> dict[float, float]:
    """Exact quantiles, interpolated between neighbours as quantile_cont does, of a column without its nulls; empty without values.

    Selection by refined histograms: the interval of a wanted rank is cut into BINS, each counted in the tasks, and the
    bin that holds the rank is cut next, until what it holds fits one task or is one value. What reaches the driver is a
    row a bin.
    """
    v = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    n, low, high = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return {}
    out = {}
    for share in shares:
        place = share * (n - 1)
        below = int(place)
        at = [_value_of_rank(v, k, low, high, most) for k in ([below, below + 1] if below < place else [below])]
        out[share] = at[0] + (at[-1] - at[0]) * (place - below)
    return out


#: Bins of each step of a selection.
BINS = 1024


def _value_of_rank(v: DataFrame, rank: int, low: float, high: float, most: int) -> float:
    """The value with `rank` smaller ones before it, ties apart; low and high are the least and greatest values."""
    while True:
        inside = v.where(F.col("v").between(low, high))
        step = (high - low) / BINS
        if low == high:
            return low
        bin_ = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("v") - low) / step))).cast("int").alias("bin") if step > 0 else F.lit(0).alias("bin")
        rows = sorted(inside.groupBy(bin_).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())  # at most BINS rows
        for r in rows:
            if rank < r.n:
                break
            rank -= r.n
        low, high = r.lo, r.hi
        if r.n <= most and low < high:
            few = inside.where(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("n")).orderBy("v")
            return few.withColumn("past", F.sum("n").over(Window.orderBy("v"))).where(F.col("past") > rank).orderBy("v").first()["v"]
