"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents a Python worker holds at once; texts may be long, so this is far below Spark's default.
ARROW_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset and Spark runs on this machine alone (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="trackloom-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of documents holds, and keep Spark from reading texts once more only to filter a join."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "false")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind value to a name inside one expression, so that it is computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def struct_row(df: DataFrame) -> DataFrame:
    """df as one struct column `row`: whatever its columns are called, other columns beside it cannot clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def dealt_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right (one row a key) so that no key of left gets into one task as a whole.

    A key is hot when it has more than a quarter of the rows of a mean partition, so there are at most 4 hot keys a
    partition and their table can be broadcast. Rows of hot keys are dealt to several tasks by a hash of the whole row,
    which a task that runs again repeats; right's row is copied to each.
    """
    spark = left.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    count = checkpointed(left.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 64"))
    limit = max(64, (left.count() if not count.isEmpty() else 0) // (4 * tasks))
    hot = count.where(F.col("count") > limit).select(F.col(key).alias("hot_key"), F.ceil(F.col("count") / limit).cast("int").alias("parts"))
    if hot.isEmpty():
        return left.join(right, key, how)
    parts = F.coalesce("parts", F.lit(1))
    own = right.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("hot_key", "parts")
    dealt = left.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left").withColumn("part", F.pmod(F.xxhash64(*left.columns), parts).cast("int"))
    return dealt.drop("hot_key", "parts").join(own, [key, "part"], how).drop("part")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the undirected edges (a, b) of longs: (node, component), component the least node.

    Every node starts under its least neighbour; then, until all links are inside one label, each label hooks onto the
    least label that it has a link with, and pointer jumping flattens the hooks. The number of passes grows with the
    logarithm of the longest chain. A node with very many neighbours is pre-aggregated (min) before the shuffle. Self
    loops keep single nodes. Nulls in a or b are dropped. An empty input gives an empty result.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    label = checkpointed(nodes.join(_neighbour_min(e), "node", "left").select("node", F.least("node", "low").alias("comp")))
    links = checkpointed(e.where("u <> v").distinct())
    while True:
        # hook: each link pulls the labels of both ends to the smaller one
        both = (
            links.join(label.select(F.col("node").alias("u"), F.col("comp").alias("cu")), "u")
            .join(label.select(F.col("node").alias("v"), F.col("comp").alias("cv")), "v")
            .select("cu", "cv")
            .where("cu <> cv")
        )
        hook = both.groupBy(F.greatest("cu", "cv").alias("root")).agg(F.min(F.least("cu", "cv")).alias("to"))
        hook = checkpointed(hook)
        if hook.isEmpty():
            return label.select("node", F.col("comp").alias("component"))
        # jump until the hooks of roots are flat: root -> to -> ...
        while True:
            nxt = hook.alias("x").join(hook.alias("y"), F.col("x.to") == F.col("y.root"), "left")
            nxt = checkpointed(nxt.select(F.col("x.root").alias("root"), F.coalesce("y.to", "x.to").alias("to"), F.col("y.to").isNotNull().alias("moved")))
            hook = nxt.select("root", "to")
            if nxt.where("moved").isEmpty():
                break
        label = checkpointed(label.join(hook, label.comp == hook.root, "left").select("node", F.coalesce("to", "comp").alias("comp")))


def _neighbour_min(e: DataFrame) -> DataFrame:
    both = e.select(F.col("u").alias("node"), F.col("v").alias("other")).union(e.select("v", "u"))
    return both.groupBy("node").agg(F.min("other").alias("low"))


def schema_of(fields: Iterable[tuple[str, str]]) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in fields)
