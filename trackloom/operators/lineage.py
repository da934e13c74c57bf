"""Cutting lineage in iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir; one of our own only where that is unset and Spark runs on this machine alone, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="trackloom-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder; it keeps how its rows are dealt."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, for loops: a checkpoint's guessed size would grow with every round. before: a stored table that df replaces, deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if before is not None:
        for old in {f.rsplit("/", 1)[0] for f in before.inputFiles()}:
            spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old), True)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one key that a task of a join takes; keys with more are dealt to several tasks.
HUB_ROWS = 1 << 17


def labelled(nodes: DataFrame, links: DataFrame, hub_rows: int = HUB_ROWS) -> DataFrame:
    """(node, root): the least node reachable over links (a, b), by alternating stars (Kiveris et al. 2014).

    In a large star every node ties its greater neighbours to its least one, in a small star itself and its smaller ones,
    until all links lead to roots: a number of rounds that grows with the logarithm of the longest chain. A node's least
    neighbour is merged in the tasks, and the rows of a node with very many links are dealt to several.
    """
    pair = lambda x, y: F.struct(F.greatest(x, y).alias("v"), F.least(x, y).alias("m"))
    edges = stored(links.where(F.col("a") != F.col("b")).select(pair("a", "b").alias("e")).select("e.*").distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.select(F.col("v").alias("u"), F.col("m").alias("o")).union(edges.select("m", "v"))
        large = _with_least(both, hub_rows).where(F.col("o") > F.col("u")).select(F.col("o").alias("v"), F.least("u", "low").alias("m")).distinct()
        large = stored(large)
        small = _with_least(large.select(F.col("v").alias("u"), F.col("m").alias("o")), hub_rows)
        edges = stored(small.select("u", "low").union(small.where(F.col("o") != F.col("low")).select("o", "low")).toDF("v", "m").distinct(), large)
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    return nodes.join(edges, nodes.node == edges.v, "left").select("node", F.coalesce("m", "node").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """What tells two sets of links apart."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())


def _with_least(rows: DataFrame, hub_rows: int) -> DataFrame:
    """rows (u, o) with low, the least o of u; the rows of a hub are dealt by o to several tasks."""
    low = stored(rows.groupBy("u").agg(F.min("o").alias("low"), F.count("*").alias("n")))
    total, most = low.agg(F.sum("n"), F.max("n")).first()
    if not total or most <= hub_rows:
        return rows.join(low.drop("n"), "u")
    # at most four hubs a shuffle partition, so their table is small
    limit = max(hub_rows, total // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
    hubs = low.where(F.col("n") > limit).select(F.col("u").alias("hub"), F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = rows.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left").withColumn("part", F.pmod(F.xxhash64("o"), parts).cast("int")).select("u", "o", "part")
    copies = low.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("u", "low", "part")
    return dealt.join(copies, ["u", "part"]).drop("part")
