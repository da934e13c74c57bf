"""Consensus of several captions of one entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions.expressions import degenerate, dot, mentions


def candidates(captions: DataFrame, people: list[str] | None = None, least_confidence: float = 0.3) -> DataFrame:
    """The captions (entity, idx, caption, confidence, vector) that may be the consensus, with n, how many the entity has of them, and excluded.

    Looping captions and those of low confidence are out; the first stays where all are. Where a strict majority of the
    rest mentions a person, only those stay. excluded tells whether the first of the two rules took any.
    """
    own = Window.partitionBy("entity")
    sound = ~degenerate(F.col("caption")) & (F.coalesce("confidence", F.lit(0.0)) >= least_confidence)
    c = captions.withColumn("_sound", sound).withColumn("_any", F.max("_sound").over(own)).withColumn("_first", F.min("idx").over(own)).withColumn("_all", F.count("*").over(own))
    c = c.where(F.col("_sound") | (~F.col("_any") & (F.col("idx") == F.col("_first"))))
    c = c.withColumn("_said", mentions(F.col("caption"), people)).withColumn("_n", F.count("*").over(own)).withColumn("_people", F.sum(F.col("_said").cast("int")).over(own))
    c = c.withColumn("excluded", F.col("_n") < F.col("_all")).where(F.col("_said") | (2 * F.col("_people") <= F.col("_n")))
    return c.withColumn("n", F.count("*").over(own)).select("entity", "idx", "caption", "vector", "n", "excluded")


def consensus(chosen: DataFrame) -> DataFrame:
    """(entity, idx, caption, n, agreement): the candidate nearest to the mean vector, the first on ties.

    Agreement is the mean cosine of all pairs, from the length of the vectors' sum: no pairs are made. A lone caption
    has agreement 1, or 0 where others were excluded. Vectors have unit length.
    """
    total = chosen.select("entity", F.posexplode("vector").alias("place", "x")).groupBy("entity", "place").agg(F.sum(F.col("x").cast("double")).alias("x"))
    total = total.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("total"))
    best = chosen.join(total, "entity", "left").withColumn("near", F.coalesce(dot(F.col("vector"), F.col("total")), F.lit(0.0)))
    best = best.groupBy("entity").agg(F.max_by(F.struct("idx", "caption"), F.struct("near", -F.col("idx"))).alias("top"), F.first("n").alias("n"), F.first("excluded").alias("excluded"), F.first("total").alias("total"))
    pairs = (dot(F.col("total"), F.col("total")) - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    agreement = F.when(F.col("n") == 1, F.when(F.col("excluded"), 0.0).otherwise(1.0)).otherwise(pairs)
    return best.select("entity", "top.idx", "top.caption", "n", agreement.alias("agreement"))
