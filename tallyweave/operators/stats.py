"""Robust statistics of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summaries(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """(key, n, med, mean, sd, cv, weighted): NULL values take no part; cv is NULL for a mean of 0.

    The median is exact, yet no task sorts a group: approximate quantiles (a bounded sketch a group) bracket it, rows below
    the bracket are counted, and only those within, some hundredths of a group, are ranked.
    """
    d = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w")).where("v IS NOT NULL")
    about = d.groupBy("k").agg(
        F.percentile_approx("v", F.array(F.lit(0.49), F.lit(0.51)), 10_000).alias("q"), F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), (F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("weighted")
    )
    # Keys may be NULL, so they are joined null-safely, under names of their own.
    near = d.join(about.select(F.col("k").alias("ka"), "n", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi")), F.expr("k <=> ka")).select("k", "v", "n", "lo", "hi")
    below = near.groupBy(F.col("k").alias("kb")).agg(F.count_if(F.col("v") < F.col("lo")).alias("below"))
    # Equal values count once, so that many of them are one row.
    some = near.where("v BETWEEN lo AND hi").groupBy("k", "n", "v").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = some.withColumn("upto", upto).join(below, F.expr("k <=> kb")).withColumn("upto", F.col("below") + F.col("upto"))
    at = lambda r: F.max(F.when((F.col("upto") >= r) & (F.col("upto") - F.col("m") < r), F.col("v")))
    mid = ranked.groupBy(F.col("k").alias("km")).agg(((at(F.floor((F.col("n") + 1) / 2)) + at(F.floor((F.col("n") + 2) / 2))) / 2).alias("med"))
    out = about.join(mid, F.expr("k <=> km"), "left")
    return out.select(F.col("k").alias(key), "n", "med", "mean", "sd", (F.col("sd") / F.nullif(F.col("mean"), F.lit(0.0))).alias("cv"), "weighted")
