"""Connected components by label passing with label hooking and jumping, in as many rounds as it takes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.tables import Scratch


def components(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, comp): the smallest label reachable over links (a, b), in tables of scratch.

    labels: (id, comp) to start from, comp being an id of the same component. A round passes each label to all neighbours,
    tells what a node was passed to the node it is labelled with as well, so that trees are hooked to each other as a whole,
    and then takes the label's own label: rounds grow with the logarithm of a chain. A hub is pre-aggregated before it is
    shuffled: of a node's neighbours only the smallest label counts. What has no link and its own label takes no part in
    the rounds.
    """
    both = scratch.cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    tied = both.select(F.col("a").alias("id"), F.lit(True).alias("tied")).distinct()
    start = labels.select("id", "comp").join(tied, "id", "left").select("id", "comp", (F.col("tied").isNotNull() | (F.col("id") != F.col("comp"))).alias("moves"))
    start = scratch.cut(start, "start")
    lab, old = start.where("moves").select("id", "comp"), None
    still = start.where("NOT moves").select("id", "comp", F.lit(False).alias("moved"))
    while True:
        near = both.join(lab, both.b == lab.id).groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        told = lab.join(near, "id").where("m < comp").select(F.explode(F.array("id", "comp")).alias("id"), "m").groupBy("id").agg(F.min("m").alias("m"))
        step = lab.join(told, "id", "left").select("id", "comp", F.least("comp", "m").alias("m"))
        up = lab.select(F.col("id").alias("m"), F.col("comp").alias("up"))
        new = step.join(up, "m", "left").select("id", F.least("m", "up").alias("comp"), (F.least("m", "up") < F.col("comp")).alias("moved"))
        new = scratch.cut(new, "labels")
        scratch.drop(old)
        lab, old = new.select("id", "comp"), new
        if new.where("moved").isEmpty():
            scratch.drop(both)
            return new.unionByName(still)
