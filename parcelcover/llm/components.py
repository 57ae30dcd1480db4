"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelcover.plans.materialize import materialize, release


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node in a link; label is the smallest node that it can reach.

    Each round takes the smallest label over the links and then the label's own label, so a chain halves
    and more per round. Each round is written to the shared folder; the driver sees one count a round.
    Links with a null end and loops are left out; no links give an empty table.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = materialize(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    label = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
    label = materialize(label.select("node", F.least("node", "low").alias("label"), F.lit(True).alias("moved")), "labels")
    while label.where("moved").limit(1).count():
        near = both.join(label, both.v == label.node).groupBy("u").agg(F.min("label").alias("near"))
        step = label.join(near, label.node == near.u).select("node", F.col("label").alias("old"), F.least("label", "near").alias("new"))
        own = label.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        step = step.join(own, step.new == own.n2).select("node", "old", F.least("new", "l2").alias("label"))
        last, label = label, materialize(step.select("node", "label", (F.col("label") < F.col("old")).alias("moved")), "labels")
        release(last)
    release(both)
    return label.select("node", "label")
