"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import written


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node that has a link; `links` holds (a, b).

    Every round a node takes the smallest label among its neighbours, then follows its label
    twice, so chains shorten by a factor per round. Labels and links stay distributed and are
    written each round; hot nodes meet through joins that adaptive execution can split.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a <> b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        step = written(step, "labels")
        after = step.select(F.col("node").alias("at"), F.col("label").alias("next"))
        step = written(step.join(after, F.col("label") == F.col("at")).select("node", "old", F.col("next").alias("label")), "labels")
        after = step.select(F.col("node").alias("at"), F.col("label").alias("next"))
        step = written(step.join(after, F.col("label") == F.col("at")).select("node", "old", F.col("next").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "root")
