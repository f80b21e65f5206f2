"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm import shared


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every end of ``links`` (a, b): root is the smallest id that links reach.

    Labels sink along links and through the label of the label, so long chains shrink by a factor per round. Labels
    and links stay in Spark; the only value that reaches the driver is the number of changes.
    """
    both = shared.cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = shared.cut(both.groupBy("a").agg(F.min("b").alias("low")).select(
        F.col("a").alias("id"), F.least("a", "low").alias("root")))
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), F.col("root").alias("near")), "b") \
            .groupBy("a").agg(F.min("near").alias("near"))
        far = labels.select(F.col("id").alias("root"), F.col("root").alias("far"))
        new = labels.join(far, "root").join(seen.withColumnRenamed("a", "id"), "id", "left").select(
            "id", F.least("far", "near", "root").alias("new"), "root")
        new = shared.cut(new)
        changed = new.where("new <> root").limit(1).count()
        labels = new.select("id", F.col("new").alias("root"))
        if not changed:
            return labels
