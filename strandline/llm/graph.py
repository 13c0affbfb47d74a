"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """links (a, b long) -> (id, component): the smallest id that each id in a link reaches.

    Every round hooks each component to its smallest neighbour, follows the hooks to their roots by pointer
    doubling, and contracts the links; a chain of n links takes about log2(n) doublings. Each round's
    tables are written to the shared folder, so a lost executor costs a task, not the rounds before.
    """
    edges = stored(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct())
    labels = stored(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("component", F.col("id")))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        hooks = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("root")))
        while True:
            up = hooks.select(F.col("id").alias("root"), F.col("root").alias("up"))
            jumped = stored(hooks.join(up, "root").select("id", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")))
            hooks = jumped.select("id", "root")
            if jumped.filter("moved").isEmpty():
                break
        labels = stored(labels.join(hooks.select(F.col("id").alias("component"), "root"), "component", "left").select("id", F.coalesce("root", "component").alias("component")))
        ra, rb = hooks.select(F.col("id").alias("a"), F.col("root").alias("ra")), hooks.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        edges = stored(edges.join(ra, "a").join(rb, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b").distinct())
    return labels
