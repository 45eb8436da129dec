"""Connected components of a link table, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark.llm.common import drop, stage


def _flat(hooks: DataFrame) -> tuple[DataFrame, str]:
    """hooks (node, root) with root < node: each node with the end of its chain, by pointer jumping, two steps a pass."""
    spark = hooks.sparkSession
    now, path = stage(hooks, "hooks")
    while True:
        above = now.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        further = now.select(F.col("node").alias("_next"), F.col("root").alias("_last"))
        jumped = now.join(above, "root", "left").join(further, "_next", "left")
        nxt, new = stage(jumped.select("node", F.coalesce("_last", "_next", "root").alias("root"), F.col("_last").isNotNull().alias("_moved")), "hooks")
        moved = not nxt.filter("_moved").isEmpty()
        drop(spark, path)
        now, path = nxt.drop("_moved"), new
        if not moved:
            return now, path


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root): for each node of a link but the smallest of its component, that smallest node.

    Every node hooks to its smallest neighbour below it, chains are flattened, links are contracted to the
    ends of the chains, and again until no link is left: a logarithmic number of rounds, each a few
    aggregations that combine before the shuffle.
    """
    spark = links.sparkSession
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges, at = stage(edges, "links")
    found: DataFrame | None = None
    while not edges.isEmpty():
        hooks, _ = _flat(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")))
        if found is None:
            found = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            found, _ = stage(found.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root")).unionByName(hooks), "roots")
        for end in ("hi", "lo"):
            to = hooks.select(F.col("node").alias(end), F.col("root").alias("_to"))
            edges = edges.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        edges = edges.filter("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct()
        edges, new = stage(edges, "links")
        drop(spark, at)
        at = new
    drop(spark, at)
    return found if found is not None else spark.createDataFrame([], "node long, root long")
