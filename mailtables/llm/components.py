"""Connected components of a table of links, by contraction."""

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """``node, root`` for every end of a link; ``root`` is one node of the component, the same for all.

    ``links`` has the columns ``a`` and ``b``. In each round every node points to the first of its
    neighbours and itself, and links are drawn anew between the nodes pointed to. First is, in turn, the
    node with most links, which takes in the members of stars at once, and the one with the smallest hash, each
    round with a hash of its own: then a chain loses a constant share of its nodes on average, so that
    rounds grow with the logarithm of a component's size. First neighbours come from a partial
    aggregate, and all joins are between stored tables, where Spark can split the rows of a node with very
    many links.
    """
    links = stored(links.filter("a <> b").select("a", "b").distinct(), "links")
    found = None
    for turn in range(most):
        if links.isEmpty():
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nodes = stored(both.groupBy("a").agg((-F.count("*")).alias("h")), "nodes")
        if turn % 2:
            nodes = nodes.withColumn("h", F.xxhash64(F.lit(turn), "a"))
            both = both.withColumn("h", F.xxhash64(F.lit(turn), "b"))
        else:
            both = both.join(nodes.withColumnRenamed("a", "b"), "b")
        first = F.min(F.struct("h", F.col("b").alias("m"))).alias("first")
        near = both.select("a", "b", "h").unionByName(nodes.select("a", F.col("a").alias("b"), "h"))
        step = stored(near.groupBy("a").agg(first).select("a", "first.m"), "steps")
        if found is None:
            found = step.toDF("node", "root")
        else:
            # Folded at once, so that plans do not grow with the rounds.
            further = found.join(step.toDF("root", "_next"), "root", "left")
            found = stored(further.select("node", F.coalesce("_next", "root").alias("root")), "components")
        ends = links.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b").filter("x <> y")
        links = stored(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    else:
        raise RuntimeError("links are left after the last round")
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
