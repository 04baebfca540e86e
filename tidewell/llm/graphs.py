"""Connected components of large sparse graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import joined_with_hot, stage


def components(links: DataFrame, n_links: int | None = None) -> DataFrame:
    """node, root of links (a, b): root is the smallest node of the component.  Nodes without links don't occur.

    Rounds of contraction: every node points to its smallest neighbour, or itself; pointers are
    followed to their ends; links then join what is left.  Each round at least halves the nodes that
    still have links, and each is cut off by a written table.  The hub of a star may be on a third of the links, so joins send
    such nodes to all tasks.  ``n_links`` bounds the number of links, if it is known.
    """
    edges = stage(links.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "links", n_links)
    nodes = 2 * edges.count()
    roots = None  # node, root so far
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to"))
        up = stage(up, "up", nodes)
        while True:
            on = up.select(F.col("node").alias("to"), F.col("to").alias("next"))
            nearer = stage(joined_with_hot(up, on, ["to"], nodes).select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "up", nodes)
            moved = nearer.filter("moved").limit(1).count()
            up = nearer.drop("moved")
            if not moved:
                break
        if roots is None:
            roots = up.select("node", F.col("to").alias("root"))
        else:
            step = up.select(F.col("node").alias("root"), "to")
            roots = stage(roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots", nodes)
        end = lambda x: up.select(F.col("node").alias(x), F.col("to").alias(f"{x}_to"))
        edges = stage(joined_with_hot(joined_with_hot(edges, end("a"), ["a"], nodes), end("b"), ["b"], nodes).filter(F.col("a_to") != F.col("b_to")).select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct(), "links", nodes)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots
