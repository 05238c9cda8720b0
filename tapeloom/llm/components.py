"""Connected components of an edge table, by least neighbours and pointer jumping.

Every round is a written table in the shared folder, so a lost executor costs a re-read, and nothing
of the graph passes through the driver but one count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeloom.sources.sinks import stage


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node of ``edges`` with the least node it is connected to.

    Edges may repeat and may be loops; an empty table gives an empty table.
    """
    # written before both directions are read from it, so that every link has its reverse
    pairs = stage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "pairs")
    links = stage(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    roots = stage(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root"), F.lit(True).alias("moved")), "roots")
    while roots.where("moved").limit(1).count():
        near = links.join(roots.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        hooked = stage(
            roots.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root")), "hooked")
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        # the root of a node is a node itself
        roots = stage(hooked.join(above, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("was")).alias("moved")), "roots")
    return roots.select("node", "root")
