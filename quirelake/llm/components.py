"""Connected components of a link table, by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node that can be reached.

    Each round takes the smallest label among the neighbours, folded in the map tasks, and then
    the label of that label, so paths shorten by halves. Each round is written to the shared
    folder, which cuts the lineage; links and labels stay distributed. Null ends are ignored.
    """
    both = staged(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"))
        .select("e.*")
        .distinct(),
        "links",
    )
    labels = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")).select(F.col("u").alias("node"), "l"), "labels")
    for _ in range(max_rounds):
        heard = both.join(labels, both["u"] == labels["node"]).groupBy("v").agg(F.min("l").alias("h"))
        near = labels.join(heard, labels["node"] == heard["v"]).select("node", F.col("l").alias("old"), F.least("l", "h").alias("l"))
        of = labels.select(F.col("node").alias("_n"), F.col("l").alias("_l"))
        labels = staged(near.join(of, near["l"] == of["_n"]).select("node", "old", F.least("l", "_l").alias("l")), "labels")
        moved = labels.where("old <> l").limit(1).count()
        labels = labels.select("node", "l")
        if not moved:
            return labels.select("node", F.col("l").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
