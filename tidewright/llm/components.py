"""Connected components by repeated joins: hooking and shortcutting of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def components(links: DataFrame) -> DataFrame:
    """``(id, label)``: the smallest id reachable over ``links`` (``a``, ``b``), for each id in a link.

    Each round, along every link the higher label's own vertex and the vertex at its
    end take the lower label, then labels are followed one step; rounds grow as the
    logarithm of the size.  Every round is written to the shared folder, and minima
    are taken before the shuffle, so a vertex with very many links is no hot key.
    """
    pairs = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    pairs = cut(pairs)
    labels = cut(pairs.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("label")))
    while True:
        at_a = labels.select(F.col("id").alias("a"), F.col("label").alias("la"))
        at_b = labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        lower = pairs.join(at_a, "a").join(at_b, "b").where(F.col("lb") < F.col("la"))
        moves = lower.select(F.explode(F.array("a", "la")).alias("id"), "lb").groupBy("id").agg(F.min("lb").alias("lb"))
        hooked = labels.join(moves, "id", "left").select("id", F.least("label", F.coalesce("lb", "label")).alias("label"), F.col("lb").isNotNull().alias("moved"))
        hooked = cut(hooked)
        step = hooked.select(F.col("id").alias("label"), F.col("label").alias("next"))
        after = cut(hooked.join(step, "label", "left").select("id", F.least("label", F.coalesce("next", "label")).alias("label"), (F.col("moved") | (F.col("next") < F.col("label"))).alias("moved")))
        labels = after.select("id", "label")
        if not after.where("moved").limit(1).count():
            return labels
