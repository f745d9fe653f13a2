"""Connected components of a link table by joins: hooking to the least neighbouring label, then shortcuts.

In each round every vertex and every current label takes the least label across its links, and labels then point to the labels
of their labels; rounds grow with the logarithm of a component's diameter. Labels are written to the shared checkpoint folder each
round, few links in few files. Partial minima keep a vertex of very many links from filling one task, and vertices of one label are dealt
to many tasks where they are very many (``common.dealt_join``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, dealt_join, hot_keys, tasks_for


def component_labels(links: DataFrame) -> DataFrame:
    """vertex, label (the least vertex of its component) of every vertex of the links (columns a, b; longs, either order)."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    tasks = tasks_for(both.count())
    labels = cut(both.groupBy(F.col("a").alias("vertex")).agg(F.least("a", F.min("b")).alias("label")).select("vertex", "label"), tasks)
    vertices = labels.count()
    while True:
        la = labels.select(F.col("vertex").alias("a"), F.col("label").alias("la"))
        lb = labels.select(F.col("vertex").alias("b"), F.col("label").alias("lb"))
        seen = both.join(la, "a").join(lb, "b").where(F.col("la") != F.col("lb"))
        offers = seen.select(F.explode(F.array("a", "la")).alias("vertex"), F.col("lb").alias("offer"))
        best = offers.groupBy("vertex").agg(F.min("offer").alias("offer"))
        hooked = labels.join(best, "vertex", "left").select("vertex", F.least("label", F.coalesce("offer", "label")).alias("near"), F.col("label").alias("old"))
        target = hooked.select(F.col("vertex").alias("near"), F.col("near").alias("far"))
        hot = hot_keys(hooked.groupBy("near").agg(F.count(F.lit(1)).alias("n")), "near", "n", vertices)
        jumped = cut(dealt_join(hooked, target, "near", hot, F.xxhash64("vertex")).select("vertex", F.least("near", "far").alias("label"), "old"), tasks)
        changed = jumped.where(F.col("label") != F.col("old")).limit(1).count()
        labels = jumped.select("vertex", "label")
        if not changed:
            return labels
