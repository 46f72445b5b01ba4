"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every end of the links (a, b).

    Labels go to neighbours and then jump to the label of their label, so the rounds grow with the logarithm of the longest path. Each round is
    written to the shared folder. Links with a null end are ignored.
    """
    links = links.where("a is not null and b is not null and a <> b").select("a", "b")
    both = materialise(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        heard = both.join(label, F.col("b") == F.col("id")).groupBy(F.col("a").alias("_to")).agg(F.min("component").alias("_low"))
        near = label.join(heard, F.col("id") == F.col("_to")).select("id", F.col("component").alias("_was"), F.least("component", "_low").alias("component"))
        jump = near.select(F.col("id").alias("_at"), F.col("component").alias("_next"))
        new = materialise(near.join(jump, F.col("component") == F.col("_at"), "left").select("id", "_was", F.least("component", F.coalesce("_next", "component")).alias("component")), "labels")
        if new.where("component <> _was").isEmpty():
            return new.select("id", "component")
        label = new.drop("_was")
