"""Connected components of an undirected link table, by minimum labels and pointer jumping.

Labels and links stay distributed; each round stores its labels in the shared checkpoint folder and
only one number (how many labels moved) reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of every id that has a link; ``component_id`` is the smallest id reachable.

    Direction, repeats and self-links do not matter; an empty link table gives no rows.  A round takes
    the smallest label among the neighbours and then follows that label's own label, so a chain
    of n links needs about log(n) rounds.
    """
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = durable(one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = durable(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "id"))
    while True:
        near = both.join(labels, both.v == labels.id).groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        moved = durable(lower.join(far, "label", "left").select(
            "id", "was", F.least("label", F.coalesce("far", "label")).alias("label")))
        changed = moved.where("was <> label").limit(1).count()
        labels = moved.select("id", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component_id")
