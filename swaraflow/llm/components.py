"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for each node of ``edges`` (``a, b``, either order, any orderable type).

    Each round points every node at the least of its neighbours and itself,
    follows the pointers once more, and keeps only the links that still join
    different pointers, so the link table shrinks from round to round.  All
    state is in tables; the driver sees one count a round.  ``root`` is the
    least node of the component.  No links give no rows.
    """
    links = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    labels = None
    for _ in range(rounds):
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        jump = near.select(F.col("a").alias("q"), F.col("p").alias("pp"))
        near = materialize(near.join(jump, near.p == jump.q).select("a", F.col("pp").alias("p")), "pointers")
        if labels is None:
            labels = near.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            labels = materialize(
                labels.join(near, labels.root == near.a, "left").select("node", F.coalesce("p", "root").alias("root")), "labels"
            )
        pa = near.select(F.col("a").alias("ka"), F.col("p").alias("ra"))
        pb = near.select(F.col("a").alias("kb"), F.col("p").alias("rb"))
        links = materialize(
            links.join(pa, links.a == pa.ka)
            .join(pb, links.b == pb.kb)
            .filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "links",
        )
        if links.isEmpty():
            return labels
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
