"""Connected components of an edge table by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop_table, materialize

MAX_ROUNDS = 200


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, label (the smallest node of its component) for every node of edges(x, y) of one type.

    With a number of rounds, labels are as good as these make them: nodes of one label are connected, but
    parts of a component far from each other may still have labels of their own.

    Every round takes the smallest label among a node's neighbours and then its label's label, so that
    long chains shrink as fast as stars. The edges are planned once: both directions come from one
    explode. Both sides of each join are written tables, whose hot keys can be split at run time.
    """
    ways = F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y")), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    both = materialize(edges.where("x <> y").select(F.explode(ways).alias("e")).select("e.x", "e.y").distinct(), "both")
    labels = materialize(both.groupBy(F.col("x").alias("node")).agg(F.least(F.first("x"), F.min("y")).alias("label")), "labels")
    for _ in range(rounds or MAX_ROUNDS):
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        near = materialize(near.join(labels, "node").select("node", "label", F.least("label", "near").alias("next")), "near")
        jump = near.select(F.col("node").alias("next"), F.col("next").alias("far"))
        step = materialize(near.join(jump, "next").select("node", F.col("far").alias("label"), (F.col("far") < F.col("label")).alias("moved")), "step")
        drop_table(near, labels)
        labels = step
        if rounds is None and step.where("moved").isEmpty():
            break
    else:
        if rounds is None:
            raise RuntimeError("components did not settle")
    drop_table(both)
    out = labels.select("node", "label")
    out._sparkloom_path = labels._sparkloom_path
    return out
