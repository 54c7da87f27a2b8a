"""Connected components of an edge table by minimum labels with pointer jumping.

Every vertex takes the smallest label among itself and its neighbours, then the label of its label.  The round
repeats until no label changes.  All state lives in tables: each round is two equi-joins and one aggregation with
map-side combine (a hub's edges are reduced before they travel), and its result is written to the shared scratch
folder, so lineage stays one round deep.  Nothing but the number of changed labels reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.llm._scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every vertex that has an edge; ``component`` is the smallest vertex reachable."""
    one_way = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    both = scratch.save(one_way.union(one_way.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = scratch.save(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("n")).select("node", F.least("node", "n").alias("label")), "labels")
    while True:
        around = both.join(labels, both.v == labels.node).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("best"))
        met = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "best").alias("label"))
        up = labels.select(F.col("node").alias("p"), F.col("label").alias("p_label"))
        stepped = scratch.save(
            met.join(up, F.col("label") == F.col("p")).select("node", F.least("label", "p_label").alias("label"), "old"), "labels"
        )
        changed = stepped.where("label <> old").limit(1).count()
        scratch.drop(labels)
        labels = stepped
        if not changed:
            scratch.drop(both)
            return labels.select("node", F.col("label").alias("component"))


def chained(edges: DataFrame, leaf: str = "a", head: str = "b") -> DataFrame:
    """Edges ``(a, b)`` that join what ``edges`` join, of which every leaf has few: one to a leaf's first head, and a chain of its heads.

    The leaves of one group share their heads, so their chains are the same few edges, and about one edge a leaf remains.
    """
    heads = F.sort_array(F.collect_set(head))
    own = edges.where(F.col(leaf) != F.col(head)).groupBy(F.col(leaf).alias("leaf")).agg(heads.alias("heads"))
    before = lambda i: F.when(i == 0, F.col("leaf")).otherwise(F.get("heads", i - 1))
    links = F.transform(F.sequence(F.lit(0), F.size("heads") - 1), lambda i: F.struct(before(i).alias("a"), F.get("heads", i).alias("b")))
    return own.select(F.explode(links).alias("e")).select("e.a", "e.b").distinct()
