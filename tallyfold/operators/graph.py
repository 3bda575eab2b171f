"""Connected components by alternating large-star and small-star steps, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.plans.materialize import discard, materialize


#: Edges of a node beyond which its rows are not dealt out by the node.
HOT = 1 << 20


def _beside(both: DataFrame, low: DataFrame, edges: int, hot: int) -> DataFrame:
    """both with m of low, by u. Nodes of more than `hot` edges are 2 * edges / hot at most: they are sent to their rows."""
    if 2 * edges <= hot:
        return both.join(low.select("u", "m").hint("merge"), "u")
    crowded = F.broadcast(low.where(F.col("n") > hot).select("u", "m"))
    rest = low.where(F.col("n") <= hot).select("u", "m")
    return both.join(crowded, "u").unionByName(both.join(crowded, "u", "left_anti").join(rest.hint("merge"), "u"))


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 60, hot: int = HOT) -> DataFrame:
    """Label every node of an undirected graph with the smallest node id it reaches.

    edges: src, dst (any one orderable type). Null ends and self loops are ignored; repeated edges count once;
    an empty input gives an empty result; other columns are ignored. Returns node, component for each node that
    has an edge. The number of rounds is logarithmic in the size of the largest component; each round is two joins, of
    which the one that a large star would crowd sends its centre's row instead, and is written to the shared folder.
    """
    current = materialize(
        edges.select("src", "dst")
        .where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct(),
        "edges",
    )
    state = _digest(current)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = current.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionAll(current.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _beside(both, low, state[0], hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root.hint("merge"), "u").where("v <> m").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        after = materialize(small.unionAll(root.select(F.col("u").alias("src"), F.col("m").alias("dst"))).distinct(), "edges")
        discard(current)
        current, before, state = after, state, _digest(after)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = current.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return leaves.unionAll(roots)
