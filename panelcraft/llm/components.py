"""Connected components of an edge table, as joins and aggregates; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcraft.llm.store import Scratch

MAX_ROUNDS = 100


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root (the smallest node of its component), for every node of ``edges`` (a, b).

    Each round every node points to its smallest neighbour, pointers are jumped twice, and the edges and roots
    are rewritten; an edge whose ends have met is dropped.  A path shrinks fourfold a round."""
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b")
    live = scratch.save(both.distinct(), f"{name}-edges-0")
    roots = None
    for i in range(1, MAX_ROUNDS):
        up = live.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        for _ in range(2):
            nxt = up.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            up = up.join(nxt, "p", "left").select("a", F.coalesce("pp", "p").alias("p"))
        up = scratch.save(up, f"{name}-up-{i}")
        if roots is None:
            roots = up.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            roots = (roots.join(up, roots.root == up.a, "left")
                     .select("node", F.coalesce("p", "root").alias("root")))
        left = up.select("a", F.col("p").alias("pa"))
        right = up.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        live = scratch.save(live.join(left, "a").join(right, "b").where("pa <> pb")
                            .select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), f"{name}-edges-{i}")
        done = live.isEmpty()
        roots = scratch.save(roots, f"{name}-roots" if done else f"{name}-roots-{i}")
        scratch.drop(f"{name}-edges-{i - 1}", f"{name}-up-{i}", f"{name}-roots-{i - 1}")
        if done:
            scratch.drop(f"{name}-edges-{i}")
            return roots
    raise RuntimeError("components did not settle")
