"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


JUMPS = 2


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (node, label) with every label lowered to the least of its component.

    ``links`` (a, b) join nodes. Each turn takes the least label among the
    neighbours, hands it to the node that gave the old label (hooking) and
    shortens the path (pointer jumping), so turns grow with the logarithm of a
    component's diameter. Every turn is written to the shared folder. Labels
    must be unique among the nodes at the start; rows never leave the executors.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct())
    state = written(nodes.select("node", "label"))
    while True:
        near = (both.join(state, both["b"] == state["node"])
                .groupBy("a").agg(F.min("label").alias("least")))
        lowered = (state.join(near, state["node"] == near["a"], "left")
                   .select("node", F.col("label").alias("old"), F.least("label", "least").alias("label")))
        lowered = written(lowered)
        if lowered.where("label < old").isEmpty():
            return state
        hooks = lowered.groupBy("old").agg(F.min("label").alias("best"))
        for _ in range(JUMPS):
            ahead = hooks.select(F.col("old").alias("best"), F.col("best").alias("further"))
            hooks = (hooks.join(ahead, "best")
                     .select("old", F.col("further").alias("best")))
        state = written(lowered.join(hooks, "old").select("node", F.col("best").alias("label")))
