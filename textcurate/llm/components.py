"""Connected components of a link table by hooking and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component), the smallest node reachable.

    In each round every component takes the smallest label that any neighbour of any
    of its nodes has, for all its nodes at once, and then that label's own new label.
    So components at least merge in pairs, and the number of rounds grows with the
    logarithm of the nodes, on long chains too. All are partial aggregations and
    equi-joins, so a hub costs no more than its links. Labels only fall; rounds end
    when none changes. Every round's labels are a Parquet table in the checkpoint folder,
    which few tasks read again while they are few."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                   .filter("a <> b").distinct(), "both")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("component")), "labels")
    while True:
        of = labels.select(F.col("node").alias("o_node"), F.col("component").alias("o_component"))
        lowest = both.join(of, F.col("b") == F.col("o_node")).groupBy(F.col("a").alias("l_node")).agg(
            F.min("o_component").alias("low"))
        moved = labels.join(lowest, F.col("node") == F.col("l_node")).select(
            "node", "component", F.least("component", "low").alias("next"))
        roots = written(moved.groupBy(F.col("component").alias("root")).agg(F.min("next").alias("to")), "roots")
        twice = roots.select(F.col("root").alias("r_root"), F.col("to").alias("r_to"))
        target = roots.join(twice, F.col("to") == F.col("r_root"), "left").select("root", F.coalesce("r_to", "to").alias("to"))
        jump = labels.join(target, F.col("component") == F.col("root")).select(
            "node", F.col("component").alias("was"), F.col("to").alias("component"))
        jump = written(jump, "labels")
        changed = jump.filter("component <> was").limit(1).count()
        labels = jump.select("node", "component")
        if not changed:
            return labels
