"""Problem 4: one group identifier for every record linked directly or through others.

Method: the giant component is peeled by frontier breadth-first joins from the vertex of highest degree and joined
away; the remaining components are labelled by minimum propagation. Two additions keep the number of rounds small
whatever the length of a chain. The peeling stops after ``peel_rounds`` frontiers: what it has reached by then is
contracted into one vertex, so an unfinished peel is still exact. The minimum propagation also shortcuts parents until
they are roots and contracts the links to them, so a chain of n records takes about log2(n) shortcuts instead of n
rounds, at least half of the vertices are gone after each round, and finished components are not touched again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.session import is_empty, materialize


def _peel(both: DataFrame, start: str, peel_rounds: int) -> tuple[DataFrame, bool]:
    """Vertices within peel_rounds steps of start, and whether that is its whole component."""
    spark = both.sparkSession
    frontier = spark.createDataFrame([(start,)], "v string")
    reached = frontier
    for _ in range(peel_rounds):
        step = both.join(frontier, both.a == frontier.v, "left_semi").select(F.col("b").alias("v")).distinct()
        frontier = materialize(step.join(reached, "v", "left_anti"))
        if is_empty(frontier):
            return reached, True
        reached = reached.unionByName(frontier)
    return materialize(reached), False


def _roots(parents: DataFrame, max_rounds: int) -> DataFrame:
    """(v, p) with every parent replaced by the root it leads to; parents never lie after their children."""
    for _ in range(max_rounds):
        up = parents.select(F.col("v").alias("pv"), F.col("p").alias("g"))
        jumped = materialize(parents.join(up, F.col("p") == F.col("pv")).select("v", F.col("g").alias("q"), F.col("p").alias("old")))
        parents = jumped.select("v", F.col("q").alias("p"))
        if is_empty(jumped.where("q <> old")):
            return parents
    raise RuntimeError(f"parents still change after {max_rounds} shortcuts")


def _propagate(both: DataFrame, max_rounds: int) -> DataFrame:
    """(v, p): the smallest vertex of each vertex' component. Every vertex takes the smallest of itself and its neighbours
    for a parent, parents are followed to their roots, and links between roots go on; the smallest vertex of a component
    is its own parent in every round, so it is the root that is left."""
    labels = None
    for _ in range(max_rounds):
        if is_empty(both):
            return labels if labels is not None else both.select(F.col("a").alias("v"), F.col("b").alias("p"))
        near = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p")))
        roots = _roots(near, max_rounds)
        if labels is None:
            labels = roots
        else:
            moved = roots.select(F.col("v").alias("pv"), F.col("p").alias("g"))
            labels = materialize(labels.join(moved, F.col("p") == F.col("pv"), "left").select("v", F.coalesce("g", "p").alias("p")))
        to = roots.select(F.col("v").alias("x"), F.col("p").alias("y"))
        ends = both.where("a < b").join(to, F.col("a") == F.col("x")).select(F.col("y").alias("a"), "b").join(to, F.col("b") == F.col("x")).select("a", F.col("y").alias("b"))
        once = ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        both = materialize(once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    raise RuntimeError(f"links are left after {max_rounds} rounds")


def connected_groups(
    links: DataFrame, left: str, right: str, out_id: str = "file_name", out_group: str = "group_key", peel_rounds: int = 4, max_rounds: int = 64
) -> DataFrame:
    """(out_id, out_group): one row per record in at least one link; the group is named by its smallest record.

    Links with a null end, links of a record to itself and repeated links are ignored; an empty table gives an empty
    result. Only the two named columns are read, so further columns of any name do no harm. Degrees and minima are
    aggregated before the shuffle, so a hub that holds a third of all links is one row per task; its component is
    peeled before the propagation starts. Only a single vertex name ever reaches the driver.
    """
    ends = links.select(F.col(left).cast("string").alias("x"), F.col(right).cast("string").alias("y")).where("x is not null and y is not null and x <> y")
    once = ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    both = materialize(once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    top = both.groupBy("a").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "a")).alias("t")).first()["t"]
    if top is None:
        return both.select(F.col("a").alias(out_id), F.col("b").alias(out_group))
    reached, whole = _peel(both, top["a"], peel_rounds)
    giant = reached.agg(F.min("v")).first()[0]
    if whole:
        rest = both.join(reached, both.a == reached.v, "left_anti")
    else:  # contract what was reached into one vertex named by its minimum
        r1, r2 = reached.select(F.col("v").alias("v1")), reached.select(F.col("v").alias("v2"))
        rest = (
            both.join(r1, F.col("a") == F.col("v1"), "left")
            .join(r2, F.col("b") == F.col("v2"), "left")
            .select(F.when(F.col("v1").isNotNull(), F.lit(giant)).otherwise(F.col("a")).alias("a"), F.when(F.col("v2").isNotNull(), F.lit(giant)).otherwise(F.col("b")).alias("b"))
            .where("a <> b")
            .distinct()
        )
    labels = _propagate(materialize(rest), max_rounds)
    if not whole:
        named = labels.where(F.col("v") == F.lit(giant)).select("p").take(1)
        giant = named[0]["p"] if named else giant
        labels = labels.join(reached, "v", "left_anti")
    return labels.unionByName(reached.select("v", F.lit(giant).alias("p"))).select(F.col("v").alias(out_id), F.col("p").alias(out_group))
