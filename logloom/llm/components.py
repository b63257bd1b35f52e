"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST, fewer, materialise

#: Rows of a partition.
ROWS = 200_000


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """A side below a fixed size goes to every task, a larger one is shuffled."""
    return F.broadcast(df) if rows <= BROADCAST else df


def contract(edges: DataFrame) -> list[DataFrame]:
    """Tables (node, up), one for each round: every node of a round's edges (a, b; both ways, a <> b) and the node of its component that stands for it.

    In a round a node goes to the first of itself and its neighbours in some order, and three such steps on; edges are then between those that
    are left.  In every other round the order is random (a hash with the round's number): on a path a third of the nodes are left then, in any graph on
    average half at most, so that rounds grow with the logarithm of the nodes, whatever their labels.  In the others nodes with more
    neighbours come first: a star, which groups of copies with a hub are, is gone at once.  Each round is smaller than the one before.
    """
    rounds, n = [], edges.count()
    while n:
        number = len(rounds)

        def drawn(c: str, degree: Column, number: int = number) -> Column:
            return F.struct((-degree).alias("d"), F.xxhash64(F.lit(number), F.col(c)).alias("h"), F.col(c).alias("n"))

        zero = F.lit(0).cast("long")
        if number % 2:
            near = edges.withColumn("d", zero)
        else:
            degrees = materialise(fewer(edges.groupBy("a").agg(F.count("*").alias("d")), n, ROWS))
            of_b = _sent(degrees.select(F.col("a").alias("__b"), "d"), degrees.count())
            near = edges.join(of_b, F.col("b") == F.col("__b"))
        least = near.groupBy("a").agg(F.min(drawn("b", F.col("d"))).alias("m"), F.count("*").alias("own"))
        own = drawn("a", zero if number % 2 else F.col("own"))
        up = materialise(fewer(least.select(F.col("a").alias("node"), F.when(F.col("m") < own, F.col("m.n")).otherwise(F.col("a")).alias("up")), n, ROWS))
        nodes = up.count()
        over = _sent(up.select(F.col("node").alias("__n"), F.col("up").alias("__up")), nodes)
        for _ in range(2):
            up = up.join(over, F.col("up") == F.col("__n")).select("node", F.col("__up").alias("up"))
        up = materialise(fewer(up, nodes, ROWS))
        rounds.append(up)
        a, b = (_sent(up.select(F.col("node").alias(f"__{c}"), F.col("up").alias(f"__up_{c}")), nodes) for c in "ab")
        left = edges.join(a, F.col("a") == F.col("__a")).join(b, F.col("b") == F.col("__b")).select(F.col("__up_a").alias("a"), F.col("__up_b").alias("b"))
        edges = materialise(fewer(left.filter("a <> b").distinct(), n, ROWS))
        n = edges.count()
    return rounds


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of the links (a, b): label is the smallest node of the component.

    Rounds of contraction are written to the shared folder and put together from the last one back; only counts reach the
    driver.  Null ends are ignored.
    """
    found = links.filter("a IS NOT NULL AND b IS NOT NULL")
    both = materialise(found.select("a", "b").union(found.select("b", "a")).distinct())
    roots, rows = None, 0
    for up in reversed(contract(both.filter("a <> b"))):
        if roots is not None:
            above = _sent(roots.select(F.col("node").alias("__n"), F.col("up").alias("__up")), rows)
            up = materialise(up.join(above, F.col("up") == F.col("__n"), "left").select("node", F.coalesce("__up", "up").alias("up")))
        roots, rows = up, up.count()
    nodes = both.select(F.col("a").alias("node")).distinct()
    if roots is None:
        return nodes.select("node", F.col("node").alias("label"))
    least = _sent(materialise(roots.groupBy(F.col("up").alias("__root")).agg(F.min("node").alias("label"))), rows)
    labels = roots.join(least, F.col("up") == F.col("__root")).select(F.col("node").alias("__n"), "label")
    return materialise(nodes.join(_sent(labels, rows), F.col("node") == F.col("__n"), "left").select("node", F.coalesce("label", "node").alias("label")))
