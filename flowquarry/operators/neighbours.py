"""Mutual information of a continuous feature and a class by nearest neighbours (after Ross, 2014), over all rows.

Everything works on distinct (feature, value, class) cells with counts, which are made before the shuffle, so a value that a
third of the rows share is one cell. Neighbours come from blocks of the sorted cells with ``k`` cells of halo on both sides,
counts in a ball from running sums over the sorted values; no window holds a whole feature or class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowquarry.functions import columns as C
from flowquarry.operators.ordered import numbered, running_totals
from flowquarry.session import store_scratch

# A block is one task's share of the sorted cells: small enough that a few hundred thousand cells already keep many tasks busy.
BLOCK_ROWS = 50_000
_BEFORE, _POINT, _AFTER = 0, 1, 2


def digamma(n: Column) -> Column:
    """Digamma of a count of 1 or more: eight steps of the recurrence, then the asymptotic series."""
    x = n.cast("double") + 8
    y = 1 / (x * x)
    series = F.log(x) - 1 / (2 * x) - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
    for step in range(8):
        series = series - 1 / (n.cast("double") + step)
    return series


def neighbour_information(df: DataFrame, cols: list[str], label: Column, k: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mutual information (nats, not below 0) of each feature with the class: ``feature``, ``neighbour_information``.

    A point's radius is the distance to its ``k``-th neighbour of the same class (the farthest one in a class of ``k`` or
    fewer). With ``n`` points, ``c`` in the point's class, ``s`` of the class and ``m`` of all classes within the ball, itself
    included, the estimate is digamma(n) + mean(digamma(s) - digamma(c) - digamma(m)). A ball is open, so ``s`` is ``k`` where
    no distances tie; where ``k`` neighbours share the point's own value the ball is that value. No noise is added to break
    ties: a feature of few values gets the estimate of its contingency table.

    Null and non-finite values leave only their own feature; rows without a class and classes of one point are left out. A
    feature without points, and every feature of an empty table, gets 0. Repeated rows count each. ``label`` must have a
    bounded number of values, as classes have.
    """
    if not 1 <= k < block_rows:
        raise ValueError("k must be at least 1 and less than a block")
    finite = df.select(label.alias("_y"), *[C.finite(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(cols)]).filter("_y IS NOT NULL")
    # Positions stand for names; adding 0.0 makes the negative zero the same value as zero.
    cells = finite.unpivot("_y", [f"_{i}" for i in range(len(cols))], "f", "v").filter("v IS NOT NULL").groupBy(
        "f", (F.col("v") + F.lit(0.0)).alias("v"), "_y").agg(F.count(F.lit(1)).alias("n"))
    cells = store_scratch(cells, "neighbour-cells")
    classes = cells.groupBy("f", "_y").agg(F.sum("n").alias("c")).filter("c > 1")
    # Features x classes rows.
    cells = cells.join(F.broadcast(classes), ["f", "_y"])
    balls = store_scratch(_radii(cells, k, block_rows), "neighbour-balls")
    # A ball's ends are rounded, so it could miss a neighbour by the last bit; it holds the points of the class at least.
    inside = balls.join(_counts_in_balls(cells, balls, block_rows), ["f", "_y", "v"]).withColumn("m", F.greatest("m", "s"))
    terms = inside.groupBy("f").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * (digamma(F.col("s")) - digamma(F.col("c")) - digamma(F.col("m")))).alias("t"))
    scores = terms.select("f", F.greatest(F.lit(0.0), digamma(F.col("n")) + F.col("t") / F.col("n")).alias("score"))
    names = df.sparkSession.createDataFrame([(f"_{i}", c) for i, c in enumerate(cols)], "f string, feature string")
    # One row per feature.
    return names.join(scores, "f", "left").select("feature", F.coalesce("score", F.lit(0.0)).alias("neighbour_information"))


def _radii(cells: DataFrame, k: int, block_rows: int) -> DataFrame:
    """Cells with the radius ``r`` of their ball and ``s``, the points of the class inside it."""
    rows = numbered(cells, [F.col("f"), F.col("_y"), F.col("v")]).withColumn("_home", F.floor((F.col("_rn") - 1) / block_rows).cast("bigint"))
    place = F.pmod(F.col("_rn") - 1, F.lit(block_rows))
    near = F.array_compact(F.array(F.col("_home"), F.when(place < k, F.col("_home") - 1), F.when(place >= block_rows - k, F.col("_home") + 1)))
    spread = rows.withColumn("_block", F.explode(near))
    order = Window.partitionBy("_block", "f", "_y").orderBy("v")
    # The k nearest cells of the class are among k on either side; a cell stands for as many points as it holds, itself for one less.
    steps = [(step, i) for step in (F.lag, F.lead) for i in range(1, k + 1)]
    found = spread.withColumns({f"_d{j}": F.abs(step("v", i).over(order) - F.col("v")) for j, (step, i) in enumerate(steps)} | {
        f"_n{j}": step("n", i).over(order) for j, (step, i) in enumerate(steps)}).filter(F.col("_home") == F.col("_block"))
    away, own = [F.col(f"_d{j}") for j in range(len(steps))], F.col("n") - 1

    def points(test) -> Column:
        """Points of the class beside the point itself whose distance passes."""
        return sum((F.when(test(d), F.col(f"_n{j}")).otherwise(0) for j, d in enumerate(away)), own)

    kth = F.coalesce(F.least(*[F.when(points(lambda d, at=at: d <= at) >= k, at) for at in away]), F.greatest(*away), F.lit(0.0))
    found = found.withColumn("r", F.when(own >= k, 0.0).otherwise(kth))
    closer = points(lambda d: d < F.col("r")) + 1
    return found.select("f", "_y", "v", "n", "c", "r", F.when(F.col("r") == 0, F.col("n")).otherwise(closer).alias("s"))


def _counts_in_balls(cells: DataFrame, balls: DataFrame, block_rows: int) -> DataFrame:
    """Points of all classes within each ball, as the difference of two running counts at its ends."""
    here = F.col("r") == 0
    none = F.lit(None)
    points = cells.groupBy("f", "v").agg(F.sum("n").alias("n")).select(
        "f", F.col("v").alias("at"), F.lit(_POINT).alias("kind"), "n", none.cast("double").alias("v"), none.cast(balls.schema["_y"].dataType).alias("_y"), F.lit(0).alias("sign"))
    ends = balls.select("f", "v", "_y", F.explode(F.array(
        F.struct((F.col("v") - F.col("r")).alias("at"), F.when(here, _BEFORE).otherwise(_AFTER).alias("kind"), F.lit(-1).alias("sign")),
        F.struct((F.col("v") + F.col("r")).alias("at"), F.when(here, _AFTER).otherwise(_BEFORE).alias("kind"), F.lit(1).alias("sign")),
    )).alias("e")).select("f", "e.at", "e.kind", F.lit(0).cast("bigint").alias("n"), "v", "_y", "e.sign")
    order = [F.col("f"), F.col("at"), F.col("kind"), F.col("sign"), F.col("v"), F.col("_y")]
    totals = running_totals(points.unionByName(ends), order, {"so_far": F.col("n")}, block_rows)
    return totals.filter("sign <> 0").groupBy("f", "_y", "v").agg(F.sum(F.col("sign") * F.col("so_far")).alias("m"))
