"""Interaction of filters: what each removes in every order of application. DataFrame functions only.

A document's mask tells which filters it fails. In an order, it is removed at the step of the first filter of its mask.
Orders stand in lexicographic order, numbered by their Lehmer rank, so all orders with a common beginning are one interval
of ranks: for each mask and step, the beginnings whose last filter alone is in the mask cover a few intervals. The
documents are counted by part and mask, the counts are added at the ends of those intervals, and running sums over the
ranks give the removals of every order and step. Only counts are shuffled; their number follows parts and masks.

Cases: null texts count as empty; null parts as the empty string; a null doc_id comes after every other and matches no
label; labels that name a document more than once count if one of them says 1; rows equal in doc_id and text are not
copies of one another, for none has the smaller id; an empty table gives an empty table; only doc_id, text, the part and
the labels' doc_id, quality and toxic are read, so other columns do not clash.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from flowquarry.llm.text import let, words
from flowquarry.session import store_scratch

#: The last filter of the set is that of copies, which needs the whole table.
LETTERS = "ABCDE"
MEASURES = ("removed", "good_lost", "toxic_lost")


def text_failures(text: Column) -> Column:
    """Array of flags: which filters before the last a text fails, in order."""
    text = F.coalesce(text, F.lit(""))
    few_or_repeated = let(words(text), lambda w: F.array(F.size(w) < 200, 100 * F.size(F.array_distinct(w)).cast("bigint") < 50 * F.size(w).cast("bigint")))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return F.concat(few_or_repeated, F.array(100 * capitals.cast("bigint") > 2 * F.length(text).cast("bigint"), text.rlike(r"[#$%&*|]")))


def orders(letters: str) -> list[str]:
    """All orders, by Lehmer rank."""
    return ["".join(x) for x in itertools.permutations(letters)]


def interval_ends(letters: str) -> list[tuple[int, int, int, int]]:
    """(mask, step, rank, sign): where the intervals of ranks begin (1) and end (-1) in which a mask is removed at a step."""
    size, out = len(letters), []
    for mask in range(1, 1 << size):
        for step in range(1, size + 1):
            width, ends = math.factorial(size - step), {}
            # the beginnings of `step` filters follow one another in rank order
            for number, start in enumerate(itertools.permutations(range(size), step)):
                if mask >> start[-1] & 1 and not any(mask >> x & 1 for x in start[:-1]):
                    for rank, sign in ((number * width, 1), ((number + 1) * width, -1)):
                        ends[rank] = ends.get(rank, 0) + sign
            out += [(mask, step, rank, sign) for rank, sign in sorted(ends.items()) if sign and rank < math.factorial(size)]
    return out


def masks(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the filters they fail, filter i as bit i.

    Texts are read once. Of equal texts the rows of the smallest id pass the last filter; they are met by text and id
    together, so a text that many documents share is no hot key.
    """
    flags = F.transform(text_failures(F.col("text")), lambda x, i: F.when(x, F.call_function("shiftleft", F.lit(1), i)).otherwise(0))
    seen = store_scratch(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"), F.aggregate(flags, F.lit(0), lambda a, b: a + b).alias("mask")), "filter-masks")
    firsts = seen.groupBy(F.col("text_key").alias("first_key")).agg(F.min("doc_id").alias("least"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("of")).agg(
        *[F.max((F.coalesce(c, F.lit(0)) == 1).cast("bigint")).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))])
    counted = seen.groupBy("doc_id", "part", "text_key", "mask").agg(F.count("*").alias("n"))
    met = counted.join(firsts, (F.col("text_key") == F.col("first_key")) & F.col("doc_id").eqNullSafe(F.col("least")), "left")
    # rows without an id match no label, and are spread by their text
    keyed = met.withColumns({"key": F.coalesce("doc_id", F.xxhash64("text_key")), "no_id": F.col("doc_id").isNull()})
    known = keyed.join(marks.withColumn("never", F.lit(False)), (F.col("key") == F.col("of")) & (F.col("no_id") == F.col("never")), "left")
    last = F.when(F.col("first_key").isNull(), 1 << len(LETTERS) - 1).otherwise(0)
    of = lambda mark: F.sum(F.col("n") * F.coalesce(mark, F.lit(0))).alias(mark)
    return known.groupBy("part", (F.col("mask") + last).alias("mask")).agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The audit of every order and step, from documents counted by part and mask: (part, mask, n, good, toxic)."""
    spark, size = counts.sparkSession, len(letters)
    counts = store_scratch(counts, "filter-counts")
    # the ends follow from the number of filters alone: some hundreds of rows
    ends = F.broadcast(spark.createDataFrame(interval_ends(letters), "of_mask int, step int, rank int, sign int"))
    steps = counts.join(ends, counts["mask"] == ends["of_mask"]).select(
        "part", "step", "rank", *[(F.col("sign") * F.col(c)).alias(m) for c, m in zip(("n", "good", "toxic"), MEASURES, strict=True)])
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), *[F.sum(F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.col("n")).otherwise(0)).alias(f"fails_{c}") for i, c in enumerate(letters)],
                                       *[F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias(f"only_{c}") for i, c in enumerate(letters)])
    every = (parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step"))
             .select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(math.factorial(size) - 1))).alias("rank"), *[F.lit(0).cast("bigint").alias(m) for m in MEASURES]))
    summed = steps.unionByName(every).groupBy("part", "step", "rank").agg(*[F.sum(m).alias(m) for m in MEASURES])
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    removed = summed.select("part", "step", "rank", *[F.sum(m).over(along).alias(m) for m in MEASURES])
    order = F.element_at(F.array(*map(F.lit, orders(letters))), F.col("rank") + 1)
    placed = removed.withColumn("filter_order", order).withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    by_letter = Window.partitionBy("part", "letter")
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    of = lambda kind: F.coalesce(*[F.when(F.col("letter") == c, F.col(f"{kind}_{c}")) for c in letters])
    placed = placed.withColumn("shapley", F.sum("removed").over(by_letter)).withColumn("gone", F.sum("removed").over(so_far))
    return placed.join(parts, "part").select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), (F.col("total") - F.col("gone")).alias("kept"), "removed",
        (of("fails") - F.col("removed")).alias("redundant"), of("only").alias("unique_fails"), "good_lost", "toxic_lost", "shapley")
