"""Mixing sources to target weights by Sainte-Laguë apportionment of equal word blocks.

Sources share the mix by weight; a target stops at ``most`` times its source and the excess is shared again by weight.
The mix is cut into blocks of equal size. Parties are the shards of the sources, with votes in proportion to their
source's target; every block goes to the highest quotient votes / (2 * seats + 1). A divisor d with
sum(round(votes / d)) = blocks gives the same seats, and is found by sums over the shards alone, many trial divisors in
one pass, so no list of quotients is ever gathered. In each shard documents stand in a seeded order, are cut into blocks
end to end, and the words of the shard's seats take whole copies of it, then its first words in that order.

Cases: null and empty texts have size 0 and give nothing; a null source is a source of its own, after all others; equal
rows are rows of their own; ties of quotients are broken by a seeded hash; an empty table gives an empty table; columns
named like those made here do not clash, as only doc_id, source and text are read.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from flowquarry.llm.text import word_count
from flowquarry.session import cut_lineage

BLOCK_WORDS = 32
#: Rows of a shard, about. Shards bound what one window holds.
SHARD_ROWS = 50_000
TRIALS = 64


def _is(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row per source: source, source_size, source_rows, target.

    ``weights`` go round the sources in code-point order, null last. Sources above their limit are fixed there, and what
    is left is shared among the others by weight, until none is above. Each round brings three sums to the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1  # one narrow row per source
    cycle = F.array(*map(F.lit, weights))
    totals = cut_lineage(totals.withColumn("weight", F.get(cycle, place % len(weights)).cast("double")))
    limit = F.col("source_size") * most
    share = None
    while True:
        full = F.lit(False) if share is None else F.col("weight") * share >= limit
        free, held, every = totals.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, limit)), F.sum("source_size")).first()
        left = (every or 0) - (held or 0)
        if not free or not every:
            break
        following = left / free
        if share is not None and following <= share * (1 + 1e-15):
            break
        share = following
    target = F.least(F.col("weight") * (share or 0.0), limit.cast("double"))
    return totals.select("source", "source_size", "source_rows", target.alias("target"))


def sainte_lague(parties: DataFrame, votes: str, seats: int) -> DataFrame:
    """Adds BIGINT ``seats`` to the parties: the highest ``seats`` quotients votes / (2 * k + 1), equal ones by ``tie``.

    The divisor is bracketed by the seat totals of TRIALS divisors a pass; what goes to the driver is those totals.
    A column ``tie`` in [0, 1) sets equal quotients apart by less than a millionth of a vote share.
    """
    vote = F.col(votes) * (1 + F.col("tie") * 1e-9)
    got = lambda divisor: F.floor(vote / divisor + 0.5)
    total = parties.agg(F.sum(vote)).first()[0] or 0.0
    if seats <= 0 or total <= 0:
        return parties.withColumn("seats", F.lit(0).cast("bigint"))
    low, high = total / seats / 4, total / seats * 4
    best = low
    for _ in range(12):
        step = (high / low) ** (1 / (TRIALS - 1))
        trials = [low * step ** i for i in range(TRIALS)]
        sums = parties.agg(*[F.sum(got(d)).alias(f"d{i}") for i, d in enumerate(trials)]).first()
        if seats in sums:
            best = trials[sums.index(seats)]
            break
        above = max([i for i, n in enumerate(sums) if n > seats], default=0)
        if above == 0 and sums[0] < seats:
            high, low = low, low / 64
        elif above == TRIALS - 1:
            low, high = high, high * 64
        else:
            low, high = trials[above], trials[above + 1]
        best = high  # never more than the seats, if the divisor's digits run out
        if high / low - 1 < 4e-16:
            break
    return parties.withColumn("seats", got(best).cast("bigint"))


def mix(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 7, block: int = BLOCK_WORDS) -> DataFrame:
    """``sizes`` (doc_id, source, size, and other columns) with source_size, target, taken, full_copies, cut_words.

    ``taken`` words of a row are ``full_copies`` of it and its first ``cut_words``. ``sizes`` is made once, from the texts.
    """
    sizes = cut_lineage(sizes)
    targets = source_targets(sizes, weights, most)
    shards = F.ceil(F.col("source_rows") / SHARD_ROWS)
    known = sizes.join(targets, _is(sizes["source"], targets["source"])).drop(targets["source"])
    order = F.xxhash64(F.lit(seed), "doc_id", "size")
    dealt = cut_lineage(known.withColumn("order_key", order).withColumn("shard", F.pmod(F.xxhash64("order_key"), shards)))
    parties = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("party_source_size"), F.first("target").alias("party_target"))
    parties = cut_lineage(parties.where("shard_size > 0").withColumn("votes", F.col("party_target") * F.col("shard_size") / F.col("party_source_size"))
                          .withColumn("tie", F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.lit(1 << 20)) / float(1 << 20)))
    every = parties.agg(F.sum("votes")).first()[0] or 0.0
    seats = sainte_lague(parties, "votes", math.floor(every / block + 0.5))
    quota = F.least(F.col("seats") * block, F.col("shard_size") * most)  # in words, as a shard's last block may be a short one
    rounds = F.floor(quota / F.col("shard_size"))
    quotas = seats.select(F.col("source").alias("party_source"), F.col("shard").alias("party_shard"), rounds.alias("rounds"), (quota - rounds * F.col("shard_size")).alias("rest_words"))
    row = Window.partitionBy("source", "shard").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("before", F.coalesce(F.sum("size").over(row), F.lit(0)))
    out = placed.join(quotas, _is(placed["source"], quotas["party_source"]) & (placed["shard"] == quotas["party_shard"]), "left")
    copies = F.coalesce(F.col("rounds"), F.lit(0))
    part = F.greatest(F.least(F.coalesce(F.col("rest_words"), F.lit(0)) - F.col("before"), F.col("size")), F.lit(0))
    whole = part == F.col("size")
    return (out.withColumn("taken", (copies * F.col("size") + part).cast("bigint"))
            .withColumn("full_copies", F.when(F.col("size") > 0, copies + F.when(whole, 1).otherwise(0)).otherwise(0).cast("bigint"))
            .withColumn("cut_words", F.when(whole, 0).otherwise(part).cast("bigint"))
            .drop("order_key", "shard", "before", "party_source", "party_shard", "rounds", "rest_words", "source_rows"))


def document_sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))


@F.pandas_udf(StringType())
def first_words(texts: pd.Series, counts: pd.Series) -> pd.Series:
    """The first words of each text, with the space between them as it stands."""
    def cut(text: str, count: int) -> str:
        data, at = text.encode(), 0
        for word in data.split(None, int(count))[:int(count)]:
            at = data.index(word, at) + len(word)
        return data[:at].decode()
    return pd.Series([cut(t, n) for t, n in zip(texts, counts, strict=True)], dtype=object)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: as many rows of a document as full copies, and one row of its first words where it is cut.

    Same columns as ``docs``; n_chars, where there is one, follows a cut text. Rows equal in doc_id, source and text are
    copies of one another: their copies are counted together.
    """
    names = docs.columns
    keyed = docs.select(*names, F.xxhash64("text").alias("__text_key"))
    plan = mix(keyed.select("doc_id", "source", "__text_key", word_count(F.col("text")).alias("size")), **options)
    # equal rows stand side by side in one shard, and a shard cuts one row at most
    plan = cut_lineage(plan.groupBy(*[F.col(c).alias(f"__of_{c}") for c in ("doc_id", "source", "__text_key")]).agg(
        F.count("*").alias("__rows"), F.sum("full_copies").alias("__full"), F.max("cut_words").alias("__cut")).where("__full > 0 or __cut > 0"))

    same = _is(F.col("doc_id"), F.col("__of_doc_id")) & _is(F.col("source"), F.col("__of_source")) & (F.col("__text_key") == F.col("__of___text_key"))

    def taken(rows: DataFrame, of: DataFrame) -> DataFrame:
        both = rows.join(of, same).select(*names, "__full", "__cut")
        copies = F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.col("__full").cast("int")),
                          F.when(F.col("__cut") > 0, F.array("__cut")).otherwise(F.array().cast("array<bigint>")))
        return both.select(*names, F.explode(copies).alias("__keep"))

    single = taken(keyed, plan.where("__rows = 1"))
    again = plan.where("__rows > 1")
    both = single
    if not again.isEmpty():  # else the texts need not be moved a second time
        both = single.unionByName(taken(keyed.join(again, same, "left_semi").dropDuplicates(["doc_id", "source", "__text_key"]), again))
    cut = F.when(F.col("__keep") > 0, first_words("text", "__keep")).otherwise(F.col("text"))
    both = both.withColumn("text", cut)
    if "n_chars" in names:
        both = both.withColumn("n_chars", F.when(F.col("__keep") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return both.select(*names)
