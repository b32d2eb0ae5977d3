"""Native text expressions and small helpers that the operators of this package share.

A word is a maximal run of characters other than space and U+0009 to U+000D.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPACES = r"[\x20\x09-\x0D]+"
NO_SPACE = r"[^\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, in order; null for null."""
    return F.array_remove(F.split(text, SPACES), "")


def word_count(text: Column) -> Column:
    """Number of words as BIGINT; 0 for null."""
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("bigint")


def _prefix(values: Column) -> Column:
    """0 and all prefix sums of a short array."""
    start = F.array(F.lit(0).cast("bigint"))
    return F.aggregate(values, start, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def starts_of(lengths: Column, block: int = 256) -> Column:
    """Exclusive running sums of an array, in blocks so that long arrays do not cost their square."""

    def of_blocks(blocks: Column) -> Column:
        return let(F.transform(blocks, _prefix), lambda local: F.flatten(F.zip_with(
            local, F.slice(_prefix(F.transform(local, lambda x: F.element_at(x, -1))), 1, F.size(local)),
            lambda sums, base: F.transform(F.slice(sums, 1, F.size(sums) - 1), lambda x: x + base))))

    def cut(values: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int"))
        return of_blocks(F.transform(firsts, lambda b: F.slice(values, b * block + 1, block)))

    return let(lengths, lambda values: F.when(F.size(values) > 0, cut(values)).otherwise(F.array().cast("array<bigint>")))


SPAN = "array<struct<start:bigint,stop:bigint,hit:string>>"


def spans(text: Column, pattern: str, group: int = 0, only: Column | None = None) -> Column:
    """All leftmost non-overlapping matches with places in code points (stop is exclusive); ``hit`` is the group's text.

    ``only`` is a cheap condition that every text with a match fulfils; other texts skip the search.
    Null texts have no spans.
    """

    def place(found: Column, gaps: Column, hits: Column) -> Column:
        first = F.zip_with(F.slice(gaps, 1, F.size(found)), F.concat(F.array(F.lit(0).cast("bigint")), found),
                           lambda gap, before: gap + before)
        # a match starts after all gaps up to its own and all matches before it
        steps = F.slice(first, 1, F.size(found))
        starts = F.zip_with(starts_of(steps), steps, lambda a, b: a + b)
        return F.zip_with(F.arrays_zip(starts.alias("start"), found.alias("size")), hits,
                          lambda at, hit: F.struct(at["start"].alias("start"), (at["start"] + at["size"]).alias("stop"), hit.alias("hit")))

    lengths = lambda values: F.transform(values, lambda x: F.length(x).cast("bigint"))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    hits = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    placed = let(whole, lambda found: F.when(F.size(found) > 0, let(
        lengths(F.split(text, pattern)), lambda gaps: let(lengths(found), lambda sizes: place(sizes, gaps, found if group == 0 else hits)))))
    wanted = text.isNotNull() if only is None else text.isNotNull() & only
    return F.coalesce(F.when(wanted, placed), F.array()).cast(SPAN)


def spell(kind: str, found: Column) -> Column:
    """Spans as kind:start:stop texts."""
    return F.transform(found, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["stop"]))


def with_row_key(df: DataFrame, *content: str) -> DataFrame:
    """Adds ``row_key``, equal only for rows equal in the named columns."""
    return df.withColumn("row_key", F.sha2(F.to_json(F.struct(*content)), 256))
