"""Quality rules: figures of each text, and lines that many documents of a host repeat. DataFrame functions only.

Per document: words, code points in words, symbols, lines equal to an earlier line of the text, and words in five-word
windows found twice or more in the text. Across documents: lines are normalised (lower case, digits as 0, white space
closed up) and hashed, distinct documents per host are counted for each, and lines in more documents than the limit are
removed. A document that keeps less than ``LEAST_SHARE`` of its words, or fewer than ``LEAST_WORDS``, is rejected. The host
of a document is its source.

A line goes if it is in more than ``LIMIT_PERCENT`` of its host's documents or, in a host of any size, in more than
``LIMIT_DOCUMENTS``. In fewer than ``LEAST_DOCUMENTS`` documents a line repeats too seldom to tell anything, whatever the
share.

Cases: null and empty texts have no words and fail; a null source is a host of its own; equal rows and rows that share a
doc_id count once as a document; an empty table gives an empty table; only doc_id, source and text are read, so other
columns do not clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowquarry.llm.text import NO_SPACE, SPACES, let, words
from flowquarry.session import scratch_path

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Lines in more than this percentage of a host's documents, or in more documents than this, are removed, if in so many at least.
LIMIT_PERCENT, LIMIT_DOCUMENTS, LEAST_DOCUMENTS = 2, 100, 5
LEAST_SHARE, LEAST_WORDS = 0.5, 10


def repeated_window_words(tokens: Column) -> Column:
    """Words covered by windows that occur twice or more, from an array of words."""

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(WINDOW)]))

    def covered(sorted_: Column) -> Column:
        again = F.filter(sorted_, lambda x, i: F.coalesce(F.get(sorted_, i - 1)["key"] == x["key"], F.lit(False)) | F.coalesce(
            F.get(sorted_, i + 1)["key"] == x["key"], F.lit(False)))
        places = F.array_sort(F.transform(again, lambda x: x["at"]))
        # each place adds what its window covers before the next one begins
        return let(places, lambda at: F.aggregate(
            F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))

    def repeated(keys: Column) -> Column:
        pairs = F.array_sort(F.transform(keys, lambda key, i: F.struct(key.alias("key"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(keys)) < F.size(keys), let(pairs, covered)).otherwise(0)

    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(F.size(tokens) > WINDOW, let(hashed, lambda h: let(windows(h), repeated))).otherwise(0)


def text_figures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; zeros for null."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NO_SPACE))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return let(words(text), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), symbols.cast("bigint").alias("n_symbols"),
        dup_lines.cast("bigint").alias("n_dup_lines"), repeated_window_words(w).cast("bigint").alias("n_repeat_words")))


def line_keys(text: Column) -> Column:
    """Array of (hash of the normalised line, its words) for the lines with a word."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), r"[\x20\x09\x0B-\x0D]+", " "))
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    count = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), count(x).alias("words")))


def quality_rules(docs: DataFrame, limit_percent: int = LIMIT_PERCENT, limit_documents: int = LIMIT_DOCUMENTS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """Per row: doc_id, the figures, base_failed, words in removed lines, kept.

    The figures and hashed lines are written once; counting shuffles (host, line, document) after a local sum, so that a
    line in every document is spread by document, and then (host, line) sums.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "line-figures")
    text = F.col("text")
    (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("source").alias("host"), F.xxhash64("text").alias("text_key"),
                 text_figures(text).alias("figures"), line_keys(F.coalesce(text, F.lit(""))).alias("lines"))
     .select("doc_id", "host", "text_key", "figures.*", "lines").write.parquet(path))
    seen = spark.read.parquet(path)
    hosts = seen.groupBy(F.col("host").alias("of_host")).agg(F.count_distinct(F.coalesce("doc_id", "text_key")).alias("host_docs"))
    each = seen.select("host", F.coalesce("doc_id", "text_key").alias("document"), F.explode(F.array_distinct("lines.line")).alias("line"))
    counted = each.groupBy("host", "line").agg(F.count_distinct("document").alias("documents")).where(F.col("documents") >= least_documents)
    common = counted.join(hosts, F.col("host") == F.col("of_host")).where((100 * F.col("documents") > limit_percent * F.col("host_docs")) | (F.col("documents") > limit_documents)).select("host", "line")
    single = seen.select("doc_id", "host", "text_key", "lines").dropDuplicates(["doc_id", "host", "text_key"])
    rows = single.select("doc_id", "host", "text_key", F.explode("lines").alias("part")).select("doc_id", "host", "text_key", F.col("part.line").alias("line"), F.col("part.words").alias("words"))
    removed = (rows.join(common, ["host", "line"]).groupBy("doc_id", "host", "text_key").agg(F.sum("words").alias("removed"))
               .select(F.col("doc_id").alias("of_doc"), F.col("host").alias("in_host"), F.col("text_key").alias("of_text"), "removed"))
    same = seen["doc_id"].eqNullSafe(removed["of_doc"]) & (seen["host"] == removed["in_host"]) & (seen["text_key"] == removed["of_text"])
    gone = F.coalesce("removed", F.lit(0)).cast("bigint")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    enough = (left >= LEAST_WORDS) & (left >= F.col("n_words") * LEAST_SHARE)
    return (seen.join(removed, same, "left").withColumns({"removed_words": gone, "base_failed": failed}).withColumn("kept", ~F.col("base_failed") & enough)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"))
