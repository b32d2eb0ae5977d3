"""The corpus pipeline over documents: quality, near copies, personal data, mixture, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowquarry.llm import mixing, near_dup, packing, pii, quality_cnn
from flowquarry.llm.queries import TOKENIZER
from flowquarry.llm.text import NO_SPACE
from flowquarry.session import scratch_path

#: Documents are near copies if their sets of five-word shingles have a similarity of so many hundredths or more.
NEAR_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on the labels of ``sf_dir``, takes for good ones.

    Null and empty texts are scored like any other; long texts are read whole; repeated rows stay or go together; without
    labels every score is 0.5 and all stay; an empty table gives an empty table; the score's own columns have names that
    do not clash with those of the documents.
    """
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality_cnn.score_quality(docs, labels, prefix="__quality").where("__quality_predicted = 1").select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of least doc_id, nulls last, and of equal ones that of least text hash.

    A text is a node of its own, whatever its doc_id: rows of one doc_id with unlike texts all stay, rows without a
    doc_id go like any other if a copy of theirs stays. Rows without words, and null texts, are like no other, but of
    those that agree in doc_id and text one stays. Of rows equal in doc_id and text that of least hash of its other
    columns stays. Groups are decided on narrow rows; long texts are read whole; an empty table gives an empty table; all
    columns are kept as they are, whatever their names and types.
    """
    keyed = docs.withColumn("__key", F.xxhash64("text"))
    groups = (near_dup.near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"), NEAR_PERCENT)
              .groupBy(F.col("doc_id").alias("__key")).agg(F.first("component_id").alias("__group")))
    wordless = ~F.coalesce(F.col("text").rlike(NO_SPACE), F.lit(False))
    rows = keyed.groupBy("doc_id", "__key").agg(F.first(wordless).alias("__wordless"))
    alone = rows.where("__wordless").select("doc_id", "__key")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__key").alias("key"))).alias("row")
    of_texts = rows.where("not __wordless").groupBy("__key").agg(least)  # first for each text, then for each group of texts
    of_groups = of_texts.join(groups, "__key").groupBy("__group").agg(F.min("row").alias("row")).select(F.col("row.id").alias("doc_id"), F.col("row.key").alias("__key"))
    keep = alone.unionByName(of_groups).select(F.col("doc_id").alias("__id"), F.col("__key").alias("__of"))
    rest = [c for c in docs.columns if c != "doc_id"]
    others = [F.col(f"`{c}`") for c in rest if c != "text"]
    order = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    chosen = (keyed.join(keep, (F.col("__key") == F.col("__of")) & F.col("doc_id").eqNullSafe(F.col("__id")))
              .groupBy("__key", "doc_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("__row")))
    return chosen.select(*[F.col("doc_id") if c == "doc_id" else F.col("__row")[c].alias(c) for c in docs.columns])


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind.

    Null and empty texts stay as they are; long texts are read whole; repeated rows stay; an empty table gives an empty
    table; all other columns are kept.
    """
    return pii.redact(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one that ends a shard's quota is cut.

    A null source is a source of its own; null and empty texts have no words and are not taken; repeated rows are
    documents of their own; an empty table gives an empty table; all other columns are kept.
    """
    return mixing.mix_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place.

    Null and empty texts are the closing id alone; long texts are cut into pieces; repeated rows are packed each; an
    empty table gives an empty table; only doc_id and text are read.
    """
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality_stage), ("near_dup", near_dup_stage), ("pii", pii_stage), ("mixing", mix_stage), ("packing", pack_stage)]
#: Stages train a model and tokenize, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
