"""Corpus pipeline: raw documents to packed training sequences, in five stages.

Each stage works on all that the one before it kept. Its result is a table in the shared folder, read again as the
next stage's documents. Columns that a stage doesn't use stay as they are; n_chars follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import lines, neardup, packing, pii, quality
from cairn.llm.common import cut, keep, scratch, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: Row numbers of documents to drop up to this number, 8 MB, are sent to every task; more are joined in a shuffle.
MOST_SENT = 1_000_000


def _packed(docs: DataFrame) -> DataFrame:
    """The columns a stage needs, beside all others as one, so that no name clashes."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")]
    return docs.select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"), F.struct(*others).alias("__others"))


def _unpacked(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The documents again, with the text that rows has now."""
    new = {"text": F.col("text"), "n_chars": F.length(F.coalesce("text", F.lit("")))}
    return rows.select(*[(new[c].cast(like.schema[c].dataType) if c in new else F.col("__others")[c]).alias(c) for c in like.columns])


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds of low quality or toxic go. Host: source; path: language within it.

    A row without text has no evidence against it; rows without an id or that repeat one are judged each by its text; an empty
    table stays empty.
    """
    rows = _packed(docs)
    heads = quality.fit(rows, table(spark, sf_dir, "labels"))
    scored = cut(quality.classify(rows, heads), "scored")
    kept = quality.combine(scored, quality.posteriors(scored), heads).filter("keep")
    return _unpacked(kept, docs)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three or more documents have stay in the one of largest id only.

    A row is a document: rows that repeat an id count each, and a null id is smaller than any. A null text stays one empty
    line; an empty table stays empty.
    """
    return _unpacked(lines.dedup_lines(_packed(docs).drop("host", "path")), docs)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a long of each row's own, __row: doc_id where no row lacks or repeats it. Else rows are numbered in order of
    doc_id (null last) and of the text's hash, equals in the order they are read."""
    if docs.groupBy("doc_id").count().filter(F.col("doc_id").isNull() | (F.col("count") > 1)).isEmpty():
        return docs.withColumn("__row", F.col("doc_id").cast("long"))
    read = docs.withColumn("__hash", F.xxhash64("text")).withColumn("__at", F.monotonically_increasing_id())
    read = cut(read, "read")  # the order of equals stays as it is
    ordered = read.orderBy(F.col("doc_id").asc_nulls_last(), "__hash", "__at").drop("__hash", "__at")
    return cut(ordered.withColumn("__row", F.monotonically_increasing_id()), "numbered")


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group of near duplicates stays, that of smallest id; each row is judged by its own text."""
    rows = _numbered(docs)
    judged = neardup.near_duplicates(rows.select("__row", "text"), id_col="__row")
    gone = cut(judged.filter(~F.col("kept")).select(F.col("doc_id").alias("__row")), "gone")
    gone = F.broadcast(gone) if gone.count() <= MOST_SENT else gone
    return rows.join(gone, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind. A null text stays null; ids don't matter; an empty table stays empty."""
    proposed = cut(pii.propose(_packed(docs).drop("host", "path")), "proposed")
    spans = pii.select(proposed, pii.fit(proposed))
    return _unpacked(spans.withColumn("text", pii.redacted(F.col("text"), F.col("__spans"))), docs)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences of as many. A null text is the end mark alone; rows that
    repeat an id or have none are packed each; an empty table gives an empty one."""
    return packing.pack_documents(docs.select("doc_id", "text"), TOKENIZER, hold=False)  # other stages run on the same workers


STAGES = [
    ("quality classifier", stage_quality), ("line dedup", stage_lines), ("MinHash near-dedup", stage_near), ("PII", stage_pii), ("best-fit packing", stage_pack),
]

#: SQL can't express the classifier, the near-duplicate groups or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES:
            with scratch(spark):  # what a stage writes on its way goes when its result is there
                docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return keep(docs, "pipeline")
