"""From raw documents to token ids: five stages, each on all that the one before it kept.

Every stage is written as Parquet in the shared folder and read again, which cuts
lineage and lets a lost executor cost one stage at most.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import byte_bpe, decontamination, line_dedup, near_dedup, toxicity
from ledgerlake.llm.common import Scratch, fresh

#: Up to so many ids (8 bytes each) a list of ids is broadcast; a longer one is joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is not in ids; rows without one stay."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), key, "left_anti")


def _by_itself(stage: Callable) -> Callable:
    """A stage whose operators see doc_id, text and n_chars under their names only, so no other column can clash; all come back as they were."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        start = fresh(docs, "__column")
        while any(c.lower().startswith(start.lower()) for c in docs.columns):
            start += "_"
        names = [c if c in ("doc_id", "text", "n_chars") else f"{start}{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(names).toDF(*docs.columns)

    return run


@_by_itself
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity under 0.5; null and empty texts and null ids are scored alike, and empty texts stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, keep=docs.columns)
    return scored.where((F.col("score") < 0.5) | (F.coalesce(F.length("text"), F.lit(0)) == 0)).select(docs.columns)


@_by_itself
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, with texts (and n_chars) short of lines that an earlier line matches.

    A document of which nothing but white space is left was a copy, line by line, and
    goes. Texts that were null, empty or blank before stay, as do rows without an id.
    """
    out = line_dedup.dedup_lines(docs)
    left = out.where((F.col("n_removed") == 0) | F.col("text").isNull() | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


@_by_itself
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that with the smallest id.

    Where ids come twice, rows are told apart by their texts: of a component that with
    the smallest (id, text) stays, and rows with different texts are no copies because
    they share an id. Rows with a null id, and texts without words, all stay.
    """
    scratch = Scratch(spark, "near-stage")
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if not ids.limit(1).count():
        told = near_dedup.near_duplicates(docs, words=5, percent=80)
        return _without(docs, scratch.table(told.where("NOT kept").select("doc_id"), "gone"))
    # Numbered in this order, and written, so that numbers stay what they are.
    numbered = docs.orderBy("doc_id", "text").withColumn("__row", F.monotonically_increasing_id())
    numbered = scratch.table(numbered.withColumn("__row", F.when(F.col("doc_id").isNotNull(), F.col("__row"))), "numbered")
    told = near_dedup.near_duplicates(numbered, "__row", words=5, percent=80)
    gone = scratch.table(told.where("NOT kept").select("__row"), "gone")
    return _without(numbered, gone, "__row").select(docs.columns)


@_by_itself
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item. Rows with a null id stay; rows that share an id go together."""
    scratch = Scratch(spark, "leak-stage")
    found = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, scratch.table(found.select("doc_id").distinct(), "found"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, ids, ids_sha256, decoded_sha256): ids as little-endian 32-bit numbers."""
    both = byte_bpe.encode(docs, decoded="decoded")
    return both.select(
        "doc_id", "n_bytes", "n_tokens", "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", to_tokens),
]

#: SQL cannot express compression distances or merges; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the documents that all stages keep."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:  # what the next stage has read is read no more
            scratch.drop(before)
        before = name
    return docs
