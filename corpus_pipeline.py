"""A corpus pipeline of five stages. Each reads what the one before has written, works on all of it, and its decisions hold.

A stage takes (spark, docs, sf_dir); docs has the columns of documents. All but the last return these columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import bpe, decontaminate, line_dedup, minhash, toxicity
from riskspark.llm.common import Scratch, col, parts_for, table

#: The stages learn, count and shuffle, which one SQL statement can't express; tests/llm hold them against plain versions.
ORACLE_SQL = None


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Long texts make large Arrow batches: fewer rows in each, unless the session has its own number."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "2000")


def packed(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, by as many tasks as docs needs files of a fair size: scans and shuffles of small parts don't become small files."""
    return out.select(*(col(c) for c in docs.columns)).coalesce(parts_for(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows outside the held-out fold."""
    small_batches(spark)
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    return packed(toxicity.scored(docs, model).filter("predicted = 0"), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 10 documents or more go from all of them; n_chars follows. A document stays, also without lines."""
    small_batches(spark)
    out = line_dedup.drop_repeated_lines(docs, min_docs=10)
    now = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return packed(out.withColumns({c: x for c, x in now.items() if c in docs.columns}), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id."""
    small_batches(spark)
    return packed(minhash.drop_near_duplicates(docs), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    small_batches(spark)
    return packed(decontaminate.benchmark_hits(docs, table(spark, sf_dir, "benchmark")).filter("not contaminated"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as ids (little-endian unsigned 32-bit integers), and whether decoding gives the text back."""
    small_batches(spark)
    import public_tokenizers

    vocab = bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    text = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256")
    out = bpe.both_ways(docs.select("doc_id", "lang", "source", "text"), vocab).withColumn("text_sha256", text)
    same = F.sha2("decoded", 256) == F.col("text_sha256")
    return out.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("near dedup", drop_near_copies), ("decontamination", drop_contaminated), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(docs)
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
