"""Corpus pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, token ids.

``STAGES`` are (name, function); each takes (spark, docs, sf_dir) and works on all that the one before it kept.  All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwise.functions.storage import cut_lineage

#: The stages hold similarity of sets, retrieval and merges that SQL doesn't express; tests compare them with plain code.
ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs."""
    from ledgerwise.llm.quality import keep_good

    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    from ledgerwise.llm.near_dedup import near_duplicates

    dropped = near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(cut_lineage(dropped), "doc_id", "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified benchmark item."""
    from ledgerwise.llm.decontaminate import contaminated

    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(cut_lineage(found), "doc_id", "left_anti")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind."""
    from ledgerwise.llm.pii import redact

    clean = redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the proof that they decode to its text."""
    import public_tokenizers

    from ledgerwise.llm.bpe import Tokenizer, read_ranks

    tok = Tokenizer(spark, read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    rows = tok.decode(tok.encode(docs.select("doc_id", "text", "lang", "source")))
    exact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("personal data", pii),
          ("byte BPE", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
