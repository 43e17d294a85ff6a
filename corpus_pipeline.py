"""From documents to tokens: language, near copies, benchmark leaks, personal data, byte-pair encoding."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlake.llm import bpe, language, leaks, neardup, private
from hearthlake.llm.common import checkpointed, id_hash, remove, table
from hearthlake.session import ensure_checkpoint_dir

TOKENIZER = "word_bpe_49k.json"

Stage = tuple[str, object]


def packed(docs: DataFrame) -> DataFrame:
    """Whole rows as one column beside the text, so that no column of theirs can clash with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("text"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly; learned from those not held out. Texts without letters go."""
    model = language.fit(docs.where(~language.held_out(id_hash(F.col("doc_id")))))
    return language.identify(packed(docs), model, keep=["_row"]).where(~F.col("rejected")).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return leaks.find_leaks(packed(docs), table(spark, sf_dir, "benchmark")).where("n_hit = 0").select("_row.*")


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    model = private.fit(docs)
    found = private.find(packed(docs), model)
    masked = found.select("_row", private.masked(F.col("text"), F.col("spans")).alias("_text"))
    row = F.col("_row")
    new = {"text": F.col("_text"), "n_chars": F.coalesce(F.length("_text").cast("bigint"), row["n_chars"])}
    return masked.select(*[new.get(c, row[c]).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids and the text decoded from them."""
    path = public_tokenizers.path(TOKENIZER)
    coded = bpe.round_trip(docs.select("doc_id", "text"), path, keep=["doc_id"])
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES: list[Stage] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("bpe", tokens),
]

#: Compression, signatures and EM are beyond SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet in the shared folder and read again."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), ""
    try:
        for name, stage in STAGES[:-1]:
            folder = f"{base}/{name}"
            stage(spark, docs, sf_dir).write.parquet(folder)
            docs = spark.read.parquet(folder)
            if last:
                remove(spark, last)
            last = folder
        return checkpointed(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        remove(spark, base)
