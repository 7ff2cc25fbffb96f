"""A corpus pipeline: language ID, exact dedup, near-dedup, mixing to target weights, BPE encoding.

Each stage takes what the one before it wrote; all but the last return the columns of documents, extra ones
included, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm import bpe, exact, langid, minhash, mixing
from folio.llm.common import dropped, shared_dir, written
from folio.llm.queries import tokenizer_path

#: The columns that stages work on; any other is set aside under a name of its own.
OWN = ["doc_id", "text", "lang", "source", "n_chars"]


def _aside(stage: Callable[[DataFrame], DataFrame], docs: DataFrame) -> DataFrame:
    """stage of docs whose extra columns have names that clash with nothing, and the names of docs again."""
    names = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c not in OWN}
    out = stage(docs.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns)))
    return out.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def _one_row(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with one, that of the smallest text, of those with equal keys; usually there are none to leave out."""
    again = written(rows.groupBy(keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    if again.isEmpty():
        return rows
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    place = Window.partitionBy(*keys).orderBy("text")
    repeated = rows.alias("l").join(again.alias("r"), same, "left_semi").withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")
    return rows.alias("l").join(again.alias("r"), same, "left_anti").unionByName(repeated)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; their lang is the predicted one. Learns from the labelled rows of its input.

    Texts without a letter are rejected, and texts whose runner-up is as likely.
    """

    def stage(rows: DataFrame) -> DataFrame:
        found = langid.predict_columns(rows, langid.fit(rows))
        return found.where("lang_pred <> 'und' and not ambiguous").withColumn("lang", F.col("lang_pred"))

    return _aside(stage, docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of equal texts, once."""
    return _aside(lambda rows: _one_row(exact.exact_dedup(rows).where("kept"), ["doc_id", "text_sha256"]), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: five-word shingles, similarity 0.8 or more. Documents without an id stay."""

    def stage(rows: DataFrame) -> DataFrame:
        kept = minhash.near_dedup(rows).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
        left = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
        return _one_row(left.where("doc_id is not null"), ["doc_id"]).unionByName(left.where("doc_id is null"))

    return _aside(stage, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole time: not at all up to three times."""

    def stage(rows: DataFrame) -> DataFrame:
        taken = mixing.mix(rows).where("size > 0").groupBy("doc_id").agg(F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("_times"))
        taken = taken.where("_times > 0").withColumnRenamed("doc_id", "_doc")
        # texts are never broadcast, however small their files are
        some = rows.join(taken.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")))
        return some.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times"))))

    return _aside(stage, docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with their number and the digest of the decoded text."""
    return bpe.bpe_encode(docs, tokenizer_path(), ["n_tokens", "ids", "decoded_sha256"])


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]

#: The stages have no form in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages; what a stage wrote is deleted when the next one has written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            dropped(last)
        last = docs
    return docs
