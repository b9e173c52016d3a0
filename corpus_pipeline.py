"""The corpus pipeline: five stages over documents, each written as Parquet and read by the next.

Stages take (spark, docs, sf_dir) and keep the columns of docs, but the last, which gives the encoded corpus. Null ids, null and empty texts and
repeated rows are as each operator says; a document that line dedup leaves without a word goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.llm import decontaminate, linejoin, ngramjoin, quality, sentencepieces
from quillet.llm.queries import model_path, table
from quillet.session import Stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their hosts' boilerplate lines."""
    return quality.apply_rules(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that resemble earlier ones; those that lose all their words that way go."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    kept = linejoin.dedup_lines(docs.select(F.struct(*others).alias("row"), "doc_id", "text"))
    kept = kept.where((F.col("n_removed_lines") == 0) | (F.length(quality.without("kept_text", quality.SPACES)) > 0))
    new = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed_lines") == 0, F.col("row.n_chars")).otherwise(F.length("kept_text")).cast(docs.schema["n_chars"].dataType)}
    return kept.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies. Rows without an id stay."""
    first = ngramjoin.jaccard_components(docs).where("component_id = doc_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null")
    return named.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns).unionByName(docs.where("doc_id is null"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids, and the digests of ids and decoded text."""
    encoded = sentencepieces.encode_spans(docs.select("doc_id", "lang", "source", "text"), model_path())
    return encoded.select("lang", "source", "ids", *sentencepieces.digest_columns())


STAGES = [(f.__name__, f) for f in (quality_rules, line_dedup, ngram_join, benchmark_decontamination, sentencepiece_encoding)]

#: Joins by similarity and the encoding aren't expressed in SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stored = Stored(stage(spark, docs, sf_dir), name)
        if before:
            before.drop()
        docs, before = stored.df, stored
    return STAGES[-1][1](spark, docs, sf_dir)
