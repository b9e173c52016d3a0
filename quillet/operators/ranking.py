"""Weighted zones, TF-IDF vectors and cosine."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.functions.text import analyse
from quillet.operators.index import ZONES, Index
from quillet.session import checkpoint


def zone_weights(index: Index) -> DataFrame:
    """zone, weight: four rows."""
    spark = index.docs.sparkSession
    return spark.createDataFrame(list(ZONES.items()), "zone string, w string").select("zone", F.col("w").cast("decimal(3,2)").alias("weight"))


def zone_search(index: Index, term: str) -> DataFrame:
    """Documents with the term in any zone."""
    return index.zone_postings.where(F.col("term") == term).select("doc_id").distinct()


def zone_score(index: Index, term: str) -> DataFrame:
    """doc_id, score: the weights of the zones that hold the term, summed."""
    hits = index.zone_postings.where(F.col("term") == term).join(F.broadcast(zone_weights(index)), "zone")
    return hits.groupBy("doc_id").agg(F.sum("weight").cast("double").alias("score"))


def zone_rank(index: Index, query: str, stem: bool = False) -> DataFrame:
    """doc_id, score: the query's words' scores summed, a repeated word as often as it stands; best first, then by doc_id."""
    words = list(Counter(analyse(query, stem)).items())
    wanted = index.docs.sparkSession.createDataFrame(words, "term string, times int")
    hits = index.zone_postings.where(F.col("term").isin([w for w, _ in words])).join(F.broadcast(wanted), "term").join(F.broadcast(zone_weights(index)), "zone")
    return hits.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("times")).cast("double").alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id")


def tfidf(index: Index) -> DataFrame:
    """doc_id, term, tfidf = tf * ln(1 + N / df), N the registered documents."""
    tf = index.frequencies
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    total = index.docs.agg(F.count("*").alias("all"))
    # `all` is one row; df is broadcast by adaptive execution if its measured size allows, else a term that all documents hold is a skewed join that it splits
    return tf.join(df, "term").join(F.broadcast(total)).select("doc_id", "term", (F.col("tf") * F.log(1 + F.col("all") / F.col("df"))).alias("tfidf"))


def norms(vectors: DataFrame) -> DataFrame:
    """doc_id, norm."""
    return vectors.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf"))).alias("norm"))


def cosine(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_a, doc_b, cosine of the given pairs; 0 if a norm is 0 or no term is shared."""
    # both sides and the norms need the vectors of the pairs' documents alone: they are made once
    wanted = pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct()
    vectors = checkpoint(vectors.join(wanted, "doc_id", "left_semi"))
    a = vectors.select(F.col("doc_id").alias("doc_a"), "term", F.col("tfidf").alias("x"))
    b = vectors.select(F.col("doc_id").alias("doc_b"), "term", F.col("tfidf").alias("y"))
    dots = pairs.join(a, "doc_a").join(b, ["doc_b", "term"]).groupBy("doc_a", "doc_b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    n = norms(vectors)
    with_norms = pairs.join(dots, ["doc_a", "doc_b"], "left").join(n.select(F.col("doc_id").alias("doc_a"), F.col("norm").alias("na")), "doc_a", "left").join(n.select(F.col("doc_id").alias("doc_b"), F.col("norm").alias("nb")), "doc_b", "left")
    value = F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("dot") / (F.col("na") * F.col("nb")))
    return with_norms.select("doc_a", "doc_b", F.coalesce(value, F.lit(0.0)).alias("cosine"))
