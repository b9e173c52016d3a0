"""K-means by cosine over sparse vectors (doc_id, term, tfidf)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.operators.ranking import norms
from quillet.session import checkpoint


def initial_centroids(vectors: DataFrame, doc_ids: list[int]) -> DataFrame:
    """cluster_id, term, weight: the vectors of the given documents."""
    seeds = vectors.sparkSession.createDataFrame([(d, i) for i, d in enumerate(doc_ids)], "doc_id bigint, cluster_id int")
    return vectors.join(F.broadcast(seeds), "doc_id").select("cluster_id", "term", F.col("tfidf").alias("weight"))


def assign(vectors: DataFrame, centroids: DataFrame, clusters: int) -> DataFrame:
    """doc_id, cluster_id: the cluster of greatest cosine, among equals the least; documents that share no term with a centroid go to cluster 0."""
    sizes = centroids.groupBy("cluster_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("cn"))
    dots = vectors.join(_small(centroids), "term").groupBy("doc_id", "cluster_id").agg(F.sum(F.col("tfidf") * F.col("weight")).alias("dot"))
    near = dots.join(F.broadcast(sizes), "cluster_id").join(norms(vectors), "doc_id").withColumn("sim", F.coalesce(F.when((F.col("cn") > 0) & (F.col("norm") > 0), F.round(F.col("dot") / (F.col("cn") * F.col("norm")), 12)), F.lit(0.0)))
    best = near.where("sim > 0").groupBy("doc_id").agg(F.min_by("cluster_id", F.struct(-F.col("sim"), F.col("cluster_id"))).alias("best"))
    return vectors.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce("best", F.lit(0)).cast("int").alias("cluster_id"))


#: Rows of centroids that are broadcast, some 60 MB; more are joined, where adaptive execution splits the skewed terms of the vectors.
BROADCAST_ROWS = 1_000_000


def _small(centroids: DataFrame) -> DataFrame:
    return F.broadcast(centroids) if centroids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else centroids


def update(vectors: DataFrame, members: DataFrame, old: DataFrame) -> DataFrame:
    """The mean of each term over the members that have it; a cluster without members keeps its centroid."""
    new = vectors.join(members, "doc_id").groupBy("cluster_id", "term").agg(F.avg("tfidf").alias("weight"))
    kept = old.join(members.select("cluster_id").distinct(), "cluster_id", "left_anti")
    return new.unionByName(kept.select("cluster_id", "term", "weight"))


def kmeans(vectors: DataFrame, k: int, max_iter: int = 10, init: list[int] | None = None, seed: int = 0) -> DataFrame:
    """doc_id, cluster_id. Starts from the documents `init`, or from k documents of least hash under the seed; k is cut to the documents there are.

    Stops when no document moves. Lineage is cut by checkpoints each round; the driver sees one number a round.
    """
    vectors = checkpoint(vectors)
    if init is None:
        ids = vectors.select("doc_id").distinct()
        init = [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(k).collect()]
    centroids = checkpoint(initial_centroids(vectors, init))
    members = None
    for _ in range(max_iter):
        new = checkpoint(assign(vectors, centroids, len(init)))
        if members is not None and not new.join(members.withColumnRenamed("cluster_id", "was"), "doc_id").where("cluster_id <> was").limit(1).count():
            break
        members = new
        centroids = checkpoint(update(vectors, members, centroids))
    return members


def cluster_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster_id").agg(F.count("*").alias("docs"))


def cluster_of(members: DataFrame, doc_id: int) -> int:
    """The cluster of a document, -1 if it has none."""
    row = members.where(F.col("doc_id") == doc_id).first()
    return row.cluster_id if row else -1
