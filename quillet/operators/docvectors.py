"""K-means over the TF-IDF vectors of an index, kept by blocks of documents.

A block holds its documents' vectors as numbers of terms and counts; what moves each round is a row for each term and cluster of a block: the centroids' weights on the way there, sums on the way back.
The documents themselves, and the pairs of documents and terms, stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.operators.blocks import _by_blocks, _coded, _lists
from quillet.operators.index import Index
from quillet.session import Stored, checkpoint, lean, partitions_for, small_batches

#: Bytes of text of a block, but for its last document's.
BLOCK = 32 << 20
MADE = "block bigint, docs array<bigint>, sizes binary, codes binary, tfs binary, terms array<string>, ns array<int>"
HELD = "block bigint, docs array<bigint>, sizes binary, codes binary, tfs binary, tids binary, idfs binary"
STEP = "member boolean, id bigint, cluster_id int, s double, n bigint"


def _packed(numbers: np.ndarray) -> bytes:
    return np.int64(numbers.nbytes).tobytes() + pa.compress(numbers.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int(np.frombuffer(data[:8], np.int64)[0]), "zstd", asbytes=True), kind)


def vectors_of(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Of (doc_id, plain), one row: the documents with words, how many different terms each has, these and their counts one document behind another; the terms, and the documents of each."""
    ids, terms, code, row, _ = _coded(batches)
    used, code = np.unique(code, return_inverse=True)
    key, tf = np.unique(row.astype(np.int64) * max(1, len(used)) + code, return_counts=True)
    own, code = key // max(1, len(used)), key % max(1, len(used))
    docs, sizes = np.unique(own, return_counts=True)
    held = ids.take(pa.array(docs)).cast(pa.int64())
    some = 1 if len(docs) else 0
    columns = {
        "block": pa.array(held.to_numpy()[:1]),
        "docs": _lists(np.array([0, len(docs)][: some + 1]), held),
        "sizes": pa.array([_packed(sizes.astype(np.int32))][:some], pa.binary()),
        "codes": pa.array([_packed(code.astype(np.int32))][:some], pa.binary()),
        "tfs": pa.array([_packed(tf.astype(np.int32))][:some], pa.binary()),
        "terms": _lists(np.array([0, len(used)][: some + 1]), terms.take(pa.array(used))),
        "ns": _lists(np.array([0, len(used)][: some + 1]), pa.array(np.bincount(code, minlength=len(used)).astype(np.int32))),
    }
    return pa.RecordBatch.from_pydict(columns)


def _with_terms(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block with the numbers of its terms and their idf, in the order of its codes."""
    order = np.argsort(right["code"].to_numpy())
    tids, idfs = right["tid"].to_numpy()[order].astype(np.int64), right["idf"].to_numpy()[order].astype(np.float64)
    return left.select(["block", "docs", "sizes", "codes", "tfs"]).append_column("tids", pa.array([_packed(tids)], pa.binary())).append_column("idfs", pa.array([_packed(idfs)], pa.binary()))


def _opened(table: pa.Table | pa.RecordBatch, k: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """docs; the row, code and weight of each pair; and the numbers of the terms."""
    docs = table["docs"][k].values.to_numpy()
    sizes, codes, tfs = (_unpacked(table[n][k].as_py(), np.int32) for n in ("sizes", "codes", "tfs"))
    tids, idfs = _unpacked(table["tids"][k].as_py(), np.int64), _unpacked(table["idfs"][k].as_py(), np.float64)
    return docs, np.repeat(np.arange(len(docs)), sizes), codes, tfs * idfs[codes], tids


def _step(clusters: int, norms: list[float], sums: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a block and the weights of its terms: the cluster of each document, and the sum and count of each term over the members of each cluster."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        docs, row, codes, weight, tids = _opened(left)
        centroids = np.zeros((clusters, len(tids)))
        centroids[right["cluster_id"].to_numpy(), right["code"].to_numpy()] = right["weight"].to_numpy()
        own = np.sqrt(np.bincount(row, weight * weight, len(docs)))
        sims = np.zeros((len(docs), clusters))
        for j in range(clusters):
            under = own * norms[j]
            np.divide(np.bincount(row, weight * centroids[j][codes], len(docs)), under, out=sims[:, j], where=under > 0)
        best = np.floor(sims * 1e12 + 0.5).argmax(axis=1)  # among equals the first; all 0: cluster 0
        columns = [np.ones(len(docs), bool), docs, best, np.zeros(len(docs)), np.zeros(len(docs), np.int64)]
        if sums:
            at = codes.astype(np.int64) * clusters + best[row]
            s, n = np.bincount(at, weight, len(tids) * clusters), np.bincount(at, minlength=len(tids) * clusters)
            there = np.flatnonzero(n)
            columns = [np.concatenate(x) for x in zip(columns, [np.zeros(len(there), bool), tids[there // clusters], there % clusters, s[there], n[there]], strict=True)]
        kinds = (pa.bool_(), pa.int64(), pa.int32(), pa.float64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["member", "id", "cluster_id", "s", "n"])

    return run


class DocumentVectors:
    """The TF-IDF vectors of an index of documents with whole numbers as ids."""

    def __init__(self, index: Index):
        spark = index.docs.sparkSession
        small_batches(spark)
        self.count = partitions_for(index.analysed)
        made = Stored(index.analysed.select("doc_id", "plain").mapInArrow(_by_blocks(vectors_of, BLOCK), MADE), "vectors").df
        total = index.docs.count()
        placed = made.select(F.col("block").alias("block"), F.posexplode(F.arrays_zip("terms", "ns")).alias("code", "t")).select("block", "code", F.col("t.terms").alias("term"), F.col("t.ns").alias("n"))
        df = placed.groupBy("term").agg(F.sum("n").alias("df"))
        self.terms = Stored(df.select("term", F.log(1 + F.lit(total) / F.col("df")).alias("idf"), F.monotonically_increasing_id().alias("tid")), "terms").df
        numbered = placed.select("block", "code", "term").join(self.terms, "term").select("block", "code", "tid", "idf").repartition(self.count, "tid")
        held = made.select("block", "docs", "sizes", "codes", "tfs").groupBy("block").cogroup(numbered.groupBy("block")).applyInArrow(_with_terms, HELD)
        # kept by the executors and not checkpointed: a table that is read from a folder has lost how it was dealt, and each round would deal it again
        self.places = numbered.select("tid", "block", "code").persist(StorageLevel.DISK_ONLY)
        self.blocks = held.repartition(self.count, "block").persist(StorageLevel.DISK_ONLY)

    def close(self) -> None:
        self.places.unpersist()
        self.blocks.unpersist()

    def seeds(self, doc_ids: list[int]) -> DataFrame:
        """tid, cluster_id, weight: the vectors of the given documents."""
        wanted = np.array(doc_ids, np.int64)

        def find(batches):
            for batch in batches:
                for k in range(len(batch)):
                    docs = batch["docs"][k].values.to_numpy()
                    if not np.isin(docs, wanted).any():
                        continue
                    docs, row, codes, weight, tids = _opened(batch, k)
                    for j, doc in enumerate(wanted.tolist()):
                        here = docs[row] == doc
                        yield pa.RecordBatch.from_pydict({"tid": pa.array(tids[codes[here]]), "cluster_id": pa.array(np.full(here.sum(), j, np.int32)), "weight": pa.array(weight[here])})

        return checkpoint(self.blocks.mapInArrow(lean(find), "tid bigint, cluster_id int, weight double"))

    def step(self, centroids: DataFrame, clusters: int, sums: bool = True) -> DataFrame:
        """STEP of all blocks, stored."""
        norms = dict(centroids.groupBy("cluster_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight")))).collect())
        weights = self.places.join(centroids, "tid").select("block", "code", "cluster_id", "weight")
        met = self.blocks.groupBy("block").cogroup(weights.groupBy("block"))
        return Stored(met.applyInArrow(_step(clusters, [norms.get(j, 0.0) for j in range(clusters)], sums), STEP), "round").df

    def means(self, stepped: DataFrame, old: DataFrame) -> DataFrame:
        """The centroids after a step; a cluster without members keeps its own."""
        new = stepped.where("not member").select(F.col("id").alias("tid"), "cluster_id", "s", "n").repartition(self.count, "tid").groupBy("tid", "cluster_id").agg((F.sum("s") / F.sum("n")).alias("weight"))
        left = {r.cluster_id for r in old.select("cluster_id").distinct().collect()} - {r.cluster_id for r in stepped.where("member").select("cluster_id").distinct().collect()}
        if left:
            new = new.unionByName(old.where(F.col("cluster_id").isin(list(left)))).repartition(self.count, "tid")
        return checkpoint(new)

    def named(self, centroids: DataFrame) -> DataFrame:
        """cluster_id, term, weight."""
        return centroids.join(self.terms, "tid").select("cluster_id", "term", "weight")

    def first(self, k: int, seed: int) -> list[int]:
        """k documents of least hash under the seed."""
        ids = self.blocks.select(F.explode("docs").alias("doc_id"))
        return [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(k).collect()]


def members_of(stepped: DataFrame) -> DataFrame:
    """doc_id, cluster_id."""
    return stepped.where("member").select(F.col("id").alias("doc_id"), "cluster_id")


def kmeans_of(index: Index, k: int, max_iter: int = 10, init: list[int] | None = None, seed: int = 0) -> DataFrame:
    """What cluster.kmeans() gives of the index's TF-IDF vectors."""
    from quillet.operators import cluster, ranking

    if index.blocks is None:
        return cluster.kmeans(ranking.tfidf(index), k, max_iter, init, seed)
    vectors = DocumentVectors(index)
    init = vectors.first(k, seed) if init is None else init
    centroids, members = vectors.seeds(init), None
    for left in range(max_iter - 1, -1, -1):
        stepped = vectors.step(centroids, len(init), sums=left > 0)
        new = members_of(stepped)
        if members is not None and not new.join(members.withColumnRenamed("cluster_id", "was"), "doc_id").where("cluster_id <> was").limit(1).count():
            break
        members = new
        if left:
            centroids = vectors.means(stepped, centroids)
    vectors.close()
    return members
