import random

import pytest

from quillet.operators import cluster, docvectors, ranking
from quillet.operators.index import Index, build_index


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"{'abc'[k % 3]}{n}" for n in range(30)] + ["all"], k=25)) for k in range(90)] + ["", None, "alone"]
    return build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartitionByRange(4, "doc_id"))


def rounded(df):
    return sorted((r.cluster_id, r.term, round(r.weight, 9)) for r in df.collect())


@pytest.mark.parametrize(("k", "init", "rounds"), [(3, [0, 1, 2], 5), (2, [0, 1], 1), (3, [0, 90, 1], 3), (99, None, 2), (2, [4, 4], 2)])
def test_kmeans_by_blocks(index, k, init, rounds):
    """The same as over rows of documents and terms: several blocks, a seed without words, more clusters than documents, equal seeds."""
    want = cluster.kmeans(ranking.tfidf(index), k, rounds, init, seed=3)
    assert sorted(docvectors.kmeans_of(index, k, rounds, init, seed=3).collect()) == sorted(want.collect())


def test_steps_by_blocks(index):
    vectors, rows = docvectors.DocumentVectors(index), ranking.tfidf(index)
    seeds, plain = vectors.seeds([0, 90, 1]), cluster.initial_centroids(rows, [0, 90, 1])
    assert rounded(vectors.named(seeds)) == rounded(plain)
    stepped, members = vectors.step(seeds, 3), cluster.assign(rows, plain, 3)
    assert sorted(docvectors.members_of(stepped).collect()) == sorted(members.collect()) and vectors.blocks.count() == 4
    assert rounded(vectors.named(vectors.means(stepped, seeds))) == rounded(cluster.update(rows, members, plain))


def test_pairs_stay_where_they_are(index):
    """A round moves rows of terms and blocks: no exchange holds documents."""
    vectors = docvectors.DocumentVectors(index)
    plan = vectors.places.join(vectors.seeds([0, 1]), "tid")._jdf.queryExecution().executedPlan().toString()
    assert "doc_id" not in plan
    met = vectors.step(vectors.seeds([0, 1]), 2)
    assert met.where("not member").count() <= 2 * vectors.places.count()


def test_other_indexes_are_clustered_too(index):
    plain = Index(index.docs, index.tokens)
    assert sorted(docvectors.kmeans_of(plain, 2, 2, [0, 1]).collect()) == sorted(docvectors.kmeans_of(index, 2, 2, [0, 1]).collect())
