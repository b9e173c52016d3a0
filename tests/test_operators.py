import pytest
from pyspark.sql import functions as F

from quillet.functions import codecs
from quillet.operators import cluster, measure, ranking, retrieval, stats, wildcard
from quillet.operators.compressed import METHODS, compress
from quillet.operators.index import VIEWS, Index, build_index, disk_statistics, index_on_disk
from quillet.sources import files, storage
from quillet.streaming.tokens import index_stream


def ids(df):
    return sorted(r.doc_id for r in df.collect())


@pytest.fixture(scope="module")
def index(spark):
    texts = ["monday morning moon", "the moon is common with the sun", "with common sense, common people sing", "singing in the morning", "a b a b", "", None]
    return build_index(spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")).persist()


def test_phrases(index):
    positional, biword = (ids(retrieval.phrase_search(index, "common with the", m)) for m in ("positional", "biword"))
    assert positional == [2] and set(positional) <= set(biword)
    assert ids(retrieval.phrase_search(index, "a b a b")) == [5]
    assert ids(retrieval.phrase_search(index, "moon")) == [] and ids(retrieval.phrase_search(index, "moon", raw=True)) == [1, 2]
    with pytest.raises(ValueError):
        retrieval.phrase_search(index, "a b", "index")


def test_proximity(index):
    near = lambda a, b, k: ids(retrieval.proximity_docs(index, a, b, k))
    assert near("common", "with", 1) == [2] and near("with", "common", 1) == [3]
    assert near("common", "with", 2) == near("with", "common", 2) == [2, 3]
    assert near("common", "with", 0) == near(" ", "with", 2) == []
    assert retrieval.proximity_matches(index, "a", "a", 2).count() == 4
    assert set(near("the", "moon", 3)) == set(ids(retrieval.proximity_matches(index, "the", "moon", 3).select("doc_id").distinct()))


@pytest.mark.parametrize("query", ["mo*", "*ing", "m*n", "*", "moon", "s*g", "xyz*"])
def test_strategies_agree(index, query):
    found = {s: sorted(r.term for r in wildcard.wildcard_terms(index, query, s).collect()) for s in wildcard.STRATEGIES}
    assert len(set(map(tuple, found.values()))) == 1


def test_wildcards(index):
    terms = lambda q, **k: sorted(r.term for r in wildcard.wildcard_terms(index, q, **k).collect())
    assert terms("*o*n*") == ["common", "monday", "moon", "morning"] and terms("**") == terms("*")
    assert terms("s?n") == [] and terms("s?n", single=True) == ["sun"]
    with pytest.raises(ValueError):
        wildcard.btree_terms(index, "*a*")


def test_zones(spark):
    zones = [(1, "TITLE", "program"), (1, "AUTHOR", "ann"), (1, "BODY", "a program"), (2, "TITLE", "other"), (2, "BODY", "program program")]
    docs = spark.createDataFrame([(1, ""), (2, "")], "doc_id bigint, text string")
    index = build_index(docs, zones=spark.createDataFrame(zones, "doc_id bigint, zone string, text string"))
    assert {r.doc_id: r.score for r in ranking.zone_rank(index, "program").collect()} == {1: 0.55, 2: 0.15}
    assert {r.doc_id: round(r.score, 2) for r in ranking.zone_rank(index, "program program").collect()} == {1: 1.1, 2: 0.3}
    assert ids(ranking.zone_search(index, "ann")) == [1]


def test_zone_parser(spark, tmp_path):
    files.write_book(tmp_path, 1, "Moby Dick", "Melville", "Whales", "Title: Call\n me \n\nIshmael")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "plain.txt").write_text("Title:\nAuthor: X\nno marks")
    read = files.read_files(spark, str(tmp_path))
    named = files.registry(read).join(read.select("filename", "content"), "filename")
    got = {(r.doc_id, r.zone): r.text for r in files.parse_zones(named, text="content", filename="filename").collect()}
    assert got == {(1, "TITLE"): "Moby DickCall", (1, "AUTHOR"): "Melville", (1, "SUBJECT"): "Whales", (1, "BODY"): "me Ishmael", (2, "TITLE"): "plain.txt"}
    with pytest.raises(ValueError):
        files.read_files(spark, str(tmp_path / "none"))
    assert files.read_files(spark, str(tmp_path), "*.md").count() == 0


def test_xml():
    assert files.xml_to_text("<r><a>x</a><id>7</id>y<ref>q<b>w</b>e</ref></r>").split() == ["x", "y", "e"]
    assert files.xml_to_text("<r>a &amp; <b>c &nbsp; d") == "a c d"


def test_word_list(spark, tmp_path):
    (tmp_path / "words").write_text("The a # articles\n\n#none\nOF\n")
    assert sorted(r.word for r in files.word_list(spark, str(tmp_path / "words")).collect()) == ["a", "of", "the"]


def test_registry_keeps_first_of_a_name(spark):
    df = spark.createDataFrame([("/b/x.txt", 5), ("/a/x.txt", 3), ("/c/y.txt", 1)], "path string, size_bytes bigint")
    assert sorted(files.registry(df).collect()) == [(1, "x.txt", 3), (2, "y.txt", 1)]


def test_kmeans(spark):
    rows = [(1, "a", 1.0), (2, "a", 2.0), (2, "b", 0.1), (3, "c", 1.0), (4, "c", 1.0), (4, "d", 0.2)]
    vectors = spark.createDataFrame(rows, "doc_id bigint, term string, tfidf double")
    members = cluster.kmeans(vectors, 2, init=[1, 3])
    assert sorted(members.collect()) == [(1, 0), (2, 0), (3, 1), (4, 1)] and cluster.cluster_of(members, 9) == -1
    assert cluster.kmeans(vectors, 9, seed=1).count() == 4
    assert {r.cluster_id: r.docs for r in cluster.cluster_sizes(members).collect()} == {0: 2, 1: 2}
    kept = cluster.update(vectors, members.where("cluster_id = 0"), cluster.initial_centroids(vectors, [1, 3]))
    assert {(r.cluster_id, r.term): r.weight for r in kept.collect()} == {(0, "a"): 1.5, (0, "b"): 0.1, (1, "c"): 1.0}


@pytest.mark.parametrize("fmt", storage.FORMATS)
def test_save_load(spark, index, tmp_path, fmt):
    storage.save(index, str(tmp_path / fmt), fmt)
    back = storage.load(spark, str(tmp_path / fmt), fmt)
    assert sorted(back.tokens.select("doc_id", "pos", "term").collect()) == sorted(index.tokens.collect())
    assert sorted(back.docs.collect()) == sorted(index.docs.collect())
    assert storage.load_next_id(spark, str(tmp_path / fmt), fmt) == 8
    with pytest.raises(ValueError):
        storage.save(index, str(tmp_path), "xls")


def test_measure(index, tmp_path):
    assert [m.fmt for m in storage.measure_formats(index, str(tmp_path))] == list(storage.FORMATS)


def test_disk_index_prunes(spark, index, tmp_path):
    disk = index_on_disk(index, str(tmp_path), 2)
    assert ids(retrieval.term_search(disk, "moon")) == [1, 2]
    plan = wildcard.prefix_terms(Index(disk.docs, disk.postings), "mo")._jdf.queryExecution().toString()
    assert "StringStartsWith(term,mo)" in plan


def test_disk_index_has_all_views(spark, index, tmp_path):
    """What an opened index answers, and that none of it opens positions but where places are asked for."""
    disk = index_on_disk(index, str(tmp_path), 2)
    for name in (*VIEWS, "inverted", "postings", "terms", "frequencies", "tokens"):
        ours, theirs = getattr(disk, name), getattr(index, name)
        assert sorted(map(str, ours.select(*sorted(ours.columns)).collect())) == sorted(map(str, theirs.select(*sorted(ours.columns)).collect())), name
    reads = lambda df: [x for x in df._jdf.queryExecution().toString().splitlines() if "ReadSchema" in x]
    for df in (retrieval.term_search(disk, "moon"), wildcard.prefix_terms(disk, "mo"), wildcard.suffix_terms(disk, "ing"), wildcard.trigram_terms(disk, "m*o*n"), retrieval.phrase_search(disk, "the moon", "biword"), disk.lexicon):
        assert reads(df) and not any("positions" in x for x in reads(df))
    assert ids(retrieval.phrase_search(disk, "common with the")) == [2] and ids(retrieval.proximity_docs(disk, "with", "common", 2)) == [2, 3]
    assert [r.term for r in wildcard.terms_where(disk, F.length("term") > 6).collect()] == ["morning", "singing"]
    sizes = disk_statistics(spark, str(tmp_path))
    assert all(sizes[f"{n}_files"] > 0 and sizes[f"{n}_bytes"] > 0 for n in ("docs", "postings", *VIEWS))
    assert stats.measured_build(index, str(tmp_path / "again"))["megabytes_per_second"] > 0


def test_rows_make_what_tokens_make(index):
    """An index of a token table from elsewhere gives the same tables as one of documents."""
    other = Index(index.docs, index.tokens)
    for name in ("inverted", "postings", "biwords", "lexicon", "frequencies"):
        assert sorted(map(str, getattr(other, name).collect())) == sorted(map(str, getattr(index, name).collect())), name
    for name in ("inverted", "postings", "biwords"):
        assert "Exchange" not in getattr(index, name)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("method", METHODS)
def test_compressed(index, method):
    small = compress(index, method, block=3, width=2)  # terms of several parts
    assert sorted(small.inverted().collect()) == sorted(index.inverted.collect()) and ids(small.term_search("moon")) == [1, 2]
    assert sorted(r.term for r in small.terms().collect()) == sorted(r.term for r in index.terms.collect())
    sizes = small.sizes().first()
    assert sizes.original_postings == 4 * index.inverted.count() and 0 < sizes.ratio < 400
    with pytest.raises(ValueError):
        compress(index, "zip")


def test_gaps_over_ranges(spark):
    """A term that all documents hold goes over several ranges."""
    pairs = spark.range(4000).selectExpr("if(id % 10 = 0, concat('t', id % 7), 'all') as term", "id as doc_id")
    gaps = codecs.posting_gaps(pairs)
    got, last = {}, {}
    for term, doc in sorted((r.term, r.doc_id) for r in pairs.collect()):
        got[term, doc] = doc - last.get(term, 0)
        last[term] = doc
    assert {(r.term, r.doc_id): r.gap for r in gaps.collect()} == got
    assert sorted(codecs.undo_gaps(gaps).collect()) == sorted((t, d) for t, d in got)


def test_search_and_codec_times(index):
    found = measure.search_times(index, ["moon", "the"], warm=0, runs=1).collect()
    assert len(found) == 10 and sum(r.winner for r in found) == 5 and all(r.micros > 0 for r in found)
    assert {r.method: r.correct for r in measure.codec_times(index, runs=1).collect()} == {"vbyte": True, "gamma": True}
    assert measure.trimmed_mean([9.0, 1.0, 2.0, 4.0]) == 3.0 and measure.trimmed_mean([1.0, 2.0]) == 1.5
    for kind, own in (("term", ["moon"]), ("and", ["moon", "the"]), ("or", ["moon", "sun"]), ("not", ["the"])):
        by_index = {"term": retrieval.term_search, "not": retrieval.not_search, "and": retrieval.and_search, "or": retrieval.or_search}[kind](index, *own)
        assert ids(measure._matrix_hits(index, kind, own)) == ids(by_index)


def test_reindex(spark, index):
    more = build_index(spark.createDataFrame([(2, "new words"), (9, "moon")], "doc_id bigint, text string"))
    new = index.reindex(more)
    assert ids(retrieval.term_search(new, "moon")) == [1, 9] and ids(retrieval.term_search(new, "words")) == [2] and new.docs.count() == 8
    assert index.without(index.docs).docs.count() == index.without(index.docs).inverted.count() == 0


def test_stats(index):
    assert stats.stats(index, "positional").first().occurrences == index.tokens.count()
    assert stats.top_terms(index, 1).first().term in ("common", "moon", "morning", "the", "with")
    assert stats.roundtrip_errors(index).first().wrong == 0
    assert stats.build_metadata(10, 5, 100, 20) == {"avg_terms_per_doc": 2.0, "compression_ratio": 20.0, "megabytes_per_second": 0.0} and stats.build_metadata(1, 0, 0, 1)["compression_ratio"] == 0.0
    with pytest.raises(ValueError):
        stats.top_terms(index, 0)


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "one two")], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / "in"))
    index_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_incremental(index, spark):
    more = build_index(spark.createDataFrame([(1, "again"), (8, "new moon")], "doc_id bigint, text string"))
    assert ids(retrieval.term_search(index.add(more), "moon")) == [1, 2, 8] and ids(retrieval.term_search(index.add(more), "again")) == []
    assert index.docs.where(F.col("doc_id") == 7).first().size_bytes == 0
