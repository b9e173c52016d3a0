import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillet.functions import codecs
from quillet.operators import blocks, compressed, retrieval, wildcard
from quillet.operators.index import VIEWS, Index, build_index, index_on_disk
from quillet.session import SHARE, partitions_for
from quillet.sources import storage

TEXTS = [" ".join(random.Random(k).choices(["a", "ab", "b", "é́x", "$c", "ß"] + [f"w{k}"], k=40 + k)) for k in range(60)] + ["", None, " \t\x0b", "x\x1cy z", "a  a\n\na", "ΣΑΣ İ"]


@pytest.fixture(scope="module")
def index(spark):
    rows = list(enumerate(TEXTS))
    random.Random(1).shuffle(rows)
    return build_index(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))


def same(a, b):
    return sorted(map(str, a.select(*sorted(b.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))


def test_blocks_are_the_postings(index):
    plain = Index(index.docs, index.tokens)  # grouped from tokens, without blocks
    assert plain.blocks is None and index.blocks.groupBy("term").count().where("count > 1").count()
    for name in ("inverted", "postings", "frequencies", "lexicon", "terms"):
        assert same(getattr(index, name), getattr(plain, name)), name
    assert same(blocks.blocks_of(index.analysed, "biword").select("biword", F.explode("docs").alias("doc_id")), plain.biwords)


def test_ids_of_other_kinds(spark):
    index = build_index(spark.createDataFrame([("x", "a b a"), ("y", "b")], "doc_id string, text string"))
    assert sorted((r.term, r.doc_id, r.tf, r.positions) for r in index.postings.collect()) == [("a", "x", 2, [0, 2]), ("b", "x", 1, [1]), ("b", "y", 1, [0])]


def test_ranges_are_in_order(index):
    """A term that all documents hold goes over several ranges, and ranges follow each other."""
    made = blocks.sorted_blocks(index.analysed.repartitionByRange(3, "doc_id"), "term", len(TEXTS), 20).withColumn("at", F.spark_partition_id()).collect()
    ends = defaultdict(list)
    for r in made:
        ends[r.at].append((r.term, r.docs[0]))
    assert len(ends) > 3 and [x for k in sorted(ends) for x in ends[k]] == sorted(x for v in ends.values() for x in v)
    assert len({r.at for r in made if r.term == "a"}) > 1


def test_texts_are_inverted_once(index):
    """A range shuffle that tells its ranges from its own rows makes them twice."""
    assert "rangepartitioning" not in blocks.sorted_blocks(index.analysed, "term", len(TEXTS), 6)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("key", "view"), [("rotation", "permuterm"), ("gram", "trigrams")])
def test_keys_of_terms(spark, index, key, view):
    terms = Index(index.docs, index.tokens).terms.persist()
    got = blocks.sorted_keys(terms, key, 4)
    assert same(got, getattr(Index(index.docs, index.tokens), view))
    parts = got.withColumn("at", F.spark_partition_id()).collect()
    assert len({r.at for r in parts}) > 1 and [(r[key], r.term) for r in sorted(parts, key=lambda r: r.at)] == sorted((r[key], r.term) for r in parts)


def test_disk_tables_come_when_asked_for(index, tmp_path):
    """What a query doesn't read isn't written; whatever is asked for then is there and right."""
    here = lambda: {p.name for p in tmp_path.iterdir()}
    disk = index_on_disk(index, str(tmp_path), 3, lazy=True)
    assert here() == {"docs"}
    assert retrieval.proximity_docs(disk, "a", "ab", 4).count() and here() == {"docs", "postings"}
    assert wildcard.wildcard_terms(disk, "a*b", "permuterm").count() == 1 and here() == {"docs", "postings", "lexicon", "permuterm"}
    for name in (*VIEWS, "inverted", "postings", "frequencies", "tokens", "terms"):
        assert same(getattr(disk, name), getattr(index, name)), name
    assert here() == {"docs", "postings", *VIEWS}


def test_partitions_grow_with_the_input(spark, monkeypatch, tmp_path):
    spark.range(20000).selectExpr("id as doc_id", "sha2(string(id), 512) as text").write.parquet(str(tmp_path / "d"))
    docs = build_index(spark.read.parquet(str(tmp_path / "d")))
    assert partitions_for(docs.tokens) == 4 and SHARE > 1 << 20
    monkeypatch.setattr("quillet.session.SHARE", 1 << 17)
    assert 8 < partitions_for(docs.tokens) < 40


def test_wildcard_joins_rows_before_documents(index, monkeypatch):
    for limit in (200_000, 0):  # broadcast, and over a shuffle
        monkeypatch.setattr(wildcard, "BROADCAST_TERMS", limit)
        got = [tuple(r) for r in wildcard.wildcard_search(index, "a*").collect()]
        assert got == sorted((r.term, r.doc_id) for r in index.inverted.where("term like 'a%'").collect())


def test_stems_are_made_of_distinct_terms(spark):
    """A condition on stems stays above what makes terms distinct."""
    docs = spark.createDataFrame([(1, "things thing"), (2, "Thinging other"), (3, None)], "doc_id bigint, text string")
    found = retrieval.term_search(build_index(docs, stem=True), "thing")
    assert sorted(r.doc_id for r in found.collect()) == [1, 2]
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    stems = next(k for k, line in enumerate(lines) if "ArrowEvalPython" in line)
    assert any("Aggregate [term" in line for line in lines[stems:])


@pytest.mark.parametrize("fmt", storage.FORMATS)
def test_saving_moves_nothing(spark, index, tmp_path, fmt):
    """Blocks are written where they are made, and folders with a row for each posting are still read."""
    storage.save(index, str(tmp_path / "new"), fmt)
    storage.save(Index(index.docs, index.tokens), str(tmp_path / "old"), fmt)
    for name in ("new", "old"):
        assert same(storage.load(spark, str(tmp_path / name), fmt).tokens, index.tokens), name
    assert "hashpartitioning" not in storage.block_lines(index)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("width", [4, 1 << 20])
def test_lines_and_parts(index, width):
    plain = Index(index.docs, index.tokens)
    assert same(storage.index_lines(index, width), storage.term_lines(plain.postings, width))
    assert same(compressed.index_parts(index, width), compressed.posting_parts(plain.inverted, width))


def test_codes_without_dictionary(index, spark):
    """The dictionary isn't made for a search, and rows go to Python by small batches."""
    made = compressed.compress(index, "gamma", width=2000)
    assert made.term_search("ab").count() == index.inverted.where("term = 'ab'").count() and "dictionary" not in made.__dict__
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(1 << 20)


@pytest.mark.parametrize("width", [7, 1 << 20])
def test_gaps_by_lists(index, width, monkeypatch):
    """Gaps of a term go on over its parts, and what they don't give back is counted."""
    pairs = compressed.gap_lists(index, width).select("term", F.explode(F.arrays_zip("ids", "gaps")).alias("p")).select("term", F.col("p.ids").alias("doc_id"), F.col("p.gaps").alias("gap"))
    assert same(pairs, codecs.posting_gaps(Index(index.docs, index.tokens).inverted))
    assert compressed.lost_by_gaps(index, width).collect() == [(0,)] and "RangePartitioning" not in pairs._jdf.queryExecution().executedPlan().toString()
    whole = compressed.gap_lists
    monkeypatch.setattr(compressed, "gap_lists", lambda i, w: whole(i, w).where("term <> 'w3'").withColumn("gaps", F.when(F.col("term") == "w5", F.transform("gaps", lambda g: g + 1)).otherwise(F.col("gaps"))))
    assert compressed.lost_by_gaps(index, width).first().wrong == index.inverted.where("term in ('w3', 'w5')").count() == 2


@pytest.mark.parametrize("phrase", ["a b", "a ab a", "b", "a a", "w7 none", "ab ab ab b"])
def test_phrases_on_disk(index, disk, phrase):
    """As from tokens, words that repeat among them; lists of places are met, their places aren't counted."""
    want = sorted(r.doc_id for r in retrieval.phrase_search(Index(index.docs, index.tokens), phrase, raw=True).collect())
    found = retrieval.phrase_search(disk, phrase, raw=True)
    assert sorted(r.doc_id for r in found.collect()) == want and "count(1)" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def disk(index, tmp_path_factory):
    return index_on_disk(index, str(tmp_path_factory.mktemp("disk")), 3, lazy=True)
