"""The pipeline's stages, each against a brute-force version on its own input."""

import hashlib

import sentencepiece
from test_small import SCHEMA, WORDS, brute_components, brute_hits, brute_lines, brute_rules, corpus

import corpus_pipeline
from quillet.llm import queries


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(9)
    rows = [*corpus(3), *((500 + k, " ".join(rng.choices(WORDS, k=80)), "fr", "s1", 7) for k in range(10))]
    items = [(1, " ".join(rows[-1][1].split()[10:25]))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "benchmark_decontamination", "sentencepiece_encoding"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        was = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        now = {r.doc_id: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality_rules":
            assert {i: r.text for i, r in now.items()} == brute_rules(was)
        elif name == "line_dedup":
            expected = {i: x[2] for i, x in brute_lines(was).items() if not x[1] or x[2].split()}
            assert {i: r.text or "" for i, r in now.items()} == expected
        elif name == "ngram_join":
            assert set(now) == {c for _, c in brute_components(was).values()}
        elif name == "benchmark_decontamination":
            assert set(now) == {r[0] for r in was if not brute_hits(r[1], items)[-1]} and 509 not in now
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
            sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
            encoded = {r[0]: library.encode(r[1]) for r in was}
            assert {i: (r.ids, r.n_tokens, r.ids_sha256, r.decoded_sha256) for i, r in now.items()} == {i: (x, len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for i, x in encoded.items()}
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(now)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_line_dedup_bounds_what_moves(spark):
    """Python gets whole texts by some bytes at once, not by the 10,000; the text is moved once to the place where lines go, not thrice."""
    import re

    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    spark.conf.unset(name)
    docs = spark.createDataFrame(corpus(3), SCHEMA)
    out = corpus_pipeline.line_dedup(spark, docs, "")
    texts = spark.range(0, 4000, 1, 1).selectExpr("repeat('words ', 500) as text").mapInArrow(sizes, "n bigint")
    most = max(r.n for r in texts.collect())
    spark.conf.set(name, "1000")
    corpus_pipeline.line_dedup(spark, docs, "")
    kept = spark.conf.get(name)
    spark.conf.set(name, was)
    assert most < 2 << 20 and kept == "1000"
    assert not re.search(r"\btext, text#", out._jdf.queryExecution().optimizedPlan().toString())
