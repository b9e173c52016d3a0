"""Statistics of the index, the most frequent terms, and the compression report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.functions import codecs
from quillet.operators.compressed import lost_by_gaps, posting_gaps
from quillet.operators.index import Index


def stats(index: Index, kind: str = "index") -> DataFrame:
    """documents, unique_keys, occurrences, total_bytes: one row. Occurrences are distinct (key, document) but tokens for positional."""
    docs = index.docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))
    if kind == "positional":
        keyed = index.tokens.groupBy("term").agg(F.count("*").alias("n"))
    else:
        keyed = index.keys(kind).distinct().groupBy("key").agg(F.count("*").alias("n"))
    counts = keyed.agg(F.count("*").alias("unique_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"))
    # one row with one row
    return docs.join(F.broadcast(counts)).select("documents", "unique_keys", "occurrences", "total_bytes")


def derived_stats(index: Index) -> DataFrame:
    """Means a document, and the sizes of the wildcard structures, from the terms alone."""
    base = stats(index, "index")
    sizes = index.terms.agg(F.coalesce(F.sum(F.length("term") + 1), F.lit(0)).alias("rotations"))
    grams = index.trigrams.agg(F.countDistinct("gram").alias("grams"))
    mean = lambda c: F.round(F.when(F.col("documents") > 0, F.col(c) / F.col("documents")).otherwise(0.0), 6)
    return base.join(F.broadcast(sizes)).join(F.broadcast(grams)).select("documents", "unique_keys", mean("occurrences").alias("occurrences_per_doc"), mean("total_bytes").alias("bytes_per_doc"), mean("unique_keys").alias("terms_per_doc"), "rotations", "grams")


def top_terms(index: Index, n: int) -> DataFrame:
    """term, df: the n terms of most documents, then by term."""
    if n <= 0:
        raise ValueError("n must be above 0")
    return index.inverted.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(n)


def build_metadata(unique_terms: int, documents: int, total_bytes: int, index_bytes: int, seconds: float = 0.0) -> dict[str, float]:
    """Ratios of a finished build; 0 where there is nothing to divide by. megabytes_per_second is of the documents."""
    return {
        "avg_terms_per_doc": unique_terms / documents if documents else 0.0,
        "compression_ratio": index_bytes / total_bytes * 100 if total_bytes else 0.0,
        "megabytes_per_second": total_bytes / 1e6 / seconds if seconds else 0.0,
    }


def measured_build(index: Index, path: str) -> dict[str, float]:
    """Write the index on disk; its build_metadata with the time that took and the sizes of the files."""
    import time

    from quillet.operators.index import disk_statistics, index_on_disk

    began = time.perf_counter()
    built = index_on_disk(index, path)
    seconds = time.perf_counter() - began
    docs = built.docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b")).first()
    sizes = disk_statistics(index.docs.sparkSession, path)
    return build_metadata(built.terms.count(), docs.n, docs.b, sum(v for k, v in sizes.items() if k.endswith("_bytes")), seconds)


def compression_report(index: Index, block: int = 8) -> DataFrame:
    """method (vbyte, gamma), and the sizes of dictionary (front coded, characters) and postings (4 bytes an id before), with percentages."""
    gaps = posting_gaps(index)
    per_term = gaps.groupBy("term").agg(F.count("*").alias("n"), F.sum(codecs.vbyte_size(F.col("gap"))).alias("v"), F.sum(codecs.gamma_size(F.col("gap") + 1)).alias("g"))
    totals = per_term.agg(F.sum(F.col("n") * 4).alias("original_postings"), F.sum("v").alias("vbyte"), F.sum(4 + F.ceil(F.col("g") / 8)).cast("long").alias("gamma"))
    words = codecs.front_code(index.terms, block).agg(F.sum("original").alias("original_dictionary"), F.sum("coded").alias("coded_dictionary"))
    both = totals.join(F.broadcast(words))
    each = both.select("original_dictionary", "coded_dictionary", "original_postings", F.explode(F.map_from_arrays(F.array(F.lit("vbyte"), F.lit("gamma")), F.array("vbyte", "gamma"))).alias("method", "coded_postings"))
    ratio = lambda a, b: F.round(F.col(a) * 100.0 / F.col(b), 4)
    return each.select("method", "original_dictionary", "coded_dictionary", ratio("coded_dictionary", "original_dictionary").alias("dictionary_percent"), "original_postings", "coded_postings", ratio("coded_postings", "original_postings").alias("postings_percent"))


def roundtrip_errors(index: Index) -> DataFrame:
    """wrong: postings that gaps and their running sums don't give back; one row."""
    if index.blocks is not None:
        return lost_by_gaps(index)
    back = codecs.undo_gaps(codecs.posting_gaps(index.inverted))
    return index.inverted.select("term", "doc_id").exceptAll(back).agg(F.count("*").alias("wrong"))
