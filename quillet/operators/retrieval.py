"""Term, boolean, phrase and proximity queries. All give doc_id (distinct) unless said otherwise; no hit is an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.functions.text import analyse
from quillet.operators.index import Index
from quillet.plans.boolean import compile_rpn, operands, to_rpn


def term_search(index: Index, term: str, kind: str = "index") -> DataFrame:
    return index.keys(kind).where(F.col("key") == term).select("doc_id").distinct()


def _flagged(index: Index, terms: list[str], kind: str) -> DataFrame:
    """doc_id and f0, f1, ...: the documents with any of the terms, one pre-aggregated shuffle whatever the number of terms."""
    hits = index.keys(kind).where(F.col("key").isin(terms))
    return hits.groupBy("doc_id").agg(*[F.max(F.when(F.col("key") == t, 1).otherwise(0)).alias(f"f{i}") for i, t in enumerate(terms)])


def and_search(index: Index, a: str, b: str, kind: str = "index") -> DataFrame:
    return _flagged(index, [a, b], kind).where("f0 = 1 and f1 = 1").select("doc_id")


def or_search(index: Index, a: str, b: str, kind: str = "index") -> DataFrame:
    return index.keys(kind).where(F.col("key").isin(a, b)).select("doc_id").distinct()


def not_search(index: Index, term: str, universe: DataFrame | None = None, kind: str = "index") -> DataFrame:
    """The universe (all registered documents, empty ones too) without the hits."""
    return (index.docs if universe is None else universe).select("doc_id").join(term_search(index, term, kind), "doc_id", "left_anti")


def boolean_query(index: Index, query: str, mode: str = "compat", kind: str = "index") -> DataFrame:
    """A query in AND, OR, NOT and parentheses (plans.boolean says how the modes differ)."""
    rpn = to_rpn(query, mode)
    terms = operands(rpn)
    verdict = compile_rpn(rpn, {t: F.coalesce(F.col(f"f{i}"), F.lit(0)) == 1 for i, t in enumerate(terms)})
    return index.docs.select("doc_id").join(_flagged(index, terms, kind), "doc_id", "left").where(verdict).select("doc_id")


def places_of(index: Index, terms: list[str]) -> DataFrame:
    """term, doc_id, pos of some terms: the filter is on the term column, before positions are opened."""
    if index.on_disk:
        return index.postings.where(F.col("term").isin(terms)).select("term", "doc_id", F.explode("positions").alias("pos"))
    return index.tokens.where(F.col("term").isin(terms)).select("term", "doc_id", "pos")


def phrase_search(index: Index, phrase: str, method: str = "positional", stem: bool = False, raw: bool = False) -> DataFrame:
    """Documents with the phrase. positional: at consecutive places. biword: with all its adjacent pairs, wherever (false hits from three words on).

    raw: the words as they stand, one word allowed; else they are analysed and a phrase of fewer than two words has no hits.
    """
    if method not in ("positional", "biword"):
        raise ValueError("phrases need the positional or the biword structure")
    terms = phrase.split() if raw else analyse(phrase or "", stem)
    if len(terms) < (1 if raw else 2):
        return index.docs.select("doc_id").limit(0)
    if method == "biword" and len(terms) > 1:
        pairs = sorted({f"{a} {b}" for a, b in zip(terms, terms[1:], strict=False)})
        hits = index.biwords.where(F.col("biword").isin(pairs))
        return hits.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(pairs)).select("doc_id")
    places = index.docs.sparkSession.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, off int")
    if index.on_disk:
        # a row for each of the phrase's places in a document, with where the phrase would begin: lists are met, so no task counts the places of a frequent word one by one
        rows = index.postings.where(F.col("term").isin(terms)).join(F.broadcast(places), "term").select("doc_id", F.expr("transform(positions, p -> p - off)").alias("starts"))
        met = rows.repartition("doc_id").groupBy("doc_id").agg(F.collect_list("starts").alias("all")).where(F.size("all") == len(terms))
        return met.where(F.size(F.expr("aggregate(slice(all, 2, size(all)), all[0], (a, b) -> array_intersect(a, b))")) > 0).select("doc_id")
    starts = places_of(index, terms).join(F.broadcast(places), "term").groupBy("doc_id", (F.col("pos") - F.col("off")).alias("start")).agg(F.count("*").alias("n"))
    return starts.where(F.col("n") == len(terms)).select("doc_id").distinct()


def proximity_matches(index: Index, a: str, b: str, k: int) -> DataFrame:
    """doc_id, position1, position2, distance: all places of a and b at most k apart, in either order."""
    x = places_of(index, [a]).select("doc_id", F.col("pos").alias("position1"))
    y = places_of(index, [b]).select("doc_id", F.col("pos").alias("position2"))
    gap = F.abs(F.col("position2") - F.col("position1"))
    return x.join(y, (x.doc_id == y.doc_id) & (gap <= k)).select(x.doc_id, "position1", "position2", gap.cast("int").alias("distance"))


def proximity_docs(index: Index, a: str, b: str, k: int) -> DataFrame:
    """k below 1 or a blank term: nothing; k = 1: a directly before b; else either order."""
    if k < 1 or not (a or "").strip() or not (b or "").strip():
        return index.docs.select("doc_id").limit(0)
    if k == 1:
        return term_search(index, f"{a} {b}", "biword")
    # whether any pair is near needs no pairs: a place of one term and the last place of the other before it
    return _nearest(index, a, b).where(F.col("near") <= k).select("doc_id").distinct()


def _nearest(index: Index, a: str, b: str) -> DataFrame:
    from pyspark.sql import Window

    if a == b:
        return places_of(index, [a]).select("doc_id", F.lit(0).alias("near"))
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda t: F.last(F.when(F.col("term") == t, F.col("pos")), ignorenulls=True).over(upto)
    both = places_of(index, [a, b]).select("doc_id", "pos", F.abs(last(a) - last(b)).alias("near"))
    return both.where("near is not null")


def proximity_counts(index: Index, a: str, b: str, k: int) -> DataFrame:
    """doc_id, matches."""
    return proximity_matches(index, a, b, k).groupBy("doc_id").agg(F.count("*").alias("matches"))


def document_names(index: Index, ids: DataFrame) -> DataFrame:
    """The sorted file names of ids; unknown ids are dropped."""
    return index.docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "filename").orderBy("filename")
