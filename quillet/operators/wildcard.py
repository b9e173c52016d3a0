"""Wildcard queries over the terms: `*` is any run of characters; `?` is a character of its own unless `single` says it is any one."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.operators.index import Index
from quillet.session import checkpoint

#: Terms that are broadcast, some 30 MB; more are joined over a shuffle.
BROADCAST_TERMS = 200_000
STRATEGIES = ("permuterm", "btree", "three_gram", "scan")


def to_regex(query: str, single: bool = False) -> str:
    """The query as an anchored pattern."""
    piece = lambda c: ".*" if c == "*" else "." if c == "?" and single else re.sub(r"([^\w])", r"\\\1", c)
    return "^" + "".join(map(piece, query)) + "$"


def prefix_terms(index: Index, prefix: str) -> DataFrame:
    """Pushed to a Parquet scan as StringStartsWith."""
    return index.terms.where(F.col("term").startswith(prefix))


def terms_where(index: Index, condition: Column) -> DataFrame:
    """The terms that any condition on the column `term` holds for, in order: a scan of the lexicon, with what of it Parquet can push down."""
    return index.terms.where(condition).orderBy("term")


def suffix_terms(index: Index, suffix: str) -> DataFrame:
    return index.reverse_terms.where(F.col("rev").startswith(suffix[::-1])).select("term")


def permuterm_terms(index: Index, query: str) -> DataFrame:
    """A query with at most one `*`: the rotations that start with what stands behind it, `$`, and what stands before it."""
    if query.count("*") > 1:
        raise ValueError("a permuterm query has one * at most")
    if "*" not in query:
        return index.terms.where(F.col("term") == query)
    before, behind = query.split("*")
    return index.permuterm.where(F.col("rotation").startswith(f"{behind}${before}")).select("term").distinct()


def trigram_terms(index: Index, query: str, single: bool = False) -> DataFrame:
    """Terms with all grams of the query's fixed parts, checked by the pattern; without such grams all terms are checked."""
    marked = re.sub(r"\*+", "*", f"${query}$")
    any_ = "*?" if single else "*"
    grams = sorted({marked[i : i + 3] for i in range(len(marked) - 2) if not set(any_) & set(marked[i : i + 3])})
    if not grams:
        return index.terms.where(F.col("term").rlike(to_regex(query, single)))
    found = index.trigrams.where(F.col("gram").isin(grams)).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    return found.where(F.col("term").rlike(to_regex(query, single))).select("term")


def btree_terms(index: Index, query: str) -> DataFrame:
    """No `*`: the term itself; `*` last: a prefix; `*` first: a suffix; elsewhere: by rotations."""
    stars = query.count("*")
    if stars > 1:
        raise ValueError("a tree query has one * at most")
    if not stars:
        return index.terms.where(F.col("term") == query)
    if query.endswith("*"):
        return prefix_terms(index, query[:-1])
    return suffix_terms(index, query[1:]) if query.startswith("*") else permuterm_terms(index, query)


def wildcard_terms(index: Index, query: str, strategy: str = "permuterm", single: bool = False) -> DataFrame:
    """term. All strategies give the same terms; queries with several `*`, or with `?` as any character, go to the 3-grams."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy named {strategy}")
    if strategy == "scan":
        return index.terms.where(F.col("term").rlike(to_regex(query, single)))
    if strategy == "three_gram" or query.count("*") > 1 or single and "?" in query:
        return trigram_terms(index, query, single)
    return btree_terms(index, query) if strategy == "btree" else permuterm_terms(index, query)


def wildcard_search(index: Index, query: str, strategy: str = "permuterm", single: bool = False) -> DataFrame:
    """term, doc_id; distinct, sorted by term.

    The terms and what is found are written before they are used again: the order's ranges are told from what it sorts, which would be made twice.
    """
    terms = checkpoint(wildcard_terms(index, query, strategy, single).select("term"))
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    return checkpoint(index.holding(F.broadcast(terms) if few else terms)).orderBy("term", "doc_id")
