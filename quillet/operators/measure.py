"""Benchmarks of an index: searches by structure, and codecs of postings. Times are of whole Spark jobs into a sink that keeps nothing."""

from __future__ import annotations

import time
from collections.abc import Callable
from statistics import mean

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.functions import codecs
from quillet.operators import retrieval
from quillet.operators.compressed import METHODS, index_parts
from quillet.operators.index import Index

#: Runs before the timed ones, and timed runs, of a search; runs of a codec, of which the fastest and the slowest are left out.
WARM, RUNS, CODEC_RUNS = 5, 100, 10
STRUCTURES = ("index", "matrix")


def _micros(run: Callable[[], DataFrame]) -> float:
    began = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return (time.perf_counter() - began) * 1e6


def _matrix_hits(index: Index, kind: str, terms: list[str]) -> DataFrame:
    """The same searches over a 0/1 column for each term."""
    flag = [F.col(f"`{t}`") == 1 for t in terms]
    verdict = {"term": flag[0], "and": flag[0] & flag[-1], "or": flag[0] | flag[-1], "not": ~flag[0]}[kind]
    return index.matrix(list(dict.fromkeys(terms))).where(verdict).select("doc_id")


def search_times(index: Index, terms: list[str], warm: int = WARM, runs: int = RUNS) -> DataFrame:
    """query (the kind and its terms), structure, micros (the mean), winner: each term, AND of neighbours (two at most), OR and NOT, over both structures."""
    asked = [("term", [t]) for t in terms] + [("and", list(p)) for p in zip(terms, terms[1:], strict=False)][:2] + ([("or", terms[:2])] if len(terms) > 1 else []) + [("not", terms[:1])]
    rows = []
    for kind, own in asked:
        by_index = {
            "term": lambda t: retrieval.term_search(index, t[0]),
            "and": lambda t: retrieval.and_search(index, t[0], t[-1]),
            "or": lambda t: retrieval.or_search(index, t[0], t[-1]),
            "not": lambda t: retrieval.not_search(index, t[0]),
        }[kind]
        took = {}
        for structure in STRUCTURES:
            run = (lambda f=by_index, t=own: f(t)) if structure == "index" else (lambda k=kind, t=own: _matrix_hits(index, k, t))
            for _ in range(warm):
                _micros(run)
            took[structure] = mean(_micros(run) for _ in range(runs))
        winner = min(STRUCTURES, key=took.get)
        rows += [(f"{kind} {' '.join(own)}", structure, took[structure], structure == winner) for structure in STRUCTURES]
    return index.docs.sparkSession.createDataFrame(rows, "query string, structure string, micros double, winner boolean")


def trimmed_mean(times: list[float]) -> float:
    """Without the least and the greatest, where there are three or more."""
    own = sorted(times)
    return mean(own[1:-1] if len(own) > 2 else own)


def codec_times(index: Index, runs: int = CODEC_RUNS) -> DataFrame:
    """method, encode_ms, decode_ms, original_bytes, coded_bytes and correct, for the postings of all terms."""
    ids = index_parts(index).persist()
    rows = []
    try:
        for method in METHODS:
            encode, decode = (codecs.vbyte_encode, codecs.vbyte_decode) if method == "vbyte" else (codecs.gamma_encode, codecs.gamma_decode)
            coded = ids.select("ids", encode("ids", gaps=True).alias("code")).persist()
            totals = coded.agg(F.sum(F.size("ids") * 4).alias("a"), F.sum(F.octet_length("code")).alias("b"), F.bool_and(decode("code", gaps=True) == F.col("ids")).alias("c")).first()
            encoding = trimmed_mean([_micros(lambda e=encode: ids.select(e("ids", gaps=True))) for _ in range(runs)])
            decoding = trimmed_mean([_micros(lambda d=decode, c=coded: c.select(d("code", gaps=True))) for _ in range(runs)])
            rows.append((method, encoding / 1000, decoding / 1000, totals.a or 0, totals.b or 0, totals.c is not False))
            coded.unpersist()
    finally:
        ids.unpersist()
    return index.docs.sparkSession.createDataFrame(rows, "method string, encode_ms double, decode_ms double, original_bytes bigint, coded_bytes bigint, correct boolean")
