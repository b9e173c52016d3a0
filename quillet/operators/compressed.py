"""A compressed index: the dictionary front coded, and a byte code for the postings of each term.

The postings of a term are coded in parts of doc_id ranges, so that no row holds a frequent term's whole list; a part's ids are coded as they
are, the first as a gap to 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.functions import codecs
from quillet.operators.index import Index
from quillet.session import Stored, small_batches

METHODS = ("vbyte", "gamma")
#: doc_ids of a part.
PART = 1 << 20


def posting_parts(inverted: DataFrame, width: int = PART) -> DataFrame:
    """term, part, ids (ascending): the documents of a term by ranges of `width` ids."""
    return inverted.groupBy("term", F.expr(f"doc_id div {width}").alias("part")).agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))


def index_parts(index: Index, width: int = PART) -> DataFrame:
    """posting_parts() of an index; rows of blocks are gathered, not pairs. Rows are handed to Python by small batches, as one may hold `width` ids."""
    small_batches(index.docs.sparkSession)
    if index.blocks is None:
        return posting_parts(index.inverted, width)
    held = index.blocks.select("term", "docs", F.explode(F.array_distinct(F.expr(f"transform(docs, d -> d div {width})"))).alias("part"))
    own = held.select("term", "part", F.expr(f"filter(docs, d -> d div {width} = part)").alias("docs"))
    return own.groupBy("term", "part").agg(F.sort_array(F.flatten(F.collect_list("docs"))).alias("ids"))


def _carried(lists: DataFrame, value: Column, name: str, how: Callable[[Column], Column]) -> DataFrame:
    """lists with what the parts before each one leave to it: a narrow row for each part is ordered, lists stay where they are."""
    before = Window.partitionBy("term").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    narrow = lists.select("term", "part", value.alias("__v")).withColumn(name, F.coalesce(how(F.col("__v")).over(before), F.lit(0))).drop("__v")
    return lists.join(narrow, ["term", "part"])


def gap_lists(index: Index, width: int = PART) -> DataFrame:
    """term, part, ids, gaps: the difference of each id to the term's id before it, which may be the last of an earlier part; the first: to 0."""
    held = Stored(index_parts(index, width), "parts").df
    led = _carried(held, F.element_at("ids", -1), "led", lambda v: F.last(v))
    # pairs of neighbours, the first with the id that came before the part
    return led.select("term", "part", "ids", F.zip_with(F.slice(F.concat(F.array("led"), "ids"), 1, F.size("ids")), "ids", lambda a, b: b - a).alias("gaps"))


def posting_gaps(index: Index) -> DataFrame:
    """term, doc_id, gap."""
    if index.blocks is None:
        return codecs.posting_gaps(index.inverted)
    return gap_lists(index).select("term", F.explode(F.arrays_zip("ids", "gaps")).alias("p")).select("term", F.col("p.ids").alias("doc_id"), F.col("p.gaps").alias("gap"))


def lost_by_gaps(index: Index, width: int = PART) -> DataFrame:
    """wrong: how many postings the running sums of gap_lists() don't give back at their place, those that no list holds among them; one row."""
    lists = Stored(gap_lists(index, width), "gaps").df
    total = F.aggregate("gaps", F.lit(0).cast("bigint"), lambda a, g: a + g)
    back = _carried(lists, total, "carried", lambda v: F.sum(v)).select("ids", codecs.running_sums("gaps", "carried").alias("back"))
    kept = back.agg(F.coalesce(F.sum(F.aggregate(F.zip_with("ids", "back", lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0)).alias("kept"))
    there = index.blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("there"))
    # one row with one row
    return there.join(F.broadcast(kept)).select((F.col("there") - F.col("kept")).alias("wrong"))


@dataclass
class CompressedIndex:
    """dictionary (block, code, original, coded), made when first asked for, and postings (term, part, code, n)."""

    words: DataFrame
    postings: DataFrame
    method: str
    block: int = 8

    @cached_property
    def dictionary(self) -> DataFrame:
        return codecs.front_code(self.words, self.block)

    def _decoded(self, postings: DataFrame) -> DataFrame:
        decode = codecs.vbyte_decode if self.method == "vbyte" else codecs.gamma_decode
        return postings.select("term", F.explode(decode("code", gaps=True)).alias("doc_id"))

    def terms(self) -> DataFrame:
        return codecs.front_decode(self.dictionary).select("term")

    def term_search(self, term: str) -> DataFrame:
        """doc_id: only the codes of the term are decoded."""
        return self._decoded(self.postings.where(F.col("term") == term)).select("doc_id")

    def inverted(self) -> DataFrame:
        """term, doc_id."""
        return self._decoded(self.postings)

    def sizes(self) -> DataFrame:
        """original_dictionary, coded_dictionary (characters), original_postings (4 bytes an id), coded_postings, ratio (in per cent, 0 of nothing): one row."""
        words = self.dictionary.agg(F.coalesce(F.sum("original"), F.lit(0)).alias("original_dictionary"), F.coalesce(F.sum("coded"), F.lit(0)).alias("coded_dictionary"))
        lists = self.postings.agg(F.coalesce(F.sum(F.col("n") * 4), F.lit(0)).alias("original_postings"), F.coalesce(F.sum(F.octet_length("code").cast("long")), F.lit(0)).alias("coded_postings"))
        before, after = F.col("original_dictionary") + F.col("original_postings"), F.col("coded_dictionary") + F.col("coded_postings")
        # one row with one row
        return words.join(F.broadcast(lists)).withColumn("ratio", F.round(F.when(before > 0, after * 100.0 / before).otherwise(0.0), 4))


def compress(index: Index, method: str = "vbyte", block: int = 8, width: int = PART) -> CompressedIndex:
    if method not in METHODS:
        raise ValueError(f"no method named {method}")
    encode = codecs.vbyte_encode if method == "vbyte" else codecs.gamma_encode
    parts = index_parts(index, width)
    return CompressedIndex(index.terms, parts.select("term", "part", encode("ids", gaps=True).alias("code"), F.size("ids").cast("long").alias("n")), method, block)
