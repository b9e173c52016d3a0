"""The index of a collection: tables that are built from the token table when first asked for, and its storage."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillet.functions.text import tokens as tokenise
from quillet.functions.porter2 import stem_column
from quillet.functions.text import plain, words
from quillet.operators.blocks import blocks_of, can_block, frequencies_of, postings_of, sorted_blocks, sorted_keys
from quillet.session import partitions_for

#: Zones with their weights, which sum to 1.
ZONES = {"TITLE": "0.40", "AUTHOR": "0.20", "SUBJECT": "0.25", "BODY": "0.15"}


class Index:
    """docs (doc_id, filename, size_bytes) and tokens (doc_id, pos, term), and what follows from them. Zones (doc_id, zone, text) are optional.

    analysed (doc_id, words, and plain, the text that they are split from; a row for each document) is there when the index is built from documents: then what is known within a
    document is made within its row, without a shuffle of tokens. Token tables from elsewhere are grouped.

    on_disk says that postings are a table sorted by term, which lookups read in place of tokens.

    Nothing is cached here: persist() the tokens, or save() the index and load() it, for more than one query.
    """

    def __init__(self, docs: DataFrame, tokens: DataFrame, zones: DataFrame | None = None, analysed: DataFrame | None = None):
        self.docs, self.tokens, self.zones, self.analysed = docs, tokens, zones, analysed
        self.on_disk = False

    @cached_property
    def inverted(self) -> DataFrame:
        """term, doc_id; distinct."""
        if self.analysed is not None:
            return self.analysed.select("doc_id", F.explode(F.array_distinct("words")).alias("term")).where("term <> ''").select("term", "doc_id")
        return self.tokens.select("term", "doc_id").distinct()

    @cached_property
    def blocks(self) -> DataFrame | None:
        """The postings of blocks of documents: term, docs, ends, positions, n, cf (operators.blocks), a term in any number of rows; None where they are grouped from tokens."""
        return blocks_of(self.analysed) if self.analysed is not None and can_block(self.analysed) else None

    @cached_property
    def postings(self) -> DataFrame:
        """term, doc_id, tf, positions (ascending)."""
        if self.blocks is None:
            return self.tokens.groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
        return postings_of(self.blocks)

    @cached_property
    def biwords(self) -> DataFrame:
        """biword (two adjacent terms of one document, joined by a space), doc_id; distinct."""
        if self.analysed is not None:
            own = F.filter("words", lambda w: w != "")
            pairs = F.zip_with(own, F.slice(own, 2, F.greatest(F.size(own), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
            return self.analysed.select("doc_id", F.explode(F.array_distinct(pairs)).alias("biword")).where("biword is not null").select("biword", "doc_id")
        behind = F.lead("term").over(Window.partitionBy("doc_id").orderBy("pos"))
        return self.tokens.select("doc_id", "term", behind.alias("behind")).where("behind is not null").select(F.concat_ws(" ", "term", "behind").alias("biword"), "doc_id").distinct()

    @cached_property
    def frequencies(self) -> DataFrame:
        """term, doc_id, tf."""
        if self.blocks is not None:
            return frequencies_of(self.blocks)
        return self.tokens.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))

    @cached_property
    def lexicon(self) -> DataFrame:
        """term, df (documents), cf (occurrences)."""
        if self.blocks is not None:
            return self.blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))
        return self.frequencies.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    @cached_property
    def permuterm(self) -> DataFrame:
        """rotation, term: each rotation of `term$`."""
        marked = F.concat("term", F.lit("$"))
        turn = lambda i: F.concat(F.substring(marked, i, F.length(marked)), F.left(marked, i - 1))
        return self.terms.select("term", F.explode(F.transform(F.sequence(F.lit(1), F.length(marked)), turn)).alias("rotation"))

    @cached_property
    def trigrams(self) -> DataFrame:
        """gram, term: each window of three characters of `$term$`."""
        marked = F.concat(F.lit("$"), "term", F.lit("$"))
        gram = lambda i: F.substring(marked, i, F.lit(3))
        return self.terms.select("term", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(marked) - 2), gram))).alias("gram"))

    @cached_property
    def reverse_terms(self) -> DataFrame:
        """rev, term."""
        return self.terms.select(F.reverse("term").alias("rev"), "term")

    @cached_property
    def terms(self) -> DataFrame:
        """The distinct terms."""
        return (self.tokens if self.blocks is None else self.blocks).select("term").distinct()

    @cached_property
    def zone_postings(self) -> DataFrame:
        """zone, term, doc_id; distinct."""
        if self.zones is None:
            raise ValueError("this index has no zones")
        return self.zones.select("zone", "doc_id", F.explode(words("text")).alias("term")).where("term <> ''").distinct().select("zone", "term", "doc_id")

    def holding(self, terms: DataFrame) -> DataFrame:
        """term, doc_id of the given terms (distinct): rows of blocks meet the terms before their documents are opened."""
        if self.blocks is None:
            return self.inverted.join(terms, "term", "left_semi").select("term", "doc_id")
        return self.blocks.select("term", "docs").join(terms, "term", "left_semi").select("term", F.explode("docs").alias("doc_id"))

    def matrix(self, terms: list[str]) -> DataFrame:
        """The incidence of the given terms: doc_id and a 0/1 column for each. All documents have a row."""
        flags = self.tokens.where(F.col("term").isin(terms)).groupBy("doc_id").pivot("term", terms).agg(F.first(F.lit(1)))
        return self.docs.select("doc_id").join(flags, "doc_id", "left").fillna(0, terms)

    def keys(self, kind: str) -> DataFrame:
        """key, doc_id of a structure: index, matrix and positional know terms, biword knows pairs."""
        if kind == "biword":
            return self.biwords.withColumnRenamed("biword", "key")
        if kind in ("index", "matrix", "positional"):
            return self.inverted.select(F.col("term").alias("key"), "doc_id")
        raise ValueError(f"no structure named {kind}")

    def add(self, other: Index) -> Index:
        """This index with the documents of another that it doesn't have (by file name)."""
        new = other.docs.join(self.docs.select("filename"), "filename", "left_anti").select("doc_id", "filename", "size_bytes")
        own = lambda df: df.join(new.select("doc_id"), "doc_id", "left_semi")
        zones = self.zones.unionByName(own(other.zones)) if self.zones is not None and other.zones is not None else self.zones
        analysed = self.analysed.unionByName(own(other.analysed)) if self.analysed is not None and other.analysed is not None else None
        return Index(self.docs.unionByName(new), self.tokens.unionByName(own(other.tokens)), zones, analysed)

    def without(self, ids: DataFrame) -> Index:
        """This index without the documents of `ids` (doc_id); without all of them it is cleared."""
        own = lambda df: df.join(ids.select("doc_id"), "doc_id", "left_anti") if df is not None else None
        return Index(own(self.docs), own(self.tokens), own(self.zones), own(self.analysed))

    def reindex(self, other: Index) -> Index:
        """This index with all documents of another; those of a file name that it has are replaced."""
        old = self.docs.join(other.docs.select("filename"), "filename", "left_semi")
        return self.without(old).add(other)

    def persist(self) -> Index:
        (self.tokens if self.analysed is None else self.analysed).persist()
        return self

    def close(self) -> None:
        (self.tokens if self.analysed is None else self.analysed).unpersist()


def build_index(documents: DataFrame, id_col: str = "doc_id", text: str = "text", filename: str | None = None, stem: bool = False, zones: DataFrame | None = None) -> Index:
    """An index of any table with an id (different in all rows) and a text."""
    name = F.col(filename) if filename else F.concat(F.lit("doc-"), F.col(id_col).cast("string"))
    docs = documents.select(F.col(id_col).alias("doc_id"), name.alias("filename"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size_bytes"))
    if stem:
        index = Index(docs, tokenise(documents, id_col, text, stem), zones)
        whole = build_index(documents, id_col, text, filename)
        if whole.blocks is not None:
            # rows of terms meet their stems before their documents are opened
            stems = whole.terms.select("term", stem_column("term").alias("stem"))
            index.__dict__["inverted"] = whole.blocks.select("term", "docs").join(stems, "term").select(F.col("stem").alias("term"), F.explode("docs").alias("doc_id")).distinct()
        return index
    analysed = documents.where(F.col(text).isNotNull()).select(F.col(id_col).alias("doc_id"), words(text).alias("words"), plain(text).alias("plain"))
    return Index(docs, analysed.select("doc_id", F.posexplode("words").alias("pos", "term")).where("term <> ''"), zones, analysed)


def from_postings(docs: DataFrame, postings: DataFrame) -> Index:
    """An index from its positional postings alone; all else is derived again."""
    tokens = postings.select("doc_id", F.explode("positions").alias("pos"), "term")
    return Index(docs, tokens)


#: What an index on disk holds besides postings and documents: each table sorted by its first column, so that lookups and prefixes skip row groups.
VIEWS = {"lexicon": "term", "reverse_terms": "rev", "permuterm": "rotation", "trigrams": "gram", "biwords": "biword"}
#: Columns of the postings on disk: those of Index.blocks.
BLOCKS = ("term", "docs", "ends", "positions", "n", "cf")


class DiskIndex(Index):
    """An index in a folder. Postings are rows of terms sorted by term; the views are sorted tables. A table that isn't in the folder yet is made of `source`, or of other
    tables in the folder, and written, when it is first asked for: all others are read."""

    def __init__(self, docs: DataFrame, path: str, source: Index | None = None, partitions: int | None = None):
        self.path, self.source, self.partitions, self.spark = path, source, partitions, docs.sparkSession
        self.zones = self.analysed = None
        self.docs, self.on_disk = docs, True

    def _table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        where = f"{self.path}/{name}"
        if self.source is not None:
            make().write.mode("overwrite").parquet(where)
        return self.spark.read.parquet(where)

    def _ranged(self, df: DataFrame, *order: str) -> DataFrame:
        return df.repartitionByRange(self._count, *order).sortWithinPartitions(*order)

    @cached_property
    def _count(self) -> int:
        return self.partitions or partitions_for(self.source.tokens)

    def _inverted_by(self, key: str) -> DataFrame:
        """The source's blocks in order."""
        if self.source.blocks is not None:
            return sorted_blocks(self.source.analysed, key, self.source.docs.count(), self._count)
        if key == "biword":
            return self._ranged(self.source.biwords, key, "doc_id").select(key, F.array("doc_id").alias("docs"))
        own = self._ranged(self.source.postings, key, "doc_id")
        return own.select("term", F.array("doc_id").alias("docs"), F.array("tf").alias("ends"), "positions", F.lit(1).cast("long").alias("n"), F.col("tf").cast("long").alias("cf"))

    @cached_property
    def blocks(self) -> DataFrame:
        return self._table("postings", lambda: self._inverted_by("term").select(*BLOCKS))

    @cached_property
    def inverted(self) -> DataFrame:
        return self.blocks.select("term", F.explode("docs").alias("doc_id"))

    @cached_property
    def biwords(self) -> DataFrame:
        return self._table("biwords", lambda: self._inverted_by("biword")).select("biword", F.explode("docs").alias("doc_id"))

    @cached_property
    def tokens(self) -> DataFrame:
        return self.postings.select("doc_id", F.explode("positions").alias("pos"), "term")

    @cached_property
    def lexicon(self) -> DataFrame:
        return self._table("lexicon", lambda: self._ranged(super(DiskIndex, self).lexicon, "term"))

    @cached_property
    def terms(self) -> DataFrame:
        return self.lexicon.select("term")

    @cached_property
    def reverse_terms(self) -> DataFrame:
        return self._table("reverse_terms", lambda: self._ranged(super(DiskIndex, self).reverse_terms, "rev", "term"))

    @cached_property
    def permuterm(self) -> DataFrame:
        return self._table("permuterm", lambda: sorted_keys(self.terms, "rotation", self._count))

    @cached_property
    def trigrams(self) -> DataFrame:
        return self._table("trigrams", lambda: sorted_keys(self.terms, "gram", self._count))


def index_on_disk(index: Index, path: str, partitions: int | None = None, lazy: bool = False) -> DiskIndex:
    """Written so that a lookup reads the row groups whose range holds its term: the documents, the postings and, made of these, the views; biwords come from the documents' words.

    lazy: postings and views are written when a query first asks for them, so a folder that one query is asked of holds what that query reads. Else all are there on return.
    """
    spark = index.docs.sparkSession
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    made = DiskIndex(spark.read.parquet(f"{path}/docs"), path, index, partitions)
    if lazy:
        return made
    for name in ("blocks", *VIEWS):
        getattr(made, name)
    return open_on_disk(spark, path)


def open_on_disk(spark: SparkSession, path: str) -> DiskIndex:
    """A whole index that was written; its queries read the sorted tables."""
    return DiskIndex(spark.read.parquet(f"{path}/docs"), path)


def disk_statistics(spark: SparkSession, path: str) -> dict[str, int]:
    """Files and bytes of an index on disk, by table, as `name_files` and `name_bytes`; the file system is asked, no data are read."""
    out = {}
    for name in ("docs", "postings", *VIEWS):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        summary = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder)
        out |= {f"{name}_files": summary.getFileCount(), f"{name}_bytes": summary.getLength()}
    return out
