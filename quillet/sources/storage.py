"""Saving an index and reading it back as parquet (binary), text or json; everything but postings and documents is derived again.

Each format is a folder that many tasks write, in sections: metadata (the next free doc_id), postings, and the registry of documents. parquet: a table each. text: `nextDocID: n`, lines
`term: 1[0, 5]; 2[3]`, and the registry twice, by id (`id: name`) and by name (`name: size`). json: lines with the same fields. Zones aren't saved. A term has a row or line for some of its
documents in each block of documents (operators.blocks), so that none holds a frequent term's whole list and saving moves nothing between tasks. Folders with a row for each term and document are read as well.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.operators.blocks import postings_of
from quillet.operators.index import Index, from_postings
from quillet.session import lean

FORMATS = ("parquet", "text", "json")
DOCS = "doc_id bigint, filename string, size_bytes bigint"


#: doc_ids of one line of text.
RANGE = 1 << 20


def term_lines(postings: DataFrame, width: int = RANGE) -> DataFrame:
    """value: a line for each term and range of ids."""
    one = F.concat(F.col("doc_id").cast("string"), F.lit("["), F.array_join(F.col("positions").cast("array<string>"), ", "), F.lit("]"))
    gathered = postings.groupBy("term", F.expr(f"doc_id div {width}").alias("part")).agg(F.array_sort(F.collect_list(F.struct("doc_id", one.alias("p")))).alias("ps"))
    return gathered.select(F.concat("term", F.lit(": "), F.array_join(F.transform("ps", lambda x: x["p"]), "; ")).alias("value"))


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, docs, ps: the text `1[0, 5]` of each doc."""
    for batch in batches:
        if not len(batch):
            continue
        term, docs, ends, positions = (batch.column(n) for n in ("term", "docs", "ends", "positions"))
        sizes = ends.flatten().to_numpy().astype(np.int64)
        first = np.zeros(len(sizes), bool)
        first[np.cumsum(docs.value_lengths().to_numpy())[:-1]] = first[0] = True
        sizes = np.where(first, sizes, np.diff(sizes, prepend=0))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), positions.flatten().cast(pa.string()))
        one = pc.binary_join_element_wise(docs.flatten().cast(pa.string()), "[", pc.binary_join(lists, ", "), "]", "")
        edges = pa.array(np.concatenate([[0], np.cumsum(docs.value_lengths().to_numpy())]).astype(np.int32))
        yield pa.RecordBatch.from_pydict({"term": term, "docs": pa.ListArray.from_arrays(edges, docs.flatten()), "ps": pa.ListArray.from_arrays(edges, one)})


def block_texts(index: Index) -> DataFrame:
    kind = index.blocks.schema["docs"].dataType.elementType.simpleString()
    return index.blocks.select("term", "docs", "ends", "positions").mapInArrow(lean(_texts), f"term string, docs array<{kind}>, ps array<string>")


def index_lines(index: Index, width: int = RANGE) -> DataFrame:
    """term_lines() of an index; the texts of a block's documents are made at once, and rows of blocks are gathered."""
    if index.blocks is None:
        return term_lines(index.postings, width)
    held = block_texts(index).select("term", F.arrays_zip("docs", "ps").alias("xs"))
    own = held.select("term", "xs", F.explode(F.expr(f"array_distinct(transform(xs, x -> x.docs div {width}))")).alias("part"))
    one = own.select("term", "part", F.expr(f"filter(xs, x -> x.docs div {width} = part)").alias("xs"))
    gathered = one.groupBy("term", "part").agg(F.sort_array(F.flatten(F.collect_list("xs"))).alias("xs"))
    return gathered.select(F.concat("term", F.lit(": "), F.array_join(F.transform("xs", lambda x: x["ps"]), "; ")).alias("value"))


def block_lines(index: Index) -> DataFrame:
    """value: a line for each row of a block."""
    return block_texts(index).select(F.concat("term", F.lit(": "), F.array_join("ps", "; ")).alias("value"))


def next_doc_id(docs: DataFrame) -> DataFrame:
    """nextDocID: one row; 0 without documents."""
    return docs.agg((F.coalesce(F.max("doc_id"), F.lit(-1)) + 1).alias("nextDocID"))


def read_term_lines(lines: DataFrame) -> DataFrame:
    """term, doc_id, tf, positions."""
    at = F.instr("value", ": ")
    split = lines.where(at > 0).select(F.substring("value", F.lit(1), at - 1).alias("term"), F.explode(F.split(F.expr("substring(value, instr(value, ': ') + 2)"), "; ")).alias("p"))
    positions = F.split(F.regexp_extract("p", r"\[(.*)\]", 1), ", ").cast("array<int>")
    return split.select("term", F.regexp_extract("p", r"^\d+", 0).cast("bigint").alias("doc_id"), F.size(positions).alias("tf"), positions.alias("positions"))


def save(index: Index, path: str, fmt: str = "parquet") -> None:
    if fmt not in FORMATS:
        raise ValueError(f"no format named {fmt}")
    docs = index.docs.select("doc_id", "filename", "size_bytes")
    if fmt == "text":
        sections = {"metadata": next_doc_id(docs).select(F.concat(F.lit("nextDocID: "), F.col("nextDocID").cast("string")).alias("value")), "postings": block_lines(index) if index.blocks is not None else term_lines(index.postings)}
        sections["names"] = docs.select(F.concat_ws(": ", F.col("doc_id").cast("string"), "filename").alias("value"))
        sections["sizes"] = docs.select(F.concat_ws(": ", "filename", F.col("size_bytes").cast("string")).alias("value"))
    else:
        sections = {"metadata": next_doc_id(docs), "postings": index.blocks.select("term", "docs", "ends", "positions") if index.blocks is not None else index.postings, "docs": docs}
    for name, df in sections.items():
        writer = df.write.mode("overwrite")
        (writer.option("compression", "gzip") if fmt == "parquet" else writer).format(fmt).save(f"{path}/{name}")


def load(spark: SparkSession, path: str, fmt: str = "parquet") -> Index:
    if fmt not in FORMATS:
        raise ValueError(f"no format named {fmt}")
    if fmt == "parquet":
        docs, postings = spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings")
        postings = postings_of(postings) if "docs" in postings.columns else postings
    elif fmt == "json":
        docs = spark.read.schema(DOCS).json(f"{path}/docs")
        either = spark.read.schema("term string, doc_id bigint, tf int, docs array<bigint>, ends array<int>, positions array<int>").json(f"{path}/postings")
        postings = postings_of(either.select("term", F.coalesce("docs", F.array("doc_id")).alias("docs"), F.coalesce("ends", F.array("tf")).alias("ends"), "positions"))
    else:
        names = spark.read.text(f"{path}/names").select(F.substring_index("value", ": ", 1).cast("bigint").alias("doc_id"), F.expr("substring(value, instr(value, ': ') + 2)").alias("filename"))
        # a name may hold the separator, a size doesn't
        size = F.substring_index("value", ": ", -1)
        sizes = spark.read.text(f"{path}/sizes").select(F.expr("left(value, length(value) - length(substring_index(value, ': ', -1)) - 2)").alias("filename"), size.cast("bigint").alias("size_bytes"))
        docs = names.join(sizes.dropDuplicates(["filename"]), "filename", "left").select("doc_id", "filename", "size_bytes")
        postings = read_term_lines(spark.read.text(f"{path}/postings"))
    return from_postings(docs, postings)


def load_next_id(spark: SparkSession, path: str, fmt: str = "parquet") -> int:
    """The doc_id that the next document of a saved index gets."""
    if fmt == "text":
        return int(spark.read.text(f"{path}/metadata").first().value.removeprefix("nextDocID: "))
    return spark.read.schema("nextDocID bigint").format(fmt).load(f"{path}/metadata").first().nextDocID


@dataclass
class FormatMetrics:
    """What saving and loading took; rates are of the bytes on disk."""

    fmt: str
    save_ms: float
    load_ms: float
    size_bytes: int

    @property
    def total_ms(self) -> float:
        return self.save_ms + self.load_ms

    @property
    def save_rate(self) -> float:
        return self.size_bytes / self.save_ms if self.save_ms else float("inf")

    @property
    def load_rate(self) -> float:
        return self.size_bytes / self.load_ms if self.load_ms else float("inf")


def measure_formats(index: Index, path: str) -> list[FormatMetrics]:
    """Save and load the index once in each format."""
    spark = index.docs.sparkSession
    jvm, out = spark._jvm, []
    for fmt in FORMATS:
        began = time.time()
        save(index, f"{path}/{fmt}", fmt)
        saved = time.time()
        load(spark, f"{path}/{fmt}", fmt).tokens.write.format("noop").mode("overwrite").save()
        done = time.time()
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{fmt}")
        size = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
        out.append(FormatMetrics(fmt, (saved - began) * 1000, (done - saved) * 1000, size))
    return out


def compare_formats(metrics: DataFrame) -> DataFrame:
    """metrics: fmt, save_ms, load_ms, size_bytes. Adds points (3, 2, 1 by rank in size, save and load time; ties in the order given by
    `priority`) and best (most points; ties likewise)."""
    from pyspark.sql import Window

    priority = F.array_position(F.array(*map(F.lit, FORMATS)), F.col("fmt"))
    rank = lambda c: F.row_number().over(Window.orderBy(c, priority))  # noqa: E731  three rows
    scored = metrics.withColumn("points", (12 - rank("size_bytes") - rank("save_ms") - rank("load_ms")).cast("int"))
    return scored.withColumn("best", F.row_number().over(Window.orderBy(F.desc("points"), priority)) == 1)
