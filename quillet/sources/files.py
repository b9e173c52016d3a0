"""Reading directories of text and XML files."""

from __future__ import annotations

import io
import re
import xml.sax
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillet.plans.order import numbered

#: Elements whose text, from their start to the next end tag, is no content. Fixed values.
SKIPPED = {"ref", "url", "id", "timestamp", "username", "comment", "model", "format", "sha1"}
#: What an XML document without the file ending starts with. Fixed values.
STARTS = ("<?xml", "<mediawiki", "<feed", "<root")


def read_files(spark: SparkSession, directory: str, glob: str | None = None, where: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """path, filename, size_bytes, content: all files below a directory, chosen by a name pattern and a predicate. Bytes that aren't UTF-8 are
    replaced. A path that isn't a directory is an error."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise ValueError(f"{directory} is not a directory")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(directory)
    out = files.select("path", F.regexp_extract("path", "[^/]*$", 0).alias("filename"), F.col("length").alias("size_bytes"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return out.where(where(out)) if where else out


def is_xml(name: Column | str, content: Column | str) -> Column:
    """By ending, or by what the text starts with."""
    start = F.lower(F.ltrim(content if isinstance(content, Column) else F.col(content)))
    hit = F.lower(name if isinstance(name, Column) else F.col(name)).endswith(".xml")
    for s in STARTS:
        hit = hit | start.startswith(s)
    return hit


def strip_xml(content: Column | str) -> Column:
    """Text of broken XML: tags and references become spaces, white space is collapsed."""
    out = content if isinstance(content, Column) else F.col(content)
    for pattern in (r"<[^>]+>", r"&[a-z]+;", r"&#[0-9]+;", r"\s+"):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(out)


class _Text(xml.sax.ContentHandler):
    def __init__(self):
        super().__init__()
        self.parts, self.skip = [], False

    def startElement(self, name, attrs):
        if name.lower() in SKIPPED:
            self.skip = True

    def endElement(self, name):
        self.parts.append(" ")
        self.skip = False

    def characters(self, content):
        if not self.skip:
            self.parts.append(content)


def xml_to_text(content: str) -> str:
    handler = _Text()
    parser = xml.sax.make_parser()
    parser.setFeature(xml.sax.handler.feature_external_ges, False)
    parser.setFeature(xml.sax.handler.feature_external_pes, False)
    parser.setContentHandler(handler)
    try:
        parser.parse(io.BytesIO(content.encode()))
        return "".join(handler.parts)
    except xml.sax.SAXException:
        for pattern in (r"<[^>]+>", r"&[a-z]+;", r"&#[0-9]+;", r"\s+"):
            content = re.sub(pattern, " ", content)
        return content.strip()


def xml_text(content: Column | str) -> Column:
    """The character data of XML documents, an element's end being a space; broken ones are stripped."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(xml_to_text, na_action="ignore")

    return run(content)


def file_text(files: DataFrame) -> DataFrame:
    """files with text: XML read as such, all else as it is."""
    return files.withColumn("text", F.when(is_xml("filename", "content"), xml_text("content")).otherwise(F.col("content")))


def registry(files: DataFrame, path: str = "path", size: str = "size_bytes") -> DataFrame:
    """doc_id (from 1, in the order of the first path), filename, size_bytes. Files of one name are one document, of the size of the first."""
    named = files.select(F.regexp_extract(path, "[^/]*$", 0).alias("filename"), F.struct(F.col(path).alias("path"), F.col(size).alias("size")).alias("f"))
    first = named.groupBy("filename").agg(F.min("f").alias("f")).select("filename", "f.path", F.col("f.size").alias("size_bytes"))
    return numbered(first, ["path"], "n").select((F.col("n") + 1).alias("doc_id"), "filename", "size_bytes")


def parse_zones(texts: DataFrame, id_col: str = "doc_id", text: str = "text", filename: str | None = None) -> DataFrame:
    """doc_id, zone, text of books with a header and body marks.

    Lines that start with title:, author: or subject: and a space add their rest to that zone, wherever they stand before the end mark; the
    lines between the start and end marks are the body. A document without a title has one zone, TITLE, of its file name.
    """
    lines = texts.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("no", "raw")).withColumn("line", F.regexp_replace("raw", r"^[\x00-\x20]+|[\x00-\x20]+$", "")).withColumn("low", F.lower("line"))
    heads = F.when(F.col("low").startswith("title: "), "TITLE").when(F.col("low").startswith("author: "), "AUTHOR").when(F.col("low").startswith("subject: "), "SUBJECT")
    lines = lines.withColumn("head", heads)
    plain = F.col("head").isNull()
    starts = plain & F.contains("low", F.lit("*** start of the project gutenberg"))
    ends = plain & ~F.contains("low", F.lit("*** start of the project gutenberg")) & F.contains("low", F.lit("*** end of the project gutenberg"))
    upto = Window.partitionBy("doc_id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"begun": F.max(starts.cast("int")).over(upto), "ended": F.max(ends.cast("int")).over(upto), "mark": starts | ends}).where("ended = 0")
    skip = {"TITLE": 7, "AUTHOR": 8, "SUBJECT": 9}
    value = F.col("line")
    for zone, n in skip.items():
        value = F.when(F.col("head") == zone, F.substring("line", n + 1, 1 << 30)).otherwise(value)
    body = plain & ~F.col("mark") & (F.col("begun") == 1) & (F.col("line") != "")
    parts = lines.select("doc_id", "no", F.coalesce("head", F.when(body, "BODY")).alias("zone"), value.alias("part")).where("zone is not null")
    joined = F.transform(F.array_sort(F.collect_list(F.struct("no", "part"))), lambda x: x["part"])
    zones = parts.groupBy("doc_id", "zone").agg(joined.alias("parts")).select("doc_id", "zone", F.trim(F.when(F.col("zone") == "BODY", F.array_join("parts", " ")).otherwise(F.array_join("parts", ""))).alias("text"))
    titled = zones.where("zone = 'TITLE' and trim(text) <> ''").select("doc_id")
    name = F.col(filename) if filename else F.concat(F.lit("doc-"), F.col(id_col).cast("string"))
    untitled = texts.select(F.col(id_col).alias("doc_id"), name.alias("text")).join(titled, "doc_id", "left_anti").select("doc_id", F.lit("TITLE").alias("zone"), "text")
    return zones.where("text <> ''").join(titled, "doc_id", "left_semi").unionByName(untitled)


def table_zones(documents: DataFrame) -> DataFrame:
    """Zones of a table of documents: TITLE the first line, AUTHOR the source, SUBJECT the language, BODY the rest."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rest = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), "\n")
    each = [("TITLE", F.get(lines, F.lit(0))), ("AUTHOR", F.col("source")), ("SUBJECT", F.col("lang")), ("BODY", rest)]
    return documents.select("doc_id", F.explode(F.array(*[F.struct(F.lit(z).alias("zone"), t.alias("text")) for z, t in each])).alias("z")).select("doc_id", "z.zone", "z.text")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """word: of a file with words on lines, in lower case; what follows # is a comment."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line"))
    return lines.select(F.explode(F.split(F.lower("line"), r"\s+")).alias("word")).where("word <> ''").distinct()


def write_book(directory: str, number: int, title: str, author: str, subject: str, body: str) -> str:
    """A text file with the header and marks that parse_zones() reads, for tests and demonstrations."""
    from pathlib import Path

    path = Path(directory, f"book-{number}.txt")
    path.write_text(f"Title: {title}\nAuthor: {author}\nSubject: {subject}\nEBook-No.: {number}\n\n*** START OF THE PROJECT GUTENBERG EBOOK {title} ***\n{body}\n*** END OF THE PROJECT GUTENBERG EBOOK {title} ***\n")
    return str(path)
