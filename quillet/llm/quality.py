"""Quality rules with cross-document line frequency. DataFrame functions only.

Base rules: counts of words, characters, symbols, repeated lines and words in repeated 3-word windows; a text fails with fewer than
50 words or with more than half of its words in repeated windows.

Line rule: lines are lower-cased, their white space is collapsed and they are hashed. A line is boilerplate in a host where it
occurs in more than max(min_docs, share * documents of the host) distinct documents. Boilerplate lines are removed; a text that loses more
than `depleted` of its word characters is rejected.

Counts are of distinct doc_id; rows that share an id count as one document of the host, and null ids as none. A line's documents are shuffled by host, line and document
first and counted by host and line after that, so a line that all documents share is dealt over all tasks. Null texts have no words or lines and fail; a null host is a
host of its own. Rows that repeat are rows of their own; texts of any length are taken whole. Columns with the names of added ones give way to them. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters between words: the space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MIN_DOCS, SHARE, DEPLETED = 10, 0.1, 0.5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def without(text: Column | str, characters: str) -> Column:
    return F.translate(text, characters, "")


def base_counts(packed: DataFrame) -> DataFrame:
    """packed: row, host, text. Add the base counts and __lines: (hash, word characters) of each line that has a word, in order."""
    df = packed.withColumn("__text", F.coalesce("text", F.lit("")))
    df = df.withColumns({
        "__hashes": F.transform(F.filter(F.split("__text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)),
        "__filled": F.filter(F.split("__text", "\n"), lambda x: F.length(without(x, SPACES)) > 0),
    })
    window = F.transform(F.sequence(F.lit(1), F.size("__hashes") - 2), lambda i: F.xxhash64(*[F.get("__hashes", i + k - 1) for k in range(3)]))
    df = df.withColumn("__windows", F.when(F.size("__hashes") >= 3, window).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumns({
        "n_words": F.size("__hashes").cast("long"),
        "word_chars": F.length(without("__text", SPACES)).cast("long"),
        "n_symbols": (F.length("__text") - F.length(without("__text", SYMBOLS))).cast("long"),
        "n_dup_lines": (F.size("__filled") - F.size(F.array_distinct("__filled"))).cast("long"),
        "__lines": F.transform("__filled", lambda x: F.struct(line_hash(x).alias("h"), F.length(without(x, SPACES)).alias("n"))),
        "__repeats": F.size(F.array_distinct("__windows")) < F.size("__windows"),
    })
    df = df.withColumn("__sorted", F.when(F.col("__repeats"), F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("__sorted", lambda x, i: (x["h"] == F.get("__sorted", i - 1)["h"]) | (x["h"] == F.get("__sorted", i + 1)["h"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    df = df.withColumn("n_repeat_words", F.when(F.col("__repeats"), covered).otherwise(0).cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    # through a generator, so that no filter on these is moved below and worked out from the text again, word by word
    return df.select("row", "host", F.inline(F.array(F.struct(*BASE, "base_failed", "__lines"))))


def line_hash(line: Column) -> Column:
    """Of the line in lower case, its white space collapsed and trimmed."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " ")))


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """host, h: the lines above the limit. Each host has at most its lines over its limit."""
    named = docs.select(F.col(f"`{host}`").alias("host"), "doc_id", F.col(f"`{text}`").alias("text"))
    filled = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(without(x, SPACES)) > 0)
    lines = named.select("host", "doc_id", F.explode(F.array_distinct(F.transform(filled, line_hash))).alias("h"))
    counts = lines.groupBy("host", "h").agg(F.countDistinct("doc_id").alias("docs"))
    hosts = named.groupBy("host").agg(F.countDistinct("doc_id").alias("all"))
    often = counts.where(F.col("docs") > min_docs)
    return often.join(hosts, often.host.eqNullSafe(hosts.host)).where(F.col("docs") > F.greatest(F.lit(float(min_docs)), F.col("all") * share)).select(often.host, "h")


ADDED = [*BASE, "base_failed", "removed_chars", "boiler", "kept"]


def _judged(docs: DataFrame, text: str, host: str, min_docs: int, share: float, depleted: float) -> DataFrame:
    """row (the columns of docs) and ADDED."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    often = boilerplate(docs, text, host, min_docs, share).groupBy("host").agg(F.collect_set("h").alias("boiler")).withColumnRenamed("host", "of")
    joined = base_counts(packed).join(often, F.col("host").eqNullSafe(F.col("of")), "left")
    lost = F.aggregate(F.filter("__lines", lambda x: F.array_contains("boiler", x["h"])), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    judged = joined.withColumn("removed_chars", F.when(F.col("boiler").isNull(), 0).otherwise(lost).cast("long"))
    verdict = ~F.col("base_failed") & (F.col("removed_chars") <= F.col("word_chars") * depleted)
    return judged.withColumn("kept", verdict).select("row", *ADDED)


def assess(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, depleted: float = DEPLETED) -> DataFrame:
    """Add the base counts, base_failed, removed_chars, boiler (hashes of the removed lines) and kept."""
    return _judged(docs, text, host, min_docs, share, depleted).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ADDED], *ADDED)


def apply_rules(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, depleted: float = DEPLETED) -> DataFrame:
    """The kept documents without their boilerplate lines, with the columns of docs; n_chars follows the text."""
    judged = _judged(docs, text, host, min_docs, share, depleted).where("kept")
    lines = F.filter(F.split(F.col(f"row.`{text}`"), "\n"), lambda x: ~(F.array_contains("boiler", line_hash(x)) & (F.length(without(x, SPACES)) > 0)))
    cleaned = judged.withColumn("cleaned", F.when(F.col("removed_chars") > 0, F.array_join(lines, "\n")).otherwise(F.col(f"row.`{text}`")))
    new = {text: F.col("cleaned"), "n_chars": F.length("cleaned").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return cleaned.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", *BASE, "base_failed", "kept", "removed_chars")
