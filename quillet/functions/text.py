"""Text analysis: symbols deleted, lower case, split at white space. All of it stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is neither letter, number nor white space is deleted, so its neighbours join.
SYMBOLS = r"[^\p{L}\p{N}\s]+"


def plain(text: Column | str) -> Column:
    """A text's words as they are, with the white space between them."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, SYMBOLS, "")), r"^\s+|\s+$", "")


def words(text: Column | str) -> Column:
    """The words of a text; a blank text gives one empty word, which token tables leave out."""
    return F.split(plain(text), r"\s+")


def tokens(docs: DataFrame, id_col: str = "doc_id", text: str = "text", stem: bool = False) -> DataFrame:
    """doc_id, pos (from 0), term."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(words(text)).alias("pos", "term")).where("term <> ''")
    return stemmed(out) if stem else out


def stemmed(tokens_: DataFrame) -> DataFrame:
    """The same tokens with stems. Each distinct term is stemmed once and joined back."""
    from quillet.functions.porter2 import stem_column

    stems = tokens_.select("term").distinct().withColumn("stem", stem_column("term"))
    return tokens_.join(stems, "term").select("doc_id", "pos", F.col("stem").alias("term"))


def analyse(query: str, stem: bool = False) -> list[str]:
    """The words of a query, as words() would give them."""
    import regex

    out = regex.sub(r"[^\p{L}\p{N}\t-\r ]+", "", query).lower().split()
    if stem:
        from quillet.functions.porter2 import stem as stem_one

        return [stem_one(w) for w in out]
    return out
