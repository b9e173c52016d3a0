"""Keeping an index of documents that arrive in files or from another stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillet.functions.text import tokens


def index_stream(documents: DataFrame, path: str, checkpoint: str, id_col: str = "doc_id", text: str = "text", once: bool = True) -> StreamingQuery:
    """Append the tokens of a streaming table of documents to Parquet under `path`; `checkpoint` must be shared by all executors."""
    writer = tokens(documents, id_col, text).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
