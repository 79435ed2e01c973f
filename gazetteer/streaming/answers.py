"""Queries that arrive as a stream, answered a micro-batch at a time by the batch geocoder.

There is no state between batches: a query's answer depends on the tables alone, so a batch that is run again after a
failure gives the same rows, and a sink that replaces a batch's rows sees each answer once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..query import Tables, geocode
from ..scratch import discard, written


def answer_stream(queries: DataFrame, tables: Tables, path: str, **options) -> DataStreamWriter:
    """A writer that answers the streaming table `queries` (query_id, text): each batch's matches become the folder
    `path`/batch=N, replaced as a whole.  The caller sets trigger and checkpoint and starts it."""

    def one(batch: DataFrame, number: int) -> None:
        asked = written(batch.select("query_id", "text"))
        geocode(tables, asked, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")
        discard(asked)

    return queries.writeStream.foreachBatch(one)
