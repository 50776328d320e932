"""Streams of documents.

Filters compile to Columns, so a streaming DataFrame can be registered as a bundle and
selected from like any other; ``append_stream`` feeds a stored bundle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_stream(engine, bundle: str, stream: DataFrame, checkpoint: str):
    """Start adding each micro-batch to a stored bundle, with defaults and rules applied."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, _: engine.add_documents(bundle, rows)).start()
