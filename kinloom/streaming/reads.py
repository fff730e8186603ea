"""Minimizers of reads as they arrive. A read's minimizers depend on it alone, so the stream needs no state
and no watermark; hits go to a table that a batch job joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import Sketch
from ..operators.sketch import sketch


def sketch_stream(reads: DataFrame, out: str, checkpoint: str, config: Sketch = Sketch(), **columns: str) -> StreamingQuery:
    """Appends the hits of a streaming table of reads to Parquet files, each read once, also after a restart."""
    return sketch(reads, config, **columns).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
