"""Streams: stateless text operators on rows, and whole-document stages per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..operators.resolve import resolve_slots
from ..operators.spans import annotate
from ..operators.text import normalize
from ..plans.pipeline import preprocess
from ..session import cut_tables


def stream_slots(chunks: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Slots of a stream of chunks: row by row, so any output mode and no state."""
    return resolve_slots(annotate(chunks, text, "__spans"), keys, text, "__spans")


def stream_normalized(chunks: DataFrame, text: str = "text") -> DataFrame:
    """A stream with normalised text."""
    return chunks.withColumn(text, normalize(F.col(text)))


def preprocess_stream(sections: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, settings: Settings = Settings()) -> StreamingQuery:  # noqa: B008
    """Chunk whole documents of every micro-batch; a document's sections must arrive in one batch.

    ``write`` gets the chunks and the batch number, which it can use to write each batch once.  What a batch keeps on disk
    is deleted when it is written.
    """

    def batch(df: DataFrame, number: int) -> None:
        with cut_tables(df.sparkSession):
            write(preprocess(df, settings), number)

    return sections.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and kind, dropping what comes later than the watermark; the same on a table and a stream."""
    d = events.withWatermark(ts, late) if events.isStreaming else events
    return d.groupBy(F.window(ts, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def read_parquet_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a folder of parquet files, with the schema of what is there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
