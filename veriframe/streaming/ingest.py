"""Structured Streaming ingestion: every micro-batch of documents goes through the batch transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from veriframe.operators.chunking import chunk_documents
from veriframe.operators.concepts import RULES, Rule
from veriframe.sources.stores import ingest


def document_stream(spark: SparkSession, folder: str, schema: StructType, files_each: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder)


def stream_chunks(documents: DataFrame, id_col: str = "document_id", text_col: str = "raw_text") -> DataFrame:
    """Chunking has no state, so it is the same on a stream."""
    return chunk_documents(documents, id_col, text_col)


def ingest_stream(documents: DataFrame, path: str, checkpoint: str, rules: tuple[Rule, ...] = RULES, id_col: str = "document_id", text_col: str = "raw_text") -> StreamingQuery:
    """Upsert each micro-batch into the stores under ``path``. Chunk ids are deterministic and sinks are overwritten from the
    chunk store, so a batch that is run again after a failure changes nothing."""

    def batch(df: DataFrame, _: int) -> None:
        ingest(df, path, rules, id_col, text_col)

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
