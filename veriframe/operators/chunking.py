"""Documents to chunks, chunks to tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.functions.vectors import hashed_embedding


def chunk_documents(documents: DataFrame, id_col: str = "document_id", text_col: str = "raw_text", keep_tails: bool = False) -> DataFrame:
    """(document_id, chunk_id, pos, text, word_count): a row per sentence. No shuffle.

    Ids derive from document and position, so ingesting again gives the same chunks. Null text counts as empty; an
    empty document has one empty chunk.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    pieces = T.sentences_with_tails(text) if keep_tails else T.sentences(text)
    rows = documents.select(F.col(id_col).cast("string").alias("document_id"), F.posexplode_outer(pieces).alias("pos", "text"))
    chunk_id = F.concat("document_id", F.lit("-"), F.format_string("%06d", F.col("pos")))
    return rows.select("document_id", chunk_id.alias("chunk_id"), F.col("pos").cast("int").alias("pos"), "text", T.word_count(F.col("text")).alias("word_count"))


def exploded(df: DataFrame, array: str, name: str) -> DataFrame:
    """``df`` with a row per element of an array column, in its place. An outer explode, filtered: a plain one makes the planner
    compute the array twice more, to filter empty ones early."""
    rest = [c for c in df.columns if c != array]
    return df.select(*rest, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def tokenised(chunks: DataFrame, analyse: Callable[[Column], Column] = T.all_tokens) -> DataFrame:
    """(chunk_id, all): every chunk's tokens in order, for the retrievers; worth storing."""
    return chunks.select("chunk_id", analyse(F.col("text")).alias("all"))


def token_index(chunks: DataFrame) -> DataFrame:
    """(chunk_id, n_tokens, token): the inverted index's postings, one per distinct token of a chunk."""
    found = chunks.select("chunk_id", T.tokens(F.col("text")).alias("tokens"))
    return exploded(found.select("chunk_id", F.size("tokens").alias("n_tokens"), "tokens"), "tokens", "token")


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count("*").alias("df"))


def ingest_summary(chunks: DataFrame) -> DataFrame:
    """Per document: how many chunks and words were ingested."""
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum("word_count").cast("long").alias("words"), F.lit("success").alias("status"))


def embed_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "document_id", hashed_embedding(F.col("text")).alias("embedding"))
