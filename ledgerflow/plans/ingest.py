"""Batch ingest of document chunks into documents and embeddings."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..functions import keys as K
from ..functions.embedding import Embedder, probe_dimension
from ..functions.jsontext import merge_metadata, metadata_text
from ..operators import upsert as U
from ..operators.ranking import SPLIT_EVERY
from ..session import durable
from ..sources.events import DEFAULT_BACKEND, metadata_text_field

# The metadata members that stored rows carry as columns.
META_FIELDS = ("source", "title_path", "trace_id", "idempotency_key")


class Ingest(NamedTuple):
    documents: DataFrame
    embeddings: DataFrame
    rejected: DataFrame
    receipts: DataFrame


def keyed_chunks(chunks: DataFrame, collection: str, backend: str = DEFAULT_BACKEND,
                 persist_directory: str | None = None) -> DataFrame:
    """Add keys, metadata fields and enriched document metadata to chunks.

    ``chunks``: page_content, metadata MAP<STRING, VARIANT>, ord, at.
    """
    key = K.chunk_document_key(F.lit(collection), F.col("page_content"), F.col("metadata"))
    keyed = chunks.withColumn("document_key", key).withColumn("vector_id", K.vector_id(F.col("document_key")))
    extra = {
        "collection_name": F.lit(collection), "backend": F.lit(backend),
        "document_key": F.col("document_key"), "vector_id": F.col("vector_id"),
    }
    enriched = merge_metadata(F.col("metadata"), extra, {"persist_directory": F.lit(persist_directory).cast("string")})
    fields = [metadata_text_field(F.col("metadata"), n).alias(n) for n in META_FIELDS]
    return keyed.select(
        "document_key", "vector_id", F.col("page_content").alias("content"), *fields,
        metadata_text(enriched).alias("metadata"), "ord", "at",
    )


def embedding_metadata(collection: str, backend: str, persist_directory: str | None):
    """The four fixed entries of an embedding's metadata; the directory may be null."""
    return F.to_json(
        F.struct(
            F.lit(collection).alias("collection_name"), F.lit(backend).alias("backend"),
            F.col("document_key"), F.lit(persist_directory).cast("string").alias("persist_directory"),
        ),
        {"ignoreNullFields": "false"},
    )


def persist_chunks(chunks: DataFrame, documents: DataFrame | None = None, embeddings: DataFrame | None = None, *,
                   collection: str, backend: str = DEFAULT_BACKEND, persist_directory: str | None = None,
                   model: str | None = None, dimension: int | None = None, bound: bool = False,
                   embed: Callable[[DataFrame], DataFrame] | None = None, embedder: Callable[[], Embedder] | None = None,
                   every: int = SPLIT_EVERY) -> Ingest:
    """Keys, document upsert, embedding upsert and per-chunk receipts.

    The stored dimension is the one given, else the length of the vector that
    ``embed`` adds as ``embedding`` to rows with ``vector_id`` and
    ``page_content``, else that of a probe vector of ``embedder``, else 0.

    A chunk refused by a unique key is listed in ``rejected`` and the others go
    on. Keyed chunks and merged documents are written once, as the later steps
    read them again. ``bound`` promises that the chunks carry no explicit idempotency keys.
    """
    keyed = durable(keyed_chunks(chunks, collection, backend, persist_directory), "keyed")
    merged = U.upsert_documents(documents, keyed, bound=bound, staged=True, every=every)
    rows = durable(merged.rows, "documents")
    accepted = merged.verdicts.where("accepted").select("document_key", "ord")
    incoming = keyed.drop("content", "source", "title_path", "metadata").join(accepted, ["document_key", "ord"], "left_semi")
    probed = 0
    if dimension is not None or embed is None:
        incoming = incoming.withColumn("embedding", F.lit(None).cast("array<float>"))
        if dimension is None and embedder is not None:
            probed = probe_dimension(embedder)
    else:
        texts = keyed.select("vector_id", F.col("content").alias("page_content")).dropDuplicates(["vector_id"])
        incoming = incoming.join(durable(embed(texts).select("vector_id", "embedding"), "embedded"), "vector_id", "left")
    incoming = U.document_ids(incoming, rows.select("document_key", "id")).select(
        "document_id", "document_key", "vector_id", "trace_id", "idempotency_key", "ord", "at",
        K.embedding_model(F.lit(model).cast("string")).alias("model"),
        K.embedding_dimension(F.lit(dimension).cast("int"), F.col("embedding"), probed).alias("dimension"),
        embedding_metadata(collection, backend, persist_directory).alias("metadata"),
    )
    incoming = durable(incoming, "vectors")
    vectors = U.upsert_embeddings(embeddings, incoming, bound=bound, staged=True, every=every)
    written = incoming if bound else incoming.join(
        vectors.verdicts.where("accepted").select("vector_id", "ord"), ["vector_id", "ord"], "left_semi"
    )
    receipts = written.select("document_key", "vector_id", "ord").join(
        vectors.rows.select("vector_id", "document_id", F.col("id").alias("embedding_id")), "vector_id", "inner"
    )
    rejected = merged.rejected.withColumnRenamed("document_key", "key")
    if not bound:
        rejected = rejected.unionByName(vectors.rejected.withColumnRenamed("vector_id", "key"))
    return Ingest(
        rows, vectors.rows, rejected,
        receipts.select("document_key", "vector_id", "document_id", "embedding_id"),
    )
