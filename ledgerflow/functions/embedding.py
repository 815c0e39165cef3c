"""Pluggable embedders, applied in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

# What an embedder made of a text: a vector, or the reason why there is none.
EMBEDDED = StructType([StructField("vector", ArrayType(FloatType())), StructField("error", StringType())])


class Embedder(Protocol):
    """One text at a time; a client that also has ``embed_documents(texts)`` is asked once for each Arrow batch."""

    def embed_query(self, text: str) -> Sequence[float]: ...


def embed_column(factory: Callable[[], Embedder], text: Column) -> Column:
    """Vector of each text; one client per Python worker, texts in Arrow batches."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = factory()
        many = getattr(client, "embed_documents", None) or (lambda texts: [client.embed_query(t) for t in texts])
        for texts in batches:
            yield pd.Series([[float(x) for x in v] for v in many(texts.tolist())], index=texts.index, dtype=object)

    return embed(text)


def embed_texts(factory: Callable[[], Embedder], text: Column) -> Column:
    """``struct<vector, error>`` of each text: a failure is data of its own row, not the end of the batch.

    A batch that the client refuses as a whole, or answers with another number of
    vectors, is asked for again text by text, so only the texts that fail alone
    carry an error, the exception's text. A client that cannot be made is the
    error of every text. A NULL text is an error too.
    """

    @F.pandas_udf(EMBEDDED)
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def reason(failure: Exception) -> str:
            return str(failure) or type(failure).__name__

        def plain(vector) -> list[float]:
            return [float(x) for x in vector]

        def alone(text):
            try:
                if text is None:
                    raise ValueError("no text")
                return plain(client.embed_query(text)), None
            except Exception as failure:
                return None, reason(failure)

        def together(texts: list) -> list | None:
            many = getattr(client, "embed_documents", None)
            if many is None or None in texts:
                return None
            try:
                vectors = [plain(v) for v in many(texts)]
            except Exception:
                return None
            return [(v, None) for v in vectors] if len(vectors) == len(texts) else None

        client, broken = None, None
        try:
            client = factory()
        except Exception as failure:
            broken = reason(failure)
        for batch in batches:
            texts = [None if pd.isna(t) else t for t in batch]
            found = [(None, broken)] * len(texts) if client is None else together(texts) or [alone(t) for t in texts]
            yield pd.DataFrame({"vector": pd.Series([v for v, _ in found], dtype=object), "error": pd.Series([e for _, e in found], dtype=object)})

    return embed(text)


def probe_dimension(factory: Callable[[], Embedder], probe: str = "embedding-dimension-probe") -> int:
    """Length of a probe vector, 0 when the embedder fails; asked once, on the driver."""
    try:
        return len(factory().embed_query(probe))
    except Exception:
        return 0
