"""Reads and deletes over the tables: history pages, turn pairs, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import schema

PAGE = 50
HISTORY_COLUMNS = ["message_id", "role", "text", "seq", "metadata", "created_at"]


def session_messages(conversations: DataFrame, messages: DataFrame, session_id: str, limit: int = PAGE) -> DataFrame:
    """The first ``limit`` messages of one session by sequence; none for an unknown session.

    Filter, one join and a top-k: no full sort.
    """
    wanted = conversations.where(F.col("session_id") == session_id).select(F.col("id").alias("conversation_id"))
    page = messages.join(wanted, "conversation_id", "inner")
    return page.orderBy("seq").limit(limit).select(*HISTORY_COLUMNS)


def history_pages(conversations: DataFrame, messages: DataFrame, limit: int = PAGE) -> DataFrame:
    """The first ``limit`` messages of every session.

    The page is cut on narrow columns before the texts are joined. Spark turns
    ``row_number() <= limit`` into a group limit that also runs before the
    shuffle, so a hot conversation sends at most ``limit`` rows per task.
    """
    order = Window.partitionBy("conversation_id").orderBy("seq")
    page = (
        messages.select("conversation_id", "seq")
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= limit)
        .drop("_n")
    )
    sessions = conversations.select("session_id", F.col("id").alias("conversation_id"))
    rows = messages.join(page, ["conversation_id", "seq"], "left_semi").join(sessions, "conversation_id", "inner")
    return rows.select("session_id", *HISTORY_COLUMNS)


def stored_rows(rows: DataFrame, table: schema.Table, keys: DataFrame) -> DataFrame:
    """The rows of a table whose natural key is listed in ``keys``, with the table's columns in their declared order.

    Repeated keys list a row once; keys that are not stored, and NULL, list none.
    """
    return rows.join(keys.select(table.key), table.key, "left_semi").select(*table.struct.names)


def stored_documents(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """Read documents back by ``document_key``."""
    return stored_rows(documents, schema.DOCUMENTS, keys)


def stored_embeddings(embeddings: DataFrame, keys: DataFrame) -> DataFrame:
    """Read embeddings back by ``vector_id``."""
    return stored_rows(embeddings, schema.EMBEDDINGS, keys)


def turn_pairs(messages: DataFrame, group: str = "conversation_id", seq: str = "seq") -> DataFrame:
    """User messages directly followed by an assistant message.

    An equi-join on (conversation, position) instead of a window, so a hot
    conversation spreads over its positions.
    """
    user = messages.where(F.col("role") == "user").select(
        group, F.col(seq).alias("user_seq"), (F.col(seq) + 1).alias("assistant_seq"), F.col("text").alias("question")
    )
    assistant = messages.where(F.col("role") == "assistant").select(
        group, F.col(seq).alias("assistant_seq"), F.col("text").alias("answer")
    )
    return user.join(assistant, [group, "assistant_seq"], "inner")


def cascade_delete(child: DataFrame, deleted: DataFrame, column: str, parent_column: str = "id") -> tuple[DataFrame, DataFrame]:
    """Child rows that stay and child rows that go with their deleted parents."""
    gone = deleted.select(F.col(parent_column).alias(column))
    return child.join(gone, column, "left_anti"), child.join(gone, column, "left_semi")
