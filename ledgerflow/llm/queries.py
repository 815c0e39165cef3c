"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .alignment import align_tokens
from .common import held_out, share_path, table
from .language import identify
from .licenses import license_report
from .nearcopies import near_copies
from .packing import pack_documents
from .pii import pii_report
from .sharding import shard_documents
from .suffixes import remove_repeats
from .templates import contamination
from .tokens import count_tokens
from .toxicity import score_toxicity
from .vectors import near_vectors
from .whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        share_path(spark)
        return fn(spark, folder)

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii_report(table(spark, folder, "documents"))


@query
def op2_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


@query
def op3_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    done = remove_repeats(table(spark, folder, "documents"), 400)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))


@query
def op5_contamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, folder, "labels"), ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(table(spark, folder, "documents"))


@query
def op9_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(table(spark, folder, "documents"), width=2, percent=80)


@query
def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    told = identify(table(spark, folder, "documents"), ~held_out())
    return told.select("doc_id", (~told["train"]).alias("held_out"), "lang_pred", "score")


@query
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    done = align_tokens(table(spark, folder, "documents"), *paths)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


@query
def op12_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return license_report(table(spark, folder, "documents"))


@query
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    done = whiten(table(spark, folder, "embeddings"), 8)
    # NULL for a deviation beyond a long, which only many millions of vectors can have.
    return done.withColumn("deviation", F.col("deviation").try_cast("long"))


# The same results in SQL, by comparing all pairs.
REACHED = """
reached(id, c) AS (SELECT id, id FROM nodes UNION SELECT l.b, r.c FROM reached r JOIN both_ways l ON l.a = r.id),
parts AS (SELECT id, min(c) AS component_id FROM reached GROUP BY id)
"""

SQL["op2_near_vectors"] = f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
both_ways AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id
  WHERE list_inner_product(x.e, y.e) / sqrt(list_inner_product(x.e, x.e) * list_inner_product(y.e, y.e)) >= 0.95), {REACHED}
SELECT p.id AS vec_id, (SELECT count(*) FROM both_ways l WHERE l.a = p.id) AS n_links, component_id, p.id = component_id AS kept,
  1.0::DOUBLE AS audit_recall FROM parts p"""

SQL["op9_near_copies"] = rf"""WITH RECURSIVE nodes AS (SELECT doc_id AS id FROM documents),
w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS z FROM w),
n AS (SELECT id, count(*) AS size FROM s GROUP BY id),
o AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM s x JOIN s y ON x.z = y.z AND x.id <> y.id GROUP BY ALL),
both_ways AS (SELECT a, b FROM o JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * k >= 80 * (p.size + q.size - k)), {REACHED}
SELECT p.id AS doc_id, coalesce(n.size, 0) AS n_shingles, component_id, p.id = component_id AS kept FROM parts p LEFT JOIN n USING (id)"""
