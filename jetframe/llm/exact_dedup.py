"""Exact deduplication with heavy hitters split off; DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z; a null text counts as empty. Of equal
texts the row with the largest doc_id stays.

1. Every text becomes a SHA-256 digest once; everything after this works on ids and digests.
2. Misra-Gries counting (``freqItems``) gives all digests more frequent than ``support``, among at most
   1 / ``support`` candidates.
3. The candidates are verified by an exact count, combined on the map side. The winners are at most
   1 / ``support`` rows and are broadcast: their losing rows are settled where they are read and never
   shuffled.
4. All other rows, and the winning row of each heavy digest, are grouped by an ordinary shuffle, in
   which no group is larger than ``support`` times the table.

Rows repeated with the same doc_id and text: one of them stays. A null doc_id is smaller than any
other. An empty table gives an empty result. Further columns are carried by ``dedup_rows`` whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jetframe.session import checkpoint

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SUPPORT = 0.001


def text_digest(text: str | Column) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    folded = F.translate(F.coalesce(column, F.lit("")), UPPER, UPPER.lower())
    return F.sha2(folded, 256)


def heavy_winners(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(digest, heavy_keep, heavy_size): verified frequent digests, at most 1 / support rows."""
    frequent = digests.stat.freqItems(["digest"], support)
    candidates = frequent.select(F.explode("digest_freqItems").alias("digest")).distinct()
    return (
        digests.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("heavy_keep"), F.count("*").alias("heavy_size"))
        .filter("heavy_size > 1")
    )


def exact_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", support: float = SUPPORT
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row."""
    digests = checkpoint(
        docs.select(
            F.col(id_column).alias("doc_id"), text_digest(docs[text_column]).alias("digest")
        )
    )
    winners = checkpoint(heavy_winners(digests, support))
    marked = digests.join(F.broadcast(winners), "digest", "left")
    lost = F.col("heavy_size").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("heavy_keep"))
    settled = marked.filter(lost).select(
        "doc_id",
        F.col("heavy_keep").alias("keep_id"),
        F.col("heavy_size").alias("group_size"),
        F.lit(False).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    group = Window.partitionBy("digest")
    ordinary = marked.filter(~lost).select(
        "doc_id",
        F.max("doc_id").over(group).alias("keep_id"),
        F.coalesce("heavy_size", F.count("*").over(group)).alias("group_size"),
        (F.row_number().over(group.orderBy(F.desc_nulls_last("doc_id"))) == 1).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    return settled.unionByName(ordinary)


def dedup_rows(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", support: float = SUPPORT
) -> DataFrame:
    """The rows that stay, with all columns of ``docs``.

    Losing rows of heavy digests go where they are read. Only the others are shuffled.
    """
    whole = docs.select(
        docs[id_column].alias("doc_id"),
        text_digest(docs[text_column]).alias("digest"),
        F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"),
    )
    winners = checkpoint(heavy_winners(checkpoint(whole.select("doc_id", "digest")), support))
    marked = whole.join(F.broadcast(winners), "digest", "left")
    lost = F.col("heavy_size").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("heavy_keep"))
    group = Window.partitionBy("digest").orderBy(F.desc_nulls_last("doc_id"))
    return (
        marked.filter(~lost)
        .withColumn("place", F.row_number().over(group))
        .filter("place = 1")
        .select("row.*")
    )


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY d.doc_id DESC NULLS LAST) = 1 AS kept,
       text_sha256
FROM d JOIN g USING (text_sha256)
"""
