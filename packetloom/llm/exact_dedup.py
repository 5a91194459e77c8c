"""Exact deduplication by content-defined chunk recipes (native).

Each text is cut where its own content says so: after at least ``min_chars`` characters, at
the first place where the boundary pattern matches, and after ``max_chars`` at the latest.
Equal texts therefore give equal chunk lists, and an insertion only changes the chunks near
it. A chunk's identifier is its 64-bit hash, verified against the chunk's SHA-256 digest:
where one hash stands for several digests, documents that contain it are told apart by their
digests as well. Documents are equal when their ordered identifier lists are equal. Texts
leave the scan only as chunk hashes and digests; no shuffle ever moves a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._store import Workspace

BOUNDARY = "[a-f0-9][ \\n]"


def chunks(text, min_chars: int = 1024, max_chars: int = 8192, boundary: str = BOUNDARY):
    """The content-defined chunks of a text column, in order; they concatenate to the text."""
    pattern = f"(?s).{{{min_chars},{max_chars - 2}}}?{boundary}|.{{1,{max_chars}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, min_chars: int = 1024, max_chars: int = 8192) -> DataFrame:
    """doc_id, text_sha256, whether the text is valid UTF-8, and per chunk its ``id`` (64-bit hash) and SHA-256 ``digest``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = F.transform(
        chunks(text, min_chars, max_chars),
        lambda c: F.struct(F.xxhash64(c).alias("id"), F.unhex(F.sha2(c, 256)).alias("digest")),
    )
    return docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"), F.is_valid_utf8(text).alias("valid"), parts.alias("parts"))


def dictionary(recipe: DataFrame) -> DataFrame:
    """One row per chunk identifier: references, and its smallest and largest digest."""
    return (
        recipe.select(F.explode("parts").alias("p"))
        .groupBy(F.col("p.id").alias("id"))
        .agg(F.count(F.lit(1)).alias("refs"), F.min("p.digest").alias("lo"), F.max("p.digest").alias("hi"))
    )


def exact_dedup(docs: DataFrame, min_chars: int = 1024, max_chars: int = 8192) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Of equal texts (byte for byte; null is the empty text) the row with the largest doc_id
    stays. group_size counts rows, repeated ones too. Repeated rows of the largest doc_id are
    all ``kept``, as they are one document. A null doc_id is smaller than any other. Chunks are cut
    from decoded characters, so texts that are no valid UTF-8 are told apart by their own digest besides.
    """
    ws = Workspace(docs.sparkSession, "exact-dedup")
    recipe = ws.save(recipes(docs, min_chars, max_chars), "recipes")
    # identifiers with more than one digest: none in practice, told apart exactly if there are any
    clash = ws.save(dictionary(recipe).filter(F.col("lo") != F.col("hi")).select("id"), "clashes")
    raw = F.when(~F.col("valid"), F.col("text_sha256"))
    row = recipe.select("doc_id", "text_sha256", F.col("parts.id").alias("ids"), raw.alias("told"))
    if not clash.isEmpty():
        hit = (
            recipe.select("doc_id", "text_sha256", F.explode("parts.id").alias("id"))
            .join(clash, "id", "left_semi")
            .select(F.col("text_sha256").alias("hit"))
            .distinct()
        )
        told = F.sha2(F.concat_ws(",", F.transform("parts.digest", F.hex)), 256)
        row = recipe.join(hit, recipe["text_sha256"] == hit["hit"], "left").select(
            "doc_id", "text_sha256", F.col("parts.id").alias("ids"), F.coalesce(raw, F.when(F.col("hit").isNotNull(), told)).alias("told")
        )
    group = row.groupBy("ids", "told").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    a, b = row.alias("a"), group.alias("b")
    return a.join(b, (F.col("a.ids") == F.col("b.ids")) & F.col("a.told").eqNullSafe(F.col("b.told"))).select(
        "a.doc_id", "b.keep_id", "b.group_size",
        F.col("a.doc_id").eqNullSafe(F.col("b.keep_id")).alias("kept"),
        "a.text_sha256", F.size("a.ids").alias("n_chunks"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
