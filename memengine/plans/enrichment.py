"""Enrichment: pending items to cleaned, embedded, classified rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import classify as C
from ..operators import store, text_jobs, views
from ..runtime import cut_lineage
from ..sources import dimensions

NO_TEXT = "no_embeddable_text"


def prepare(items: DataFrame, mail: DataFrame, pages: DataFrame, videos: DataFrame) -> DataFrame:
    """Pending items with context, clean text, embeddable text and keywords."""
    context = views.item_context(store.pending_items(items), mail, pages, videos)
    return text_jobs.embeddable_text(text_jobs.clean_items(context))


def seed_centroids(spark, embedder: C.Embedder, dim: int) -> DataFrame:
    """One vector per group from its seed text."""
    embedded = C.embed(dimensions.seed_texts(spark), "seed_text", embedder, dim)
    return embedded.select("category", F.col("embedding").alias("centroid"))


def enrich(
    items: DataFrame,
    mail: DataFrame,
    pages: DataFrame,
    videos: DataFrame,
    embedder: C.Embedder,
    dim: int = K.VECTOR_DIM,
    batch: int = K.EMBED_BATCH,
    keep_embeddings: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(enriched, rejects).  A bad row becomes a reject with a reason, never an exception.

    Both outputs are cut from the embedded rows.  With ``keep_embeddings`` those
    are checkpointed first, so cleaning and model run once for the two of them;
    splitting before the model would clean every text twice.
    """
    prepared = prepare(items, mail, pages, videos)
    embedded = C.embed(prepared, "embeddable_text", embedder, dim, batch, blank_error=NO_TEXT)
    if keep_embeddings:
        embedded = cut_lineage(embedded)
    good = embedded.filter(F.col("embedding").isNotNull()).drop("embed_error")
    rejects = embedded.filter(F.col("embedding").isNull()).select(
        "memory_id", F.coalesce("embed_error", F.lit("unknown")).alias("reason")
    )
    spark = items.sparkSession
    enriched = C.classify(good, dimensions.domain_map(spark), seed_centroids(spark, embedder, dim))
    return enriched, rejects


def registry_rows(enriched: DataFrame, version: str, indexed_at) -> DataFrame:
    return enriched.select(
        "memory_id",
        F.lit(version).alias("embedding_version"),
        F.size("embedding").alias("vector_dimension"),
        indexed_at.alias("indexed_at"),
        "embeddable_text", "embedding",
    )


def run_counts(enriched: DataFrame, rejects: DataFrame) -> DataFrame:
    """Processed and failed rows of one run."""
    outcome = enriched.select(F.lit("ok").alias("outcome")).unionByName(
        rejects.select(F.lit("failed").alias("outcome"))
    )
    return outcome.agg(
        F.count_if(F.col("outcome") == "ok").alias("processed"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    )
