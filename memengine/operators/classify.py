"""Four-stage group cascade and the embedding step."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.core import ends_with_any, let, string_array
from ..runtime import bounded_batches, bounded_broadcast, within
from .knn import knn

RESULT = "struct<category:string,method:string,confidence:double>"
FEW_CENTROIDS = 1000


class Embedder(Protocol):
    """Shipped to the workers; ``load`` runs once per task and returns the model call."""

    def load(self) -> Callable[[Sequence[str]], np.ndarray]: ...


def _verdict(category: Column | str, method: str, confidence: Column | float) -> Column:
    cat = F.lit(category) if isinstance(category, str) else category
    conf = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(cat.alias("category"), F.lit(method).alias("method"), conf.alias("confidence"))


def structural_group() -> Column:
    """Stage 1 over item-context columns; NULL when no rule fires."""
    labels = F.coalesce(F.col("gmail_labels"), F.array().cast("array<string>"))
    sender = F.coalesce(F.col("sender_domain"), F.lit(""))
    domain = F.coalesce(F.col("domain"), F.lit(""))
    category = F.col("youtube_category_id")

    def labelled(names: list[str]) -> Column:
        return F.arrays_overlap(labels, string_array(names))

    mail = (
        F.when(labelled(K.PERSONAL_LABELS), "personal")
        .when(labelled(K.BULK_LABELS), "misc")
        .when(ends_with_any(sender, K.MAIL_STUDY_SUFFIXES), "study")
        .when(sender.isin(K.WORK_DOMAINS), "work")
    )
    video = (
        F.when(F.coalesce(F.col("is_short"), F.lit(False)), "entertainment")
        .when(category.isin(K.STUDY_CATEGORIES), "study")
        .when(category.isin(K.ENTERTAINMENT_CATEGORIES), "entertainment")
    )
    page = (
        F.when(ends_with_any(domain, K.PAGE_STUDY_SUFFIXES), "study")
        .when(domain.isin(K.WORK_DOMAINS), "work")
        .when(domain.isin(K.ENTERTAINMENT_DOMAINS), "entertainment")
    )
    source = F.lower("source_type")
    found = F.when(source == "gmail", mail).when(source == "youtube", video).when(source == "chrome", page)
    return F.when(found.isNotNull(), _verdict(found, "structural", K.STRUCTURAL_CONFIDENCE))


def domain_group(df: DataFrame, domain_map: DataFrame, out: str = "stage2") -> DataFrame:
    """Stage 2: exact host lookup, pages only.  The map is broadcast if its size allows."""
    lookup = domain_map.select("domain", F.col("category").alias("_category"))
    hit = F.when(
        (F.lower("source_type") == "chrome") & F.col("_category").isNotNull(),
        _verdict(F.col("_category"), "domain", K.DOMAIN_CONFIDENCE),
    )
    return df.join(bounded_broadcast(lookup), "domain", "left").withColumn(out, hit).drop("_category")


def centroid_scores(
    df: DataFrame, centroids: DataFrame, vector: str = "embedding", few: int = FEW_CENTROIDS, key: str = "memory_id"
) -> DataFrame:
    """Adds ``scores``: best category, best and second-best cosine.

    Up to ``few`` centroids ride along with the tasks.  More are searched block
    by block as the two nearest of each vector, and joined by ``key``.  Which of
    the categories a zero vector names is open; its scores are 0.
    """
    if not within(centroids, few):
        return _centroid_search(df, centroids, vector, key)
    rows = centroids.orderBy("category").collect()
    names = np.array([r["category"] for r in rows], dtype=object)
    matrix = np.array([r["centroid"] for r in rows], dtype=np.float64).reshape(len(rows), -1)
    norms = np.linalg.norm(matrix, axis=1)
    unit = np.divide(matrix, norms[:, None], out=np.zeros_like(matrix), where=norms[:, None] > 0)

    @F.pandas_udf("best string, best_score double, second_score double")
    def score(batch: pd.Series) -> pd.DataFrame:
        best, first, second = (np.full(len(batch), None, dtype=object) for _ in range(3))
        sized = np.array([v is not None and len(v) == unit.shape[1] for v in batch], dtype=bool)
        if sized.any() and len(names):
            x = np.stack(batch[sized].to_list()).astype(np.float64)
            length = np.linalg.norm(x, axis=1)
            sims = x @ unit.T / np.where(length > 0, length, 1.0)[:, None]
            order = np.argsort(-sims, axis=1, kind="stable")[:, :2]
            top = np.take_along_axis(sims, order, axis=1)
            best[sized], first[sized] = names[order[:, 0]], top[:, 0]
            if len(names) > 1:
                second[sized] = top[:, 1]
        return pd.DataFrame({"best": best, "best_score": first, "second_score": second})

    return df.withColumn("scores", score(F.col(vector)))


def _unit(vector: Column) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return let(
        F.sqrt(squares),
        lambda norm: F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0))),
    )


def _centroid_search(df: DataFrame, centroids: DataFrame, vector: str, key: str) -> DataFrame:
    dim = centroids.agg(F.max(F.size("centroid"))).first()[0]
    near = knn(
        df.select(F.col(key).alias("query_id"), _unit(F.col(vector)).alias("query_vector")),
        centroids.select(F.col("category").alias("memory_id"), _unit(F.col("centroid")).alias("embedding")),
        k=2, dim=dim,
    )

    def at(column: str, rank: int) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col(column)))

    best = near.groupBy(F.col("query_id").alias(key)).agg(
        F.struct(
            at("memory_id", 1).alias("best"), at("similarity", 1).alias("best_score"),
            at("similarity", 2).alias("second_score"),
        ).alias("scores")
    )
    return df.join(best, key, "left")


def centroid_group(
    df: DataFrame,
    centroids: DataFrame,
    min_score: float = K.CENTROID_MIN_SCORE,
    margin: float = K.CENTROID_MIN_MARGIN,
    out: str = "stage3",
) -> DataFrame:
    """Stage 3: clear nearest centroid; both bounds are strict."""
    scored = centroid_scores(df, centroids)
    best, second = F.col("scores.best_score"), F.coalesce(F.col("scores.second_score"), F.lit(-1.0))
    clear = (best > min_score) & (best - second > margin)
    return scored.withColumn(out, F.when(clear, _verdict(F.col("scores.best"), "centroid", best))).drop("scores")


def classify(df: DataFrame, domain_map: DataFrame, centroids: DataFrame | None = None) -> DataFrame:
    """First stage that fires, else the constant fallback; adds category, method, confidence."""
    staged = domain_group(df.withColumn("stage1", structural_group()), domain_map)
    stages = ["stage1", "stage2"]
    if centroids is not None:
        staged = centroid_group(staged, centroids)
        stages.append("stage3")
    fallback = _verdict("misc", K.FALLBACK_METHOD, K.FALLBACK_CONFIDENCE)
    chosen = F.coalesce(*[F.col(s).cast(RESULT) for s in stages], fallback.cast(RESULT))
    return staged.withColumn("_v", chosen).select(*df.columns, "_v.*")


def embed(
    df: DataFrame,
    text: str,
    embedder: Embedder,
    dim: int = K.VECTOR_DIM,
    batch: int = K.EMBED_BATCH,
    blank_error: str | None = None,
) -> DataFrame:
    """Adds ``embedding`` (NULL on failure) and ``embed_error``.

    A failing batch is retried text by text, so one bad text costs only itself.
    With ``blank_error`` blank texts get that error and never reach the model.
    Only the text goes to the Python workers, in batches bounded by rows and bytes.
    """
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in ("embedding", "embed_error")]

    def checked(vectors: np.ndarray, n: int) -> list:
        found = np.asarray(vectors, dtype=np.float32)
        if found.shape != (n, dim):
            raise ValueError(f"expected shape {(n, dim)}, got {found.shape}")
        return list(found)

    def vectors_of(model, texts: list[str]) -> list[tuple]:
        try:
            return [(v, None) for v in checked(model(texts), len(texts))]
        except Exception as exc:
            if len(texts) == 1:
                return [(None, str(exc))]
            return [pair for one in texts for pair in vectors_of(model, [one])]

    @F.pandas_udf("embedding array<float>, embed_error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = embedder.load()
        for rows in batches:
            texts = [(t or "").strip() for t in rows]
            found: list[tuple] = [(None, blank_error)] * len(texts)
            wanted = [n for n, t in enumerate(texts) if t or blank_error is None]
            for at in range(0, len(wanted), batch):
                part = wanted[at : at + batch]
                for n, pair in zip(part, vectors_of(model, [texts[n] for n in part])):
                    found[n] = pair
            yield pd.DataFrame({"embedding": [v for v, _ in found], "embed_error": [e for _, e in found]}, dtype=object)

    # a model need not answer alike twice, and is too dear to run once for each use of its columns
    return df.withColumn("_embedded", run.asNondeterministic()(F.col(text))).select(*kept, "_embedded.embedding", "_embedded.embed_error")
