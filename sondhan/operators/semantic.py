"""Dense retrieval: embedders as plug-ins, exact cosine neighbours."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondhan.operators.blocks import block_join
from sondhan.operators.lexical import top_k


class Embedder(Protocol):
    """Turns texts into vectors; created once a worker."""

    name: str
    size: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Deterministic built-in: signed hashes of character trigrams, normalised."""

    def __init__(self, size: int = 64):
        self.name, self.size = f"hash-{size}", size

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for i, t in enumerate(texts):
            low = f" {t.lower()} "
            for j in range(len(low) - 2):
                h = zlib.crc32(low[j : j + 3].encode())
                out[i, h % self.size] += 1.0 if h & 0x80000000 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def embed(df: DataFrame, key: str, text: str, embedder: Embedder) -> DataFrame:
    """(key, model, text_hash, embedding): the hash tells a cache whether the text has changed."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors = embedder.embed([t or "" for t in f[text]])
            yield pd.DataFrame({key: f[key], "model": embedder.name, "text_hash": f["text_hash"], "embedding": list(vectors)})

    rows = df.select(key, text, F.xxhash64(text).alias("text_hash"))
    return rows.mapInPandas(run, f"`{key}` {kind}, model string, text_hash long, embedding array<float>")


def cosine_top_k(queries: DataFrame, items: DataFrame, query: str, item: str, vector: str, k: int = 10) -> DataFrame:
    """The k nearest items of each query by exact cosine, ties to the smaller item; null vectors are left out.

    Queries meet the items block by block, and only the best k of a block of items are shuffled on.
    """
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    qk, ik = queries.schema[query].dataType.simpleString(), items.schema[item].dataType.simpleString()

    def run(q: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(f):
            return pd.DataFrame({query: [], item: [], "score": []})
        ids = f["i"].to_numpy()
        order = np.argsort(ids, kind="stable")
        mine, theirs = (unit(np.stack([np.asarray(x, np.float64) for x in v])) for v in (q["v"], f["v"]))
        scores = np.round(mine @ theirs[order].T, 6)
        at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({query: np.repeat(q["q"].to_numpy(), at.shape[1]), item: ids[order][at].ravel(), "score": np.take_along_axis(scores, at, 1).ravel()})

    asked = queries.select(F.col(query).alias("q"), F.col(vector).alias("v")).filter("v is not null")
    given = items.select(F.col(item).alias("i"), F.col(vector).alias("v")).filter("v is not null")
    return top_k(block_join(asked, given, "q", "i", run, f"`{query}` {qk}, `{item}` {ik}, score double"), k, query, item)


def embed_missing(df: DataFrame, key: str, text: str, embedder: Embedder, cache: DataFrame | None) -> DataFrame:
    """Embeddings of all rows, computed only where ``cache`` (a result of ``embed``) has none of this model for this very text."""
    if cache is None:
        return embed(df, key, text, embedder)
    known = cache.filter(F.col("model") == embedder.name).dropDuplicates([key, "text_hash"])
    rows = df.select(key, text, F.xxhash64(text).alias("text_hash"))
    fresh = embed(rows.join(known.select(key, "text_hash"), [key, "text_hash"], "left_anti"), key, text, embedder)
    kept = known.join(rows.select(key, "text_hash"), [key, "text_hash"], "left_semi").select(*fresh.columns)
    return kept.unionByName(fresh)


def knn_by_model(queries: DataFrame, vectors: DataFrame, query: str, item: str, text: str, embedders: list[Embedder], k: int = 10) -> DataFrame:
    """(model, query, item, score, rank): the k nearest items of each query text by each model's own vectors.

    ``vectors``: (item, model, embedding), as ``embed`` gives them.
    """
    out = None
    for e in embedders:
        asked = embed(queries, query, text, e).select(query, "embedding")
        near = cosine_top_k(asked, vectors.filter(F.col("model") == e.name).select(item, "embedding"), query, item, "embedding", k).withColumn("model", F.lit(e.name))
        out = near if out is None else out.unionByName(near)
    if out is None:
        raise ValueError("no embedder given")
    return out.select("model", query, item, "score", "rank")
