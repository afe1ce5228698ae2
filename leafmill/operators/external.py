"""Models as injected functions: embedding and chat, with deterministic stand-ins."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64


def hashed_embedding(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """A stand-in for an embedding model: signed hashed words, normalised; a text without words is zero."""
    out = np.zeros((len(texts), dimensions))
    for i, text in enumerate(texts):
        for w in (text or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[i, h % dimensions] += 1 if h >> 63 else -1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n == 0, 1, n)


def with_retries(call: Callable, tries: int = 5, wait: float = 1.0) -> Callable:
    """call, tried again with doubled waits; the last error is raised."""

    def run(*args):
        for i in range(tries):
            try:
                return call(*args)
            except Exception:
                if i + 1 == tries:
                    raise
                time.sleep(wait * 2**i)

    return run


def embed(df: DataFrame, text: str, model: Callable[[list[str]], np.ndarray] = hashed_embedding, batch: int = 50, name: str = "embedding") -> DataFrame:
    """df with a vector of each text, asked for in batches; a wrong number of vectors is an error."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = with_retries(model)
        for part in parts:
            rows: list = []
            for i in range(0, len(part), batch):
                asked = part.iloc[i : i + batch].tolist()
                got = ask(asked)
                if len(got) != len(asked):
                    raise ValueError(f"{len(got)} vectors for {len(asked)} texts")
                rows += [np.asarray(v, np.float32) for v in got]
            yield pd.Series(rows, index=part.index)

    return df.withColumn(name, run(F.col(text)))


def embed_pending(chunks: DataFrame, text: str, model_id: str, model: Callable = hashed_embedding) -> DataFrame:
    """Chunks with vectors of the named model: only those without one, or with another model's, are embedded."""
    current = F.col("embedding").isNotNull() & F.col("embedding_model").eqNullSafe(model_id)
    fresh = embed(chunks.where(~current).drop("embedding"), text, model).withColumn("embedding_model", F.lit(model_id))
    return chunks.where(current).unionByName(fresh.select(*chunks.columns))


def chat(df: DataFrame, prompt: str, model: Callable[[str], str], name: str = "answer") -> DataFrame:
    """df with a model's answer to each prompt."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = with_retries(model)
        for part in parts:
            yield part.map(lambda x: None if x is None else ask(x))

    return df.withColumn(name, run(F.col(prompt)))
