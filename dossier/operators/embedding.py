"""Embedders and rerankers as objects that workers load once, and the gate before texts leave the machine."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from ipaddress import ip_address
from typing import Protocol
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 64
# What a setting may say for yes.
YES = {"1", "true", "yes", "on"}


class Embedder(Protocol):
    """Small and picklable, as it goes with the tasks; a model is loaded on first use, in the worker."""

    name: str

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


class Reranker(Protocol):
    def scores(self, query: str, texts: list[str]) -> list[float]: ...


class HashEmbedder:
    """Signed counts of hashed words, of length one: needs no model; for tests and as a last resort."""

    def __init__(self, width: int = 64):
        self.width, self.name = width, f"hash-{width}"

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return [self.embed_query(t) for t in texts]

    def embed_query(self, text: str) -> list[float]:
        out = [0.0] * self.width
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[h % self.width] += 1.0 if h >> 63 else -1.0
        norm = sum(x * x for x in out) ** 0.5
        return [x / norm for x in out] if norm else out


def is_loopback(url: str) -> bool:
    """Whether a service's address is this machine: localhost, or a literal address of the loopback range.  No name is looked up."""
    try:
        host = urlsplit(url if "//" in url else f"//{url}").hostname
    except ValueError:  # not an address at all
        return False
    if host == "localhost":
        return True
    try:
        return ip_address(host or "").is_loopback
    except ValueError:  # any other name
        return False


def require_consent(flag: bool, url: str | None = None, variable: str = "ALLOW_EXTERNAL_PROCESSING", env: dict[str, str] | None = None) -> None:
    """Raises PermissionError unless the caller, the environment or a local address allows texts to be sent."""
    stated = (os.environ if env is None else env).get(variable, "")
    if not (flag or stated.strip().lower() in YES or (url is not None and is_loopback(url))):
        raise PermissionError(f"sending texts to {url or 'an external service'} needs explicit consent (a flag, or {variable}=1)")


def embed(rows: DataFrame, embedder: Embedder, text: str = "text", vector: str = "vector", error: str | None = None) -> DataFrame:
    """rows with a vector, BATCH texts a call; vectors of one call must be as many as its texts and of one width.

    With error, a failing batch is tried text by text and the message of a text
    that fails goes to that column, its vector staying null.  Null texts get no
    vector.
    """
    def run(texts: list[str]) -> list[list[float]]:
        found = embedder.embed_documents(texts)
        if len(found) != len(texts) or len({len(v) for v in found}) > 1:
            raise ValueError("the embedder gave vectors of different widths, or not one for each text")
        return [[float(x) for x in v] for v in found]

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list = [None] * len(frame)
            errors: list = [None] * len(frame)
            at = [i for i, t in enumerate(frame[text]) if isinstance(t, str)]
            for k in range(0, len(at), BATCH):
                some = at[k : k + BATCH]
                try:
                    got = run([frame[text].iloc[i] for i in some])
                except Exception:
                    if error is None:
                        raise
                    got = []
                    for i in some:
                        try:
                            got += run([frame[text].iloc[i]])
                        except Exception as e:  # one bad text is that text's failure
                            got.append(None)
                            errors[i] = f"{type(e).__name__}: {e}"
                for i, v in zip(some, got):
                    vectors[i] = v
            yield frame.assign(**{vector: vectors} | ({error: errors} if error else {}))

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", `{vector}` array<double>" + (f", `{error}` string" if error else "")
    return rows.mapInPandas(task, kinds)


def rerank(hits: DataFrame, reranker: Reranker, query: str, k: int, keys: tuple[str, ...] = ("source", "ord")) -> DataFrame:
    """The k hits (a channel's few top rows, in one batch) that the reranker scores highest, ties by keys; score becomes its score."""
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(score=[round(float(x), 6) for x in reranker.scores(query, frame["text"].fillna("").tolist())] if len(frame) else [])

    scored = hits.withColumn("score", F.col("score").cast("double"))
    scored = scored.mapInPandas(task, scored.schema).orderBy(F.desc("score"), *keys).limit(k)
    return scored.withColumn("score_kind", F.lit("rerank"))
