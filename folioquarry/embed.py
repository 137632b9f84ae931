"""Embedding backends and the packing client that runs beside the data, on the executors."""

from __future__ import annotations

import hashlib
import json
import logging
import math
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import replace
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import EmbeddingConfig
from .operators.chunking import pack_batches, wire_split, wire_tokens

WAITS = (1, 2, 4)
#: Where servers put the reason of a refusal, in order.
REASONS = (("error", "message"), ("error",), ("message",), ("detail",))
log = logging.getLogger(__name__)


class Backend(Protocol):
    def vectors(self, texts: list[str]) -> list[list[float]]: ...


class HashBackend:
    """Deterministic vectors without a server: signed hashes of words, unit length."""

    def __init__(self, config: EmbeddingConfig):
        self.dim = config.dimensions

    def vectors(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dim)
            for w in text.lower().split():
                h = hashlib.md5(w.encode(), usedforsecurity=False).digest()
                v[int.from_bytes(h[:6]) % self.dim] += 1 if h[15] & 1 else -1
            n = math.sqrt(float(v @ v))
            out.append((v / n if n else v).tolist())
        return out


def reason(body: bytes) -> str:
    """What a server says about a refused request, dug out of its JSON; else the first 500 characters."""
    text = body.decode("utf-8", "replace").strip()
    if not text:
        return "(empty response body)"
    try:
        data = json.loads(text)
    except ValueError:
        return text[:500]
    for path in REASONS:
        at = data
        for key in path:
            at = at.get(key) if isinstance(at, dict) else None
        if at or (at is not None and path != ("error", "message") and path != ("error",)):
            return at if isinstance(at, str) else str(at)
    return text[:500]


class HttpBackend:
    """An OpenAI-style or Ollama-style server; lost connections are tried again, answers with an error are not."""

    def __init__(self, config: EmbeddingConfig):
        self.config = config

    def call(self, path: str, body: dict | None = None) -> dict:
        c = self.config
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {c.api_key}"} if c.api_key else {})
        req = urllib.request.Request(c.base_url.rstrip("/") + path, None if body is None else json.dumps(body).encode(), headers)
        for wait in (*WAITS[:-1], None):
            try:
                with urllib.request.urlopen(req, timeout=c.timeout) as r:
                    return json.load(r)
            except urllib.error.HTTPError as e:
                raise RuntimeError(f"embedding server: {e.code} {reason(e.read())}") from e
            except OSError:
                if wait is None:
                    raise
                time.sleep(wait)
        raise AssertionError

    def vectors(self, texts: list[str]) -> list[list[float]]:
        c = self.config
        name = c.model if c.served_name is None else c.served_name
        body = ({"model": name} if name else {}) | {"input": texts}
        if c.backend == "ollama":
            return self.call("/api/embed", body)["embeddings"]
        data = self.call("/v1/embeddings", body)["data"]
        return [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]


def preflight(config: EmbeddingConfig) -> EmbeddingConfig:
    """The configuration with the model's name as the server has it, after one embedding of the configured dimension.

    A server that lists no models, or none at all, is taken at the configured
    name, or at none.  One that serves a single other model is used under its
    name; one that serves several, but not the one configured, is an error.
    """
    if config.backend == "openai":
        try:
            served = [m["id"] for m in HttpBackend(config).call("/v1/models").get("data", []) if m.get("id")]
        except (RuntimeError, OSError, ValueError, KeyError, TypeError, AttributeError) as e:
            log.debug("models can't be listed (%s)", e)
        else:
            if len(served) > 1 and config.model not in served:
                raise RuntimeError(f"{config.base_url} does not serve {config.model!r}; it serves {', '.join(served)}")
            if served and config.model not in served:
                log.warning("configured model %r, served %r: using the latter", config.model, served[0])
            config = replace(config, served_name=config.model if config.model in served else served[0] if served else "")
    embed_texts(["dimension probe"], backend(config), config)  # wrong dimensions raise
    return config


def backend(config: EmbeddingConfig) -> Backend:
    return HashBackend(config) if config.backend == "hash" else HttpBackend(config)


def embed_texts(texts: list[str | None], client: Backend, config: EmbeddingConfig) -> list[list[float] | None]:
    """A vector per text: one line each, long ones in pieces whose vectors are averaged; None where nothing can be embedded."""
    pieces, owner = [], []
    for i, t in enumerate(texts):
        line = re.sub(r"\s+", " ", t or "").strip()
        if any(c.isalnum() for c in line):
            for p in wire_split(line, config.max_tokens_per_request):
                pieces.append(p)
                owner.append(i)
    found: dict[int, list[np.ndarray]] = {}
    for batch in pack_batches([wire_tokens(p) for p in pieces], config.batch_size, config.max_tokens_per_request):
        got = client.vectors([pieces[k] for k in batch])
        for k, v in zip(batch, got, strict=True):
            if len(v) != config.dimensions:
                raise ValueError(f"expected vectors of {config.dimensions}, got {len(v)}")
            found.setdefault(owner[k], []).append(np.asarray(v))
    out: list[list[float] | None] = []
    for i in range(len(texts)):
        vs = found.get(i)
        if not vs:
            out.append(None)
        elif len(vs) == 1:
            out.append(vs[0].tolist())
        else:
            m = np.mean(vs, axis=0)
            n = float(np.linalg.norm(m))
            out.append((m / n if n else m).tolist())
    return out


def embed_column(df: DataFrame, text_col: str, vector_col: str, config: EmbeddingConfig) -> DataFrame:
    """Adds ``vector_col``; requests are packed within each Arrow batch, one client per task."""
    schema = df.drop(vector_col).withColumn(vector_col, F.lit(None).cast("array<float>")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = backend(config)
        for pdf in batches:
            yield pdf.assign(**{vector_col: embed_texts(pdf[text_col].tolist(), client, config)})

    return df.drop(vector_col).mapInPandas(run, schema)
