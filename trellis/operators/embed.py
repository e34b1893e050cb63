"""Vectors of nodes from an injected function, with a cache by content hash."""

from __future__ import annotations

import hashlib
import math
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.records import embeddable, last_by

MAX_CHARS, BATCH = 30_000, 16


def hash_vector(text: str, dim: int = 64) -> list[float]:
    """A deterministic unit vector from a stream of digests, for tests and runs without a service."""
    out: list[float] = []
    n = 0
    while len(out) < dim:
        d = hashlib.sha256(f"{n}:{text}".encode()).digest()
        out += [int.from_bytes(d[i : i + 4], "big") / 2**31 - 1 for i in range(0, 32, 4)]
        n += 1
    size = math.sqrt(sum(x * x for x in out[:dim]))
    return [x / size for x in out[:dim]]


def pending(nodes: DataFrame, cache: DataFrame) -> DataFrame:
    """Embeddable nodes whose last cached line has another hash, or that have none."""
    c = last_by(cache, "node_id", ["append_seq"], "sha").select(F.col("node_id").alias("id"), F.col("sha").alias("content_hash"))
    return embeddable(nodes).join(c, ["id", "content_hash"], "left_anti")


def compute(nodes: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = BATCH) -> DataFrame:
    """(node_id, sha, vec) for (id, content, content_hash); a batch that fails is tried text by text, a text that fails is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                texts = [t[:MAX_CHARS] for t in part["content"]]
                try:
                    vectors = embed(texts)
                    if len(vectors) != len(texts):
                        raise ValueError("the function gave another number of vectors than texts")
                except Exception:  # noqa: BLE001
                    vectors = []
                    for t in texts:
                        try:
                            vectors.append(embed([t])[0])
                        except Exception:  # noqa: BLE001
                            vectors.append(None)
                rows += [(i, h, [float(x) for x in v]) for i, h, v in zip(part["id"], part["content_hash"], vectors) if v is not None]
            yield pd.DataFrame(rows, columns=["node_id", "sha", "vec"])

    return nodes.select("id", "content", "content_hash").mapInPandas(run, "node_id string, sha string, vec array<float>")


def extend_cache(nodes: DataFrame, cache: DataFrame, embed: Callable[[list[str]], list[list[float]]], append_seq: int) -> DataFrame:
    """The cache's new lines: only what is not cached under its present hash is computed."""
    return compute(pending(nodes, cache), embed).withColumn("append_seq", F.lit(append_seq).cast("long"))


def check_consistency(indexed: dict, now: dict) -> list[str]:
    """Warn where backend, model or dimension of a query differ from those the index was made with."""
    bad = [k for k in ("backend", "model", "dim") if k in indexed and indexed[k] != now.get(k)]
    for k in bad:
        warnings.warn(f"vectors were indexed with {k} {indexed[k]!r}, the query uses {now.get(k)!r}", stacklevel=2)
    return bad
