"""Retrieval: keyword, vector and exact signals, fused by reciprocal rank; entry points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions import text, vec
from trellis.operators.graph import both_ways, passes
from trellis.session import cut

K1, B = 1.5, 0.75
RRF_K = 60


def postings(docs: DataFrame, id_col: str, body: Column) -> DataFrame:
    """Inverted index (term, id, tf, len): build once, write it bucketed by term, and search it many times."""
    terms = docs.select(F.col(id_col).alias("id"), text.index_terms(body).alias("t"))
    flat = terms.select("id", F.size("t").alias("len"), F.explode("t").alias("term"))
    return flat.groupBy("term", "id", "len").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, id_col: str, body: Column, query: list[str], top_k: int | None = None) -> DataFrame:
    """BM25 scores (id, score) above 0 for the query terms, which count as often as they are given.

    A term in more than half of the documents has a negative weight, in place of which
    a quarter of the mean weight of all terms is taken.

    Nothing of a document is shuffled: the frequencies of the query's terms are counted in
    its row, and only document frequencies, combined on the map side, are exchanged.
    """
    spark = docs.sparkSession
    terms = docs.select(F.col(id_col).alias("id"), text.index_terms(F.coalesce(body, F.lit(""))).alias("t"))
    stats = terms.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean"))
    df = terms.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(stats)).withColumn("idf", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))  # stats is one row
    wanted = sorted(set(query))
    # one row: the mean weight, the mean length, and the weights of the query's terms, which are few
    told = idf.agg(F.avg("idf").alias("floor"), F.first("mean").alias("mean"), *[F.max(F.when(F.col("term") == t, F.col("idf"))).alias(f"w{i}") for i, t in enumerate(wanted)])
    size = F.size("t")

    def times(t: str) -> Column:
        return F.size(F.filter("t", lambda x: x == t))

    seen = terms.select("id", size.alias("len"), *[times(t).alias(f"f{i}") for i, t in enumerate(wanted)])
    any_ = F.greatest(*[F.col(f"f{i}") for i in range(len(wanted))], F.lit(0)) if wanted else F.lit(0)
    part = F.lit(0.0)
    for i, t in enumerate(wanted):
        w = F.when(F.col(f"w{i}") < 0, 0.25 * F.col("floor")).otherwise(F.col(f"w{i}"))
        tf = F.col(f"f{i}")
        part = part + F.when(tf > 0, query.count(t) * w * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))).otherwise(0.0)
    out = seen.filter(any_ > 0).crossJoin(F.broadcast(told)).select("id", part.alias("score")).filter("score > 0")
    return out if top_k is None else out.orderBy(F.desc(F.round("score", 9)), "id").limit(top_k)


def vector_search(vectors: DataFrame, id_col: str, vector_col: str, query: list[float], top_k: int = 10) -> DataFrame:
    """The nearest vectors to one query vector by cosine: a scan and a top-k per partition."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_col).alias("id"), vec.cosine(F.col(vector_col), q).alias("score")).orderBy(F.desc(F.round("score", 9)), "id").limit(top_k)


def knn(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, top_k: int = 5, least: float = -1.0, block: int = 4096) -> DataFrame:
    """For a stated set of query rows the top-k of all rows by cosine: (id, other, score, rank), ties by id.

    Queries go in blocks of at most about ``block``, each of which is broadcast; the vectors are read where they
    lie, once a block, and a batch of them passes on only those that are among the best k it has
    seen for a query. A vector of zeros is similar to none; nulls and other lengths than the block's are left out.
    """
    spark = vectors.sparkSession
    q = cut(queries.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("qv")))
    kind = q.schema["id"].dataType.simpleString()
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias("other"), F.col(vector_col).alias("ov"))
    n = max(1, -(-q.count() // block))
    found = spark.createDataFrame([], f"id {kind}, other {kind}, score double")
    for b in range(n):
        part = q.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == b).orderBy("id").collect()
        if part:
            x = np.array([r["qv"] for r in part], np.float64)
            unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            ids = np.array([r["id"] for r in part], object)
            found = found.unionByName(rows.mapInPandas(_best(spark.sparkContext.broadcast((ids, unit)), top_k, least), found.schema))
    w = Window.partitionBy("id").orderBy(F.desc(F.round("score", 9)), "other")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)


def _best(shared, top_k: int, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, unit = shared.value
        bar = np.full(len(ids), -2.0)
        for pdf in batches:
            keep = [len(v) == unit.shape[1] for v in pdf["ov"]]
            other = pdf["other"].to_numpy()[keep]
            if not len(other):
                continue
            y = np.stack(pdf["ov"].to_numpy()[keep]).astype(np.float64)
            size = np.linalg.norm(y, axis=1)
            other, y = other[size > 0], y[size > 0] / size[size > 0, None]
            out = []
            for at in range(0, len(ids), 512):
                cos = unit[at : at + 512] @ y.T
                # rounded as they are ranked, so that ties with the k-th are passed on
                near = np.where(ids[at : at + 512, None] == other[None, :], -2.0, np.round(cos, 9))
                if near.shape[1] > top_k:
                    kth = np.partition(near, -top_k, axis=1)[:, -top_k]
                    bar[at : at + 512] = np.maximum(bar[at : at + 512], kth)
                p, r = np.nonzero((near >= bar[at : at + 512, None]) & (near > -2.0) & (cos >= least))
                out.append(pd.DataFrame({"id": ids[at + p], "other": other[r], "score": cos[p, r]}))
            yield pd.concat(out)

    return run


def exact(docs: DataFrame, id_col: str, label_col: str, query: str, limit: int | None = None) -> DataFrame:
    """Rows whose id or label holds the query, in any case: (id)."""
    q = query.lower()
    hit = docs.filter(F.lower(F.col(id_col).cast("string")).contains(q) | F.lower(label_col).contains(q)).select(F.col(id_col).alias("id"))
    return hit if limit is None else hit.orderBy("id").limit(limit)


def ranked(hits: DataFrame, signal: str, order: list[Column]) -> DataFrame:
    """Hits of one signal with their ranks. The hits of a signal are a top-k, so one task can number them."""
    return hits.select("id", F.row_number().over(Window.orderBy(*order)).alias("rank"), F.lit(signal).alias("signal"))


def rrf(signals: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (id, rank, signal): an id that a signal names twice counts twice."""
    return signals.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.count("*").alias("hits"))


def hybrid(docs: DataFrame, vectors: DataFrame, query: list[str], query_vector: list[float] | None, top_k: int = 10, namespace: str | None = None) -> DataFrame:
    """Fused search over nodes (id, label, content, namespace) and vectors (id, vec): (id, score, hits).

    Each signal gives a pool of 4 * top_k. Without a query vector that signal is left
    out; ids that are no nodes are dropped before the cut.
    """
    pool = 4 * top_k
    body = F.concat_ws(" ", "label", "label", "content")
    by_score = [F.desc(F.round("score", 9)), F.asc("id")]
    parts = ranked(bm25(docs, "id", body, query, pool), "bm25", by_score)
    parts = parts.unionByName(ranked(exact(docs, "id", "label", " ".join(query), pool), "exact", [F.asc("id")]))
    if query_vector is not None:
        parts = parts.unionByName(ranked(vector_search(vectors, "id", "vec", query_vector, pool), "vector", by_score))
    fused = rrf(parts).join(docs.select("id", "namespace"), "id")
    if namespace is not None:
        fused = fused.filter(F.col("namespace") == namespace)
    return fused.select("id", "score", "hits").orderBy(*by_score).limit(top_k)


def expand(hits: DataFrame, nodes: DataFrame, edges: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Hits and their direct neighbours: (id, label, kind, tokens, via), via being null for the hits themselves."""
    near = both_ways(edges.filter(passes(min_score))).join(hits.select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("via"))
    all_ = hits.select("id", F.lit(None).cast("string").alias("via")).unionByName(near.join(hits.select("id"), "id", "left_anti"))
    return all_.join(nodes.select("id", "label", "kind", "tokens"), "id").select("id", "label", "kind", "tokens", "via")


def entry_points(nodes: DataFrame, query: str, per_namespace: bool = False) -> DataFrame:
    """Where a query enters the graph: (id, namespace, priority).

    Exact label, exact id, alias, the shortest label that holds the query, the tag of
    that name, in this order and without regard to case; ties by id. One scan and one small sort.
    """
    q = query.lower()
    label, node = F.lower("label"), F.lower("id")
    p = (
        F.when(label == q, 1)
        .when(node == q, 2)
        .when(F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a) == q), 3)
        .when(label.contains(q), 4)
        .when(node == "tag:" + q, 5)
    )
    size = F.when(F.col("priority") == 4, F.length("label")).otherwise(0)
    hits = nodes.withColumn("priority", p).filter(F.col("priority").isNotNull())
    if per_namespace:
        w = Window.partitionBy("namespace").orderBy("priority", size, "id")
        return hits.withColumn("k", F.row_number().over(w)).filter("k = 1").select("id", "namespace", "priority")
    return hits.orderBy("priority", size, "id").limit(1).select("id", "namespace", "priority")


def search_lines(files: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """Every line that holds the query: (path, line_no from 1, text of at most 200 characters)."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    hay, needle = (F.col("line"), query) if case_sensitive else (F.lower("line"), query.lower())
    return lines.filter(hay.contains(needle)).select("path", (F.col("i") + 1).alias("line_no"), F.substring("line", 1, 200).alias("text"))
