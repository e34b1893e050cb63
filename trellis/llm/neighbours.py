"""Most similar vectors for every vector (problem 4): a permutation index.

A vector is represented by the order of its PREFIX nearest of P pivots. It is posted in
the inverted files of the first POSTED of them, with its vector and its order. Within a
file the vectors are ranked for each other by Spearman's footrule on the cut orders,

    F = 2 * (S - sum over shared pivots of min(PREFIX - rank_a, PREFIX - rank_b)),

with S = 1 + ... + PREFIX, and for each vector the KEPT nearest by footrule are reranked by
the exact cosine. Pivots are P = 8 * sqrt(n) vectors picked by the hash of their id: a
bounded sample; every vector is indexed.

Recall is lost where a neighbour shares none of the first pivots or is beyond the KEPT of
every shared file; both are measured against brute force (README, tests).

Scale: P and the files grow with the root of n. A file longer than LIST is cut into blocks
whose pairs are separate tasks; each pair of blocks keeps KEPT vectors, so a cut file gives
what the whole one gives and more. Equal vectors are one class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.session import cut, shuffled

PREFIX, POSTED, KEPT, LIST = 12, 8, 128, 4000


def valid_vectors(cache: DataFrame, dim: int = 64) -> DataFrame:
    """The last line per node_id (highest append_seq) if its vector is usable: (node_id, vec).

    Null vectors, other lengths, nulls, NaN or infinities inside and all-zero vectors are left out.
    """
    last = cache.filter(F.col("node_id").isNotNull()).groupBy("node_id").agg(F.max(F.struct(F.coalesce("append_seq", F.lit(-1)).alias("s"), F.col("vec"))).alias("l"))
    v = F.col("vec")
    fine = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return last.select("node_id", F.col("l.vec").alias("vec")).filter(v.isNotNull()).filter(fine)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _post(pivots: np.ndarray, prefix: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(_matrix(b.column("vec"))).astype(np.float32)
            order = np.empty((len(x), prefix), np.int32)
            for at in range(0, len(x), 1024):
                s = x[at : at + 1024] @ pivots.T
                top = np.argpartition(-s, prefix - 1, axis=1)[:, :prefix] if prefix < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(s), 1))
                rank = np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable")
                order[at : at + 1024] = np.take_along_axis(top, rank, 1)
            perm = pa.ListArray.from_arrays(np.arange(0, order.size + 1, prefix, dtype=np.int32), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("n"), b.column("vec"), perm], names=["n", "vec", "perm"])

    return run


def shared_weight(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over shared pivots of min(prefix - rank_a, prefix - rank_b), for all rows of a against all of b.

    Pivot by pivot, over the rows that hold it: the work is that of the shared places only.
    """
    width = a.shape[1]
    out = np.zeros((len(a), len(b)), np.int16)

    def by_pivot(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        flat = m.ravel()
        order = np.argsort(flat, kind="stable")
        keys, first = np.unique(flat[order], return_index=True)
        return keys, np.append(first, len(flat)), order // width, (width - order % width).astype(np.int16)

    ka, ea, ra, wa = by_pivot(a)
    kb, eb, rb, wb = by_pivot(b)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    for i, j in zip(ia.tolist(), ib.tolist()):
        x, y = slice(ea[i], ea[i + 1]), slice(eb[j], eb[j + 1])
        out[ra[x][:, None], rb[y]] += np.minimum.outer(wa[x], wb[y])
    return out


def _rank(k: int, least: float, kept: int):
    """For each row of a file the best k of its ``kept`` nearest by footrule, with those that tie with the k-th."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("n").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, side = ids[order], table.column("side").to_numpy()[order]
        x, perm = _unit(_matrix(table.column("vec")))[order], _matrix(table.column("perm"))[order]
        got = []
        # side 0: all rows against each other; else the rows of two blocks against those of the other
        for left, right in ([(0, 0)] if (side == 0).any() else [(1, 2), (2, 1)]):
            left, right = np.flatnonzero(side == left), np.flatnonzero(side == right)
            for at in range(0, len(left), 1024):
                rows = left[at : at + 1024]
                if not len(right):
                    continue
                weight = shared_weight(perm[rows], perm[right]).astype(np.int64)
                weight[rows[:, None] == right[None, :]] = -1
                # of equal footrules the smaller number comes first
                key = weight * len(right) + np.arange(len(right))[::-1]
                near = np.argpartition(-key, kept - 1, axis=1)[:, :kept] if kept < len(right) else np.tile(np.arange(len(right)), (len(rows), 1))
                cos = np.concatenate([np.einsum("ij,icj->ic", x[rows[i : i + 128]], x[right[near[i : i + 128]]]) for i in range(0, len(rows), 128)])
                cos = np.where((np.take_along_axis(weight, near, 1) > 0) & (cos >= least), np.round(cos, 12), -2.0)
                bar = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k] if k < cos.shape[1] else np.full((len(rows), 1), -2.0)
                p, q = np.nonzero((cos > -2.0) & (cos >= bar))
                got.append((ids[rows[p]], ids[right[near[p, q]]], cos[p, q]))
        a, b, c = (np.concatenate(z) for z in zip(*got)) if got else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"n": pa.array(a, pa.int64()), "o": pa.array(b, pa.int64()), "cos": pa.array(c, pa.float64())})

    return run


def _blocks(lists: DataFrame, limit: int) -> DataFrame:
    """Files longer than ``limit`` as pairs of blocks: a row goes to every pair that its block is part of."""
    # a row per pivot, of which there are 8 * sqrt(n)
    sizes = lists.groupBy("p").agg(F.ceil(F.count("*") / limit).cast("int").alias("parts"))
    block = F.pmod(F.xxhash64("n"), F.col("parts")).cast("int")
    wide = lists.join(F.broadcast(sizes), "p").withColumn("k", block).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("k") == F.col("m"), 0).when(F.col("k") < F.col("m"), 1).otherwise(2)
    return wide.select("n", "vec", "perm", "p", F.least("k", "m").alias("x"), F.greatest("k", "m").alias("y"), side.cast("int").alias("side"))


def near_classes(classes: DataFrame, k: int, least: float, prefix: int = PREFIX, posted: int = POSTED, kept: int = KEPT, list_limit: int = LIST) -> DataFrame:
    """The most similar other vectors of each vector (n bigint, vec): (n, o, cos), at least the best k found, cosines from ``least`` on."""
    spark = classes.sparkSession
    schema = "n bigint, o bigint, cos double"
    n = classes.count()
    if n < 2:
        return spark.createDataFrame([], schema)
    p = min(n, max(16, int(8 * math.sqrt(n))))
    sample = classes.select("vec", F.xxhash64("n").alias("h"), "n").orderBy("h", "n").limit(p).select("vec").collect()
    pivots = spark.sparkContext.broadcast(_unit(np.array([r["vec"] for r in sample], np.float64)).astype(np.float32))
    width = min(prefix, p)

    def post(batches):
        yield from _post(pivots.value, width)(batches)

    orders = cut(classes.select("n", "vec").mapInArrow(post, f"n bigint, vec {classes.schema['vec'].dataType.simpleString()}, perm array<int>"))
    lists = orders.select("n", "vec", "perm", F.explode(F.slice("perm", 1, posted)).alias("p"))
    found = _blocks(lists, list_limit).groupBy("p", "x", "y").applyInArrow(_rank(k, least, kept), schema)
    return found.groupBy("n", "o").agg(F.max("cos").alias("cos"))


def nearest(vectors: DataFrame, k: int = 5, least: float = -1.0, **index) -> DataFrame:
    """The ``k`` most similar other vectors of every vector (node_id, vec): (node_id, other, cos, rank).

    Only pairs with a cosine of at least ``least`` count. Ties go to the smaller id.
    Equal vectors are one class in the index; of a class its first k + 1 ids can be
    somebody's neighbours, which is all that ties leave. Vectors must be usable
    (see ``valid_vectors``); fewer than two give no rows.
    """
    digest = F.sha2(F.array_join(F.transform("vec", lambda x: x.cast("string")), ",").cast("binary"), 256)
    ids = cut(vectors.select("node_id", "vec", digest.alias("d")))
    # numbers are given once and written, so that they stay
    classes = cut(ids.groupBy("d").agg(F.min("node_id").alias("cid"), F.first("vec").alias("vec")).withColumn("n", F.monotonically_increasing_id()))
    members = shuffled(ids.select("node_id", "d"), classes.select("d", "n"), "d").select("node_id", "n")
    found = cut(near_classes(classes, k, least, **index))
    named = shuffled(found, classes.select(F.col("n").alias("o"), F.col("cid").alias("oc")), "o")
    w = Window.partitionBy("n").orderBy(F.desc("cos"), "oc")
    best = named.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= k).select("n", "o", "cos")
    best = best.unionByName(classes.select("n", F.col("n").alias("o"), F.lit(1.0).alias("cos")))
    first = members.withColumn("i", F.row_number().over(Window.partitionBy("n").orderBy("node_id"))).filter(F.col("i") <= k + 1).select(F.col("n").alias("o"), F.col("node_id").alias("other"))
    wide = shuffled(shuffled(members, best, "n"), first, "o").filter("node_id <> other").filter(F.col("cos") >= least)
    r = Window.partitionBy("node_id").orderBy(F.desc("cos"), "other")
    return wide.withColumn("rank", F.row_number().over(r)).filter(F.col("rank") <= k).select("node_id", "other", "cos", "rank")
