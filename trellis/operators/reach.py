"""Path lengths from many nodes at once, by blocks of starting points that walk together.

A hub makes the result as large as starting points times nodes, so nothing on the way may
have a row per pair: a block's surroundings are gathered once for all of its starting
points, which walk over them as the bits of words, and the pairs are only unfolded in the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.graph import both_ways, passes
from trellis.session import cut

#: Starting points of a block, and pairs of a node and a starting point that are unfolded together.
BLOCK, UNFOLDED = 256, 1 << 18


def _walk(a: np.ndarray, b: np.ndarray, roots: np.ndarray, n: int, max_length: int) -> np.ndarray:
    """Who reaches whom by which length: a bit per starting point, as words by (length, word, node), from links a -> b of n nodes."""
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, int)
    ends, k = b[starts], np.arange(len(roots))
    levels = np.zeros((max_length + 1, -(-len(roots) // 64), n), "<u8")
    levels[0, k // 64, roots] = np.uint64(1) << (k % 64).astype("<u8")
    seen = levels[0].copy()
    for i in range(1, max_length + 1 if len(b) else 0):
        for w in range(levels.shape[1]):
            levels[i, w, ends] = np.bitwise_or.reduceat(levels[i - 1, w][a], starts) & ~seen[w, ends]
            seen[w] |= levels[i, w]
    return levels


def _unfold(ids: pa.Array, names: pa.Array, levels: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per run of nodes: the names of the starting points, and by node and length the places of those that reach it."""
    step = max(1, UNFOLDED // len(names))
    for low in range(0, len(ids), step):
        words = np.ascontiguousarray(levels[:, :, low : low + step].transpose(2, 0, 1))
        some = words.any(axis=2)
        node, length = np.nonzero(some)
        words = words[some]
        bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
        at = np.flatnonzero(bits.view(bool)) % bits.shape[1]
        ends = np.r_[0, np.cumsum(np.bitwise_count(words).sum(axis=1))]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))
        rows = pa.StructArray.from_arrays([ids.take(pa.array(low + node)), pa.array(length, pa.int32()), lists], ["id", "length", "at"])
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(names)], names), pa.ListArray.from_arrays([0, len(rows)], rows)], ["names", "rows"])


def _blocks(max_length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        whole = pa.Table.from_batches(got) if got else pa.table({"block": pa.array([], pa.int32())})
        for block in pc.unique(whole["block"]):
            t = whole.filter(pc.equal(whole["block"], block)).combine_chunks()
            t = t.take(pc.sort_indices(t["n"]))
            n, near = t["n"].to_numpy(), t["near"].combine_chunks()
            a = np.repeat(np.arange(len(n)), pc.fill_null(pc.list_value_length(near), 0).to_numpy())
            b = np.searchsorted(n, near.flatten().to_numpy())
            roots, ids = np.flatnonzero(t["root"].to_numpy()), t["id"].combine_chunks()
            yield from _unfold(ids, ids.take(pa.array(roots)), _walk(a, b, roots, len(n), max_length))

    return run


def lengths(edges: DataFrame, start: DataFrame, max_length: int = 5, min_score: float = 0.0) -> DataFrame:
    """Shortest undirected path lengths: (root, id, length), from every ``root`` of ``start`` to all it reaches.

    A task holds one block's surroundings: 8 bytes a link, and per node its name and 32 bytes a length.
    """
    roots = cut(start.select("root").distinct())
    count = roots.count()
    blocks = max(1, -(-count // BLOCK), min(count, edges.sparkSession.sparkContext.defaultParallelism))
    links = cut(edges.filter(passes(min_score, None)).select("src", "dst"))
    own = roots.select(F.col("root").alias("id"), F.pmod(F.xxhash64("root"), F.lit(blocks)).cast("int").alias("own"))
    ends = links.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(own.select("id")).distinct()
    numbers = cut(ends.join(own, "id", "left").withColumn("n", F.monotonically_increasing_id()))
    n = numbers.select("id", "n")
    pairs = links.join(n.toDF("src", "a"), "src").join(n.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    near = both_ways(pairs).unionByName(n.select(F.col("n").alias("a"), F.col("n").alias("b"))).groupBy(F.col("a").alias("n")).agg(F.collect_set("b").alias("near"))
    nodes = cut(numbers.join(near, "n"))
    # a node is among its own neighbours, so those that were there before, whose links are walked, are seen again as such
    found = nodes.filter("own IS NOT NULL").select(F.col("own").alias("block"), "n", F.lit(False).alias("inner"))
    for _ in range(max_length):
        found = found.join(nodes.select("n", "near"), "n").select("block", F.explode("near").alias("m"), "n").groupBy("block", "m").agg(F.max(F.col("n") == F.col("m")).alias("inner")).withColumnRenamed("m", "n")
    parts = found.join(nodes, "n").select("block", "n", "id", F.when(F.col("inner"), F.col("near")).alias("near"), F.col("own").eqNullSafe(F.col("block")).alias("root"))
    walked = parts.repartitionById(blocks, F.col("block")).mapInArrow(_blocks(max_length), "names array<string>, rows array<struct<id: string, length: int, at: array<int>>>")
    return walked.select("names", F.inline("rows")).select("names", "id", "length", F.explode("at").alias("k")).select(F.col("names")[F.col("k")].alias("root"), "id", "length")
