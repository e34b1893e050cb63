"""Several namespaces as one graph: qualified ids, bridges, scoped walks, listings per namespace."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis import schema
from trellis.operators import link, traverse
from trellis.operators.graph import qualify
from trellis.session import cut


def tag_bridges(nodes: DataFrame) -> DataFrame:
    """Bridges over tags that notes of several namespaces carry: between ``tag:<name>`` of each pair of them."""
    told = link.shared_tag_bridges(nodes)
    name = F.concat(F.lit("tag:"), "tag")
    return told.select(F.col("ns_a").alias("src_ns"), name.alias("src"), F.col("ns_b").alias("dst_ns"), name.alias("dst"), F.lit("shared_tag").alias("relation"), F.lit("INFERRED").alias("tier"), "weight")


def vector_bridges(vectors: DataFrame, least: float = 0.7, k: int = 5) -> DataFrame:
    """Bridges between the most similar nodes of different namespaces, from (id, vec, grp)."""
    got = link.embedding_bridges(vectors, least, k)
    g = vectors.select("id", "grp")
    told = got.join(g.select(F.col("id").alias("src"), F.col("grp").alias("src_ns")), "src").join(g.select(F.col("id").alias("dst"), F.col("grp").alias("dst_ns")), "dst")
    return told.select("src_ns", "src", "dst_ns", "dst", F.lit("embedding_similar").alias("relation"), F.lit("INFERRED").alias("tier"), F.col("score").alias("weight"))


def unified_edges(nodes: DataFrame, edges: DataFrame, bridges: DataFrame, known: list[str]) -> DataFrame:
    """Edges (src, dst, relation, tier, score, weight, write_seq) of all namespaces with qualified ends, and every bridge both ways.

    An end that is no node is a stub of its edge's namespace, which is that of the edge's
    source. A bridge replaces an edge of the same ends; bridges have no score.
    """
    ns = nodes.select("id", F.col("namespace").alias("ns"))
    e = edges.join(ns.withColumnRenamed("id", "src"), "src", "left").join(ns.select(F.col("id").alias("dst"), F.col("ns").alias("dst_ns")), "dst", "left")
    home = F.coalesce("ns", F.lit(schema.HOME))
    own = e.select(
        qualify(F.col("src"), home, known).alias("src"), qualify(F.col("dst"), F.coalesce("dst_ns", home), known).alias("dst"), "relation", "tier", "score", F.coalesce("weight", F.lit(1.0)).alias("weight"), "write_seq",
    )
    b = bridges.select(qualify(F.col("src"), F.col("src_ns"), known).alias("src"), qualify(F.col("dst"), F.col("dst_ns"), known).alias("dst"), "relation", "tier", F.lit(None).cast("double").alias("score"), "weight", F.lit(None).cast("long").alias("write_seq"))
    both = b.unionByName(b.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "tier", "score", "weight", "write_seq"))
    one = both.groupBy("src", "dst").agg(F.max_by(F.struct("relation", "tier", "score", "weight", "write_seq"), F.struct("weight", "relation")).alias("v")).select("src", "dst", "v.*")
    return own.join(one.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(one)


def unified_nodes(nodes: DataFrame, known: list[str]) -> DataFrame:
    """``nodes`` with qualified ids."""
    return nodes.withColumn("id", qualify(F.col("id"), F.col("namespace"), known))


def walk(nodes: DataFrame, edges: DataFrame, root: str, budget: int = 4000, max_depth: int = 10, scope: str = "", min_score: float = 0.0, tiers: tuple[str, ...] | None = schema.TRUSTED, order: str = "bfs") -> DataFrame:
    """Budgeted traversal of the unified graph: (rank, id, depth).

    ``nodes`` and ``edges`` are qualified. With a ``scope`` only nodes whose id begins with it
    (after the namespace, or with it) are entered; the root always is.
    """
    if scope:
        inside = F.col("id").startswith(scope) | F.element_at(F.split("id", "::", 2), -1).startswith(scope) | (F.col("id") == root)
        keep = cut(nodes.filter(inside))
        ids = keep.select("id")
        edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        nodes = keep
    return traverse.budget_walk(nodes, edges, root, budget, max_depth, min_score, tiers, order)


def top_dirs(nodes: DataFrame, known: list[str], n: int = 8) -> DataFrame:
    """(namespace, dir, nodes, rank): the top-level folders of each namespace's ids with most nodes; stubs of other namespaces don't count."""
    other = F.lit(False)
    for k in known:
        other = other | (F.col("id").startswith(k + "::") & (F.col("namespace") != k))
    bare = F.when(F.col("id").startswith(F.concat("namespace", F.lit("::"))), F.expr("substring(id, length(namespace) + 3)")).otherwise(F.col("id"))
    parts = nodes.filter(~other).select("namespace", F.split(bare, "/").alias("p")).filter(F.size("p") >= 2)
    counts = parts.groupBy("namespace", F.col("p")[0].alias("dir")).agg(F.count("*").alias("nodes"))
    w = Window.partitionBy("namespace").orderBy(F.desc("nodes"), "dir")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def sample_ids(nodes: DataFrame, n: int = 3) -> DataFrame:
    """(namespace, id): the first n ids with a folder per namespace, by id."""
    w = Window.partitionBy("namespace").orderBy("id")
    return nodes.filter(F.col("id").contains("/")).select("namespace", "id").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).drop("k")
