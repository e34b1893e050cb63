"""The property graph as two tables: what is valid of nodes and edges, and what can be counted on them.

Last writes win: by id for nodes, by (source, target) for edges. All of it is
declarative; hot nodes are combined on the map side before a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis import schema
from trellis.operators.orphans import strip_ws


def valid_nodes(nodes: DataFrame, *columns: str) -> DataFrame:
    """The last row per id (by seq) unless it removes the node; null ids are left out."""
    cols = [c for c in (columns or nodes.columns) if c not in ("id", "seq", "removed_at")]
    state = F.struct(F.col("removed_at").isNotNull().alias("gone"), *cols)
    last = nodes.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(state, F.col("seq")).alias("v"))
    return last.filter(~F.col("v.gone")).select("id", *[F.col(f"v.{c}").alias(c) for c in cols])


def valid_edges(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst), the last write; outer white space trimmed, relations in lower case, blank ends left out."""
    e = edges.select(strip_ws(F.col("src")).alias("src"), strip_ws(F.col("dst")).alias("dst"), F.lower(strip_ws(F.col("relation"))).alias("relation"), "tier", "score", "weight", "source_pass", "lifecycle", "write_seq")
    e = e.filter((F.col("src") != "") & (F.col("dst") != ""))
    rest = ("relation", "tier", "score", "weight", "source_pass", "lifecycle", "write_seq")
    return e.groupBy("src", "dst").agg(F.max_by(F.struct(*rest), "write_seq").alias("v")).select("src", "dst", *[F.col(f"v.{c}").alias(c) for c in rest])


def passes(min_score: float = 0.0, tiers: tuple[str, ...] | None = schema.TRUSTED) -> Column:
    """The edge filter of traversals: a missing score counts as 1, a missing tier as EXTRACTED."""
    ok = F.coalesce("score", F.lit(1.0)) >= min_score
    return ok if tiers is None else ok & F.coalesce("tier", F.lit("EXTRACTED")).isin(*tiers)


def both_ways(edges: DataFrame, *extra: str) -> DataFrame:
    """Each edge from either end: (a, b, extra...)."""
    there = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), *extra)
    return there.unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), *extra))


def stub_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that edges need but nobody wrote: (id, label, namespace)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    missing = ends.join(nodes.select("id"), "id", "left_anti")
    first = F.when(F.instr("id", "::") > 0, F.substring_index("id", "::", 1)).otherwise(schema.HOME)
    return missing.select("id", F.substring_index("id", "::", -1).alias("label"), first.alias("namespace"))


def degree(edges: DataFrame) -> DataFrame:
    """In- plus out-degree; a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def undirected(edges: DataFrame) -> DataFrame:
    """Pairs without direction and their largest weight (missing counts as 1)."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"))


def with_communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the communities of both ends (null where an end has none)."""
    c = nodes.select("id", "community_id")
    return edges.join(c.select(F.col("id").alias("src"), F.col("community_id").alias("src_c")), "src", "left").join(
        c.select(F.col("id").alias("dst"), F.col("community_id").alias("dst_c")), "dst", "left"
    )


def community_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(community_id, members, internal, bridges, density): density is internal / n(n-1), 4 places, 0 below two members."""
    size = nodes.filter(F.col("community_id").isNotNull()).groupBy("community_id").agg(F.count("*").alias("members"))
    e = with_communities(nodes, edges)
    same = F.col("src_c") == F.col("dst_c")
    ends = e.select(F.explode(F.array_distinct(F.array("src_c", "dst_c"))).alias("community_id"), F.coalesce(same, F.lit(False)).alias("same")).filter(F.col("community_id").isNotNull())
    counts = ends.groupBy("community_id").agg(F.sum(F.col("same").cast("long")).alias("internal"), F.sum((~F.col("same")).cast("long")).alias("bridges"))
    n = F.col("members")
    zero = F.lit(0).cast("long")
    return size.join(counts, "community_id", "left").select(
        "community_id", "members", F.coalesce("internal", zero).alias("internal"), F.coalesce("bridges", zero).alias("bridges"),
        F.when(n < 2, 0.0).otherwise(F.round(F.coalesce("internal", zero) / (n * (n - 1)), 4)).alias("density"),
    )


def god_nodes(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """The k members of each community with the highest degree inside of it; ties by id."""
    inside = with_communities(nodes, edges).filter(F.col("src_c") == F.col("dst_c"))
    d = degree(inside)
    m = nodes.filter(F.col("community_id").isNotNull()).select("community_id", "id", "label").join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    w = Window.partitionBy("community_id").orderBy(F.desc("degree"), "id")
    return m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("community_id", "id", "label", "degree", "rank")


def community_labels(gods: DataFrame, n: int = 3) -> DataFrame:
    """The labels of the first n god nodes, joined."""
    top = gods.filter(F.col("rank") <= n).groupBy("community_id").agg(F.sort_array(F.collect_list(F.struct("rank", "label"))).alias("t"))
    return top.select("community_id", F.array_join(F.transform("t", lambda x: x["label"]), " · ").alias("label"))


def cross_community(nodes: DataFrame, edges: DataFrame, least: float = 0.7, limit: int = 20) -> DataFrame:
    """The strongest edges between communities."""
    e = with_communities(nodes, edges).filter((F.col("src_c") != F.col("dst_c")) & (F.col("score") >= least))
    return e.orderBy(F.desc("score"), "src", "dst").limit(limit).select("src", "dst", "src_c", "dst_c", "relation", "score")


def relation_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("n"))


def tier_violations(edges: DataFrame) -> DataFrame:
    """Edges whose score lies outside of the range of their tier, or whose tier is unknown; a null score breaks nothing."""
    ok = F.lit(False)
    for tier, (lo, hi) in schema.TIER_RANGE.items():
        ok = ok | ((F.col("tier") == tier) & F.col("score").between(lo, hi))
    return edges.filter(F.col("score").isNotNull() & ~F.coalesce(ok, F.lit(False)))


def migrate_lifecycle(edges: DataFrame) -> DataFrame:
    """(src, dst, lifecycle, blocked): parsed edges become deterministic, those of conversations anchored, others block."""
    p = F.col("source_pass")
    new = F.when(p.isin("ast", "code"), "deterministic").when(p == "conv", "anchored")
    return edges.select("src", "dst", F.coalesce(new, F.col("lifecycle")).alias("lifecycle"), new.isNull().alias("blocked"))


def migrate_all(edges: DataFrame) -> DataFrame:
    """``edges`` with the lifecycles of ``migrate_lifecycle``, or as they are if a single one is blocked: all or nothing."""
    p = F.col("source_pass")
    new = F.when(p.isin("ast", "code"), "deterministic").when(p == "conv", "anchored")
    blocked = edges.agg(F.coalesce(F.max(new.isNull()), F.lit(False)).alias("_blocked"))
    return edges.crossJoin(F.broadcast(blocked)).withColumn("lifecycle", F.when(F.col("_blocked"), F.col("lifecycle")).otherwise(new)).drop("_blocked")  # blocked is one row


def explain(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """The edges of one node with the labels of the other ends."""
    out = edges.filter(F.col("src") == node_id).select(F.lit("out").alias("direction"), F.col("dst").alias("other"), "relation", "tier", "score")
    into = edges.filter(F.col("dst") == node_id).select(F.lit("in").alias("direction"), F.col("src").alias("other"), "relation", "tier", "score")
    names = nodes.select(F.col("id").alias("other"), "label", "kind")
    return out.unionByName(into).join(names, "other", "left").select("direction", "other", F.coalesce("label", "other").alias("label"), "kind", "relation", "tier", "score")


def summaries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One line per node: id, label, kind, ontology type, tokens, community, degree."""
    return nodes.join(degree(edges), "id", "left").select("id", "label", "kind", "ontology_type", "tokens", "community_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def namespaces(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, kinds and leaving edges per namespace, and edges that lead into another one."""
    ns = nodes.select("id", "namespace")
    n = nodes.groupBy("namespace").agg(F.count("*").alias("nodes"), F.countDistinct("kind").alias("kinds"), F.sum(F.coalesce("tokens", F.lit(0)).cast("long")).alias("tokens"))
    e = edges.join(ns.select(F.col("id").alias("src"), F.col("namespace").alias("namespace")), "src").join(ns.select(F.col("id").alias("dst"), F.col("namespace").alias("other")), "dst")
    c = e.groupBy("namespace").agg(F.count("*").alias("edges"), F.sum((F.col("namespace") != F.col("other")).cast("long")).alias("crossing"))
    z = F.lit(0).cast("long")
    return n.join(c, "namespace", "left").select("namespace", "nodes", "kinds", "tokens", F.coalesce("edges", z).alias("edges"), F.coalesce("crossing", z).alias("crossing"))


def qualify(node_id: Column, namespace: Column, known: list[str]) -> Column:
    """``ns::id`` unless the id starts with a known namespace already."""
    has = F.lit(False)
    for k in known:
        has = has | node_id.startswith(k + "::")
    return F.when(has, node_id).otherwise(F.concat_ws("::", namespace, node_id))
