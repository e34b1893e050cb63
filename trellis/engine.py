"""The engine over saved graphs: one object, a method per tool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis import schema
from trellis.operators import graph, link, probe, rank, report, retrieve, traverse
from trellis.sources import state


class Engine:
    """Nodes (id, label, kind, namespace, content, tokens, ...) and edges (src, dst, relation, tier, score, weight, ...)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, vectors: DataFrame | None = None):
        self.nodes, self.edges, self.vectors = nodes, edges, vectors

    @classmethod
    def open(cls, spark: SparkSession, store: str, version: int | None = None) -> Engine:
        return cls(*state.load_graph(spark, store, version))

    @classmethod
    def of_tables(cls, nodes: DataFrame, edges: DataFrame) -> Engine:
        """From tables of written versions."""
        return cls(graph.valid_nodes(nodes), graph.valid_edges(edges))

    def search(self, query: str, vector: list[float] | None = None, top_k: int = 10, namespace: str | None = None, budget: int = 4000, min_score: float = 0.0) -> DataFrame:
        """Hits and what is next to them, as many as fit into a token budget, hits first.

        A knowledge id is looked up instead of searched.
        """
        q = query.strip()
        if q.upper().startswith("KNOW-") and q[5:].isdigit():
            hits = self.nodes.filter(F.col("id") == q.upper()).select("id")
        else:
            found = retrieve.hybrid(self.nodes, self.vectors if self.vectors is not None else self.nodes.limit(0).select("id"), q.split(), vector if self.vectors is not None else None, top_k, namespace)
            entry = retrieve.entry_points(self.nodes, q).select("id")
            hits = found.select("id").union(entry).distinct()
        wide = retrieve.expand(hits, self.nodes, self.edges, min_score)
        from pyspark.sql import Window

        order = Window.orderBy(F.col("via").isNotNull(), "id").rowsBetween(Window.unboundedPreceding, 0)
        used = wide.withColumn("used", F.sum(F.coalesce("tokens", F.lit(0))).over(order))  # hits and their neighbours only
        return used.filter(F.col("used") <= F.greatest(F.lit(budget), F.coalesce("tokens", F.lit(0)))).drop("used")

    def walk(self, root: str, budget: int = 4000, depth: int = 10, order: str = "bfs", min_score: float = 0.0) -> DataFrame:
        return traverse.budget_walk(self.nodes, self.edges, root, budget, depth, min_score, order=order)

    def impact(self, target: str, direction: str = "upstream", depth: int = 3, min_score: float = 0.7, kinds: tuple[str, ...] | None = None, how: str = "weakest") -> DataFrame:
        start = self.nodes.sparkSession.createDataFrame([(target,)], "root string")
        hit = traverse.impact(self.edges, start, direction, depth, min_score, kinds=kinds, how=how)
        word = F.when(F.col("depth") == 1, "DIRECTLY").when(F.col("depth") == 2, "LIKELY").otherwise("MAY BE")
        return hit.withColumn("affected", word).orderBy("depth", F.desc("path_score"), "id")

    def trace(self, a: str, b: str, max_length: int = 5, min_score: float = 0.0) -> list[str] | None:
        start = self.nodes.sparkSession.createDataFrame([(a,)], "root string")
        return traverse.path_to(traverse.distances(self.edges, start, max_length, min_score), a, b)

    def explain(self, node_id: str) -> DataFrame:
        return graph.explain(self.nodes, self.edges, node_id)

    def entries(self, query: str) -> DataFrame:
        return retrieve.entry_points(self.nodes, query, per_namespace=True)

    def communities(self, refresh: bool = False) -> DataFrame:
        """Statistics of the communities; ``refresh`` finds them anew."""
        if refresh:
            self.nodes = self.nodes.drop("community_id").join(rank.communities(self.edges).withColumnRenamed("community", "community_id"), "id", "left")
        return graph.community_stats(self.nodes, self.edges)

    def namespaces(self) -> DataFrame:
        return graph.namespaces(self.nodes, self.edges)

    def info(self) -> DataFrame:
        return graph.relation_histogram(self.edges).orderBy(F.desc("n"), "relation")

    def drift(self) -> DataFrame:
        return link.drift(self.nodes, self.edges)

    def knowledge(self, ontology_type: str | None = None, limit: int = 20) -> DataFrame:
        """Knowledge nodes with the first fifty characters of their texts."""
        k = self.nodes.filter("kind = 'knowledge'")
        if ontology_type:
            k = k.filter(F.col("ontology_type") == ontology_type)
        return k.select("id", "label", F.substring("content", 1, 50).alias("preview")).orderBy("id").limit(limit)

    def similar(self, least: float = 0.65, k: int = 10) -> DataFrame:
        return link.similarity_edges(self.vectors, self.edges, least, k)

    def routes(self, state_table: DataFrame, model: str = "default") -> DataFrame:
        return probe.route(state_table, probe.PROFILES.get(model, probe.PROFILES["default"]))

    def report(self) -> str:
        return report.graph_report(self.nodes, self.edges)

    def federated(self, other: Engine, names: tuple[str, str] = (schema.HOME, "code")) -> Engine:
        from trellis.plans.ingest import unified

        return Engine(*unified({names[0]: (self.nodes, self.edges), names[1]: (other.nodes, other.edges)}))
