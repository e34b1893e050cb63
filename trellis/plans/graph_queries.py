"""Registered queries over the property graph: validity, degrees, communities, traversals, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.operators import graph, rank, reach, traverse
from trellis.plans.sqlparts import GRAPH, PASS, VE, VN
from trellis.session import cut, table

ROOT = "KNOW-000001"
PPR_ROUNDS = 6


def _nodes(spark, d, *cols):
    return graph.valid_nodes(table(spark, d, "nodes"), *cols)


def _edges(spark, d):
    return graph.valid_edges(table(spark, d, "edges"))


def _both(spark, d, *cols):
    return _nodes(spark, d, *cols), _edges(spark, d)


def upsert_nodes(spark, d):
    return _nodes(spark, d, "label", "kind", "namespace", "tokens")


def upsert_edges(spark, d):
    return _edges(spark, d).select("src", "dst", "relation", "tier", "score", "write_seq")


def stub_nodes(spark, d):
    return graph.stub_nodes(*_both(spark, d, "kind"))


def node_degree(spark, d):
    return graph.degree(_edges(spark, d))


def top_hubs(spark, d):
    return graph.degree(_edges(spark, d)).orderBy(F.desc("degree"), "id").limit(10)


def relation_histogram(spark, d):
    return graph.relation_histogram(_edges(spark, d))


def undirected_collapse(spark, d):
    return graph.undirected(_edges(spark, d))


def community_stats(spark, d):
    return graph.community_stats(*_both(spark, d, "community_id"))


def god_nodes(spark, d):
    return graph.god_nodes(*_both(spark, d, "community_id", "label"))


def community_labels(spark, d):
    return graph.community_labels(graph.god_nodes(*_both(spark, d, "community_id", "label")))


def cross_community_edges(spark, d):
    return graph.cross_community(*_both(spark, d, "community_id"))


def namespace_listing(spark, d):
    return graph.namespaces(*_both(spark, d, "namespace", "kind", "tokens"))


def node_summaries(spark, d):
    return graph.summaries(*_both(spark, d, "label", "kind", "ontology_type", "tokens", "community_id"))


def explain_node(spark, d):
    return graph.explain(*_both(spark, d, "label", "kind"), ROOT)


def tier_violations(spark, d):
    """Of the written and the observed edges those whose score does not fit their tier."""
    seen = table(spark, d, "probe_state").select(F.col("source_node").alias("src"), F.col("target_node").alias("dst"), F.col("confidence_tier").alias("tier"), F.col("confidence").alias("score")).distinct()
    return graph.tier_violations(_edges(spark, d).select("src", "dst", "tier", "score").unionByName(seen))


def lifecycle_migration(spark, d):
    return graph.migrate_lifecycle(_edges(spark, d))


def edge_filter(spark, d):
    return _edges(spark, d).filter(graph.passes(0.5)).groupBy("relation", "tier").agg(F.count("*").alias("n"))


def federated_view(spark, d):
    known = ["nimbus", "code", "conv"]
    return _nodes(spark, d, "namespace", "kind").select(graph.qualify(F.col("id"), F.col("namespace"), known).alias("qualified"), "kind")


def _roots(spark, d):
    """Every live node whose last write has a number divisible by 20: a stated set of starting points."""
    n = table(spark, d, "nodes")
    return graph.valid_nodes(n.withColumn("number", F.col("seq")), "number").filter("number % 20 = 0").select(F.col("id").alias("root"))


def impact_upstream(spark, d):
    return traverse.impact(cut(_edges(spark, d)), _roots(spark, d), "upstream", 3, 0.7).select("root", "id", "depth", F.round("path_score", 6).alias("path_score"))


def impact_decay(spark, d):
    return traverse.impact(cut(_edges(spark, d)), _roots(spark, d), "downstream", 2, 0.3, how="decay").select("root", "id", "depth", F.round("path_score", 6).alias("path_score"))


def shortest_paths(spark, d):
    return reach.lengths(_edges(spark, d), _roots(spark, d), 3, 0.5)


def bfs_budget(spark, d):
    n, e = _both(spark, d, "tokens")
    return traverse.budget_walk(cut(n), cut(e), ROOT, 4000, 3)


def dfs_budget(spark, d):
    n, e = _both(spark, d, "tokens")
    return traverse.budget_walk(cut(n), cut(e), ROOT, 2000, 3, order="dfs")


def pagerank(spark, d):
    links = graph.undirected(_edges(spark, d)).filter(F.col("a") != F.col("b"))
    both = links.select("a", "b", "weight").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    seeds = spark.createDataFrame([(ROOT, 1.0)], "id string, mass double")
    return rank.pagerank(cut(both), seeds, rounds=PPR_ROUNDS).select("id", F.round("rank", 9).alias("rank"))


def communities(spark, d):
    return rank.communities(_edges(spark, d), rounds=6)


QUERIES = {
    f.__name__: f
    for f in (
        upsert_nodes, upsert_edges, stub_nodes, node_degree, top_hubs, relation_histogram, undirected_collapse, community_stats, god_nodes, community_labels, cross_community_edges, namespace_listing,
        node_summaries, explain_node, tier_violations, lifecycle_migration, edge_filter, federated_view, impact_upstream, impact_decay, shortest_paths, bfs_budget, dfs_budget, pagerank, communities,
    )
}

_DEG = "dg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM ve UNION ALL SELECT dst FROM ve) GROUP BY id)"
_CE = "ce AS (SELECT e.*, a.community_id AS src_c, b.community_id AS dst_c FROM ve e LEFT JOIN vn a ON e.src = a.id LEFT JOIN vn b ON e.dst = b.id)"
_GODS = f"""{_CE},
cd AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM ce WHERE src_c = dst_c UNION ALL SELECT dst FROM ce WHERE src_c = dst_c) GROUP BY id),
gods AS (SELECT * FROM (SELECT n.community_id, n.id, n.label, coalesce(c.degree, 0) AS degree,
  CAST(row_number() OVER (PARTITION BY n.community_id ORDER BY coalesce(c.degree, 0) DESC, n.id) AS INTEGER) AS rank
  FROM vn n LEFT JOIN cd c ON n.id = c.id WHERE n.community_id IS NOT NULL) WHERE rank <= 5)"""
_ROOTS = "roots AS (SELECT id AS root FROM vn WHERE seq % 20 = 0)"


def _impact(direction: str, depth: int, least: float, how: str) -> str:
    at, to = ("dst", "src") if direction == "upstream" else ("src", "dst")
    step = "least(f.s, coalesce(e.score, 1.0))" if how == "weakest" else "f.s * CASE coalesce(e.tier, 'EXTRACTED') WHEN 'INFERRED' THEN 0.6 WHEN 'AMBIGUOUS' THEN 0.2 ELSE 1.0 END"
    parts, seen = ["l0 AS (SELECT root, root AS id, 0 AS depth, 1.0::DOUBLE AS s FROM roots)"], "SELECT root, id FROM l0"
    for i in range(1, depth + 1):
        parts.append(
            f"l{i} AS (SELECT f.root, e.{to} AS id, {i} AS depth, max({step}) AS s FROM l{i - 1} f JOIN ve e ON e.{at} = f.id WHERE {PASS.format(least=least)} "
            f"AND NOT EXISTS (SELECT 1 FROM ({seen}) v WHERE v.root = f.root AND v.id = e.{to}) GROUP BY 1, 2)"
        )
        seen += f" UNION ALL SELECT root, id FROM l{i}"
    all_ = " UNION ALL ".join(f"SELECT root, id, depth, round(s, 6) AS path_score FROM l{i}" for i in range(1, depth + 1))
    return f"{GRAPH}, {_ROOTS}, {', '.join(parts)} {all_}"


def _distances(depth: int, least: float) -> str:
    parts, seen = ["l0 AS (SELECT root, root AS id FROM roots)"], "SELECT root, id FROM l0"
    both = f"bo AS (SELECT src AS a, dst AS b FROM ve WHERE coalesce(score, 1.0) >= {least} UNION SELECT dst, src FROM ve WHERE coalesce(score, 1.0) >= {least})"
    for i in range(1, depth + 1):
        parts.append(f"l{i} AS (SELECT DISTINCT f.root, e.b AS id FROM l{i - 1} f JOIN bo e ON e.a = f.id WHERE NOT EXISTS (SELECT 1 FROM ({seen}) v WHERE v.root = f.root AND v.id = e.b))")
        seen += f" UNION ALL SELECT root, id FROM l{i}"
    all_ = " UNION ALL ".join(f"SELECT root, id, {i} AS length FROM l{i}" for i in range(depth + 1))
    return f"{GRAPH}, {_ROOTS}, {both}, {', '.join(parts)} {all_}"


def _pagerank(rounds: int) -> str:
    parts = [
        "un AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(coalesce(weight, 1.0)) AS w FROM ve WHERE src <> dst GROUP BY 1, 2)",
        "bo AS (SELECT a, b, w FROM un UNION ALL SELECT b, a, w FROM un)",
        "tot AS (SELECT a, sum(w) AS t FROM bo GROUP BY a)",
        "st AS (SELECT bo.a, b, w / t AS p FROM bo JOIN tot ON bo.a = tot.a)",
        f"ids AS (SELECT a AS id, CASE WHEN a = '{ROOT}' THEN 1.0 ELSE 0.0 END AS home, 1.0 / (SELECT count(*) FROM tot) AS r FROM tot)",
        "r0 AS (SELECT id, r FROM ids)",
    ]
    for i in range(1, rounds + 1):
        parts.append(f"r{i} AS (SELECT ids.id, 0.7 * coalesce(f.x, 0) + 0.3 * home AS r FROM ids LEFT JOIN (SELECT st.b AS id, sum(r * p) AS x FROM r{i - 1} q JOIN st ON q.id = st.a GROUP BY st.b) f ON ids.id = f.id)")
    return f"WITH {VE}, {', '.join(parts)} SELECT id, round(r, 9) AS rank FROM r{rounds}"


SQL = {
    "upsert_nodes": f"WITH {VN} SELECT id, label, kind, namespace, tokens FROM vn",
    "upsert_edges": f"WITH {VE} SELECT src, dst, relation, tier, score, write_seq FROM ve",
    "stub_nodes": f"""{GRAPH} SELECT id, regexp_extract(id, '([^:]|:[^:])*$') AS x, CASE WHEN instr(id, '::') > 0 THEN split_part(id, '::', 1) ELSE 'nimbus' END AS namespace
FROM (SELECT src AS id FROM ve UNION SELECT dst FROM ve) WHERE id NOT IN (SELECT id FROM vn)""".replace("regexp_extract(id, '([^:]|:[^:])*$') AS x", "list_last(string_split(id, '::')) AS label"),
    "node_degree": f"WITH {VE}, {_DEG} SELECT id, degree FROM dg",
    "top_hubs": f"WITH {VE}, {_DEG} SELECT id, degree FROM dg ORDER BY degree DESC, id LIMIT 10",
    "relation_histogram": f"WITH {VE} SELECT relation, count(*) AS n FROM ve GROUP BY relation",
    "undirected_collapse": f"WITH {VE} SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(coalesce(weight, 1.0)) AS weight FROM ve GROUP BY 1, 2",
    "community_stats": f"""{GRAPH}, {_CE}, m AS (SELECT community_id, count(*) AS members FROM vn WHERE community_id IS NOT NULL GROUP BY 1),
i AS (SELECT src_c AS c, count(*) AS n FROM ce WHERE src_c = dst_c GROUP BY 1),
b AS (SELECT c, count(*) AS n FROM (SELECT src_c AS c FROM ce WHERE src_c IS DISTINCT FROM dst_c UNION ALL SELECT dst_c FROM ce WHERE src_c IS DISTINCT FROM dst_c) GROUP BY 1)
SELECT community_id, members, coalesce(i.n, 0) AS internal, coalesce(b.n, 0) AS bridges, CASE WHEN members < 2 THEN 0.0 ELSE round(coalesce(i.n, 0) / (members * (members - 1)), 4) END AS density
FROM m LEFT JOIN i ON i.c = community_id LEFT JOIN b ON b.c = community_id""",
    "god_nodes": f"{GRAPH}, {_GODS} SELECT community_id, id, label, degree, rank FROM gods",
    "community_labels": f"{GRAPH}, {_GODS} SELECT community_id, string_agg(label, ' · ' ORDER BY rank) AS label FROM gods WHERE rank <= 3 GROUP BY community_id",
    "cross_community_edges": f"{GRAPH}, {_CE} SELECT src, dst, src_c, dst_c, relation, score FROM ce WHERE src_c <> dst_c AND score >= 0.7 ORDER BY score DESC, src, dst LIMIT 20",
    "namespace_listing": f"""{GRAPH}, c AS (SELECT a.namespace, count(*) AS edges, count(CASE WHEN a.namespace <> b.namespace THEN 1 END) AS crossing FROM ve e JOIN vn a ON e.src = a.id JOIN vn b ON e.dst = b.id GROUP BY 1)
SELECT n.namespace, count(*) AS nodes, count(DISTINCT kind) AS kinds, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens, coalesce(any_value(edges), 0) AS edges, coalesce(any_value(crossing), 0) AS crossing
FROM vn n LEFT JOIN c ON n.namespace = c.namespace GROUP BY n.namespace""",
    "node_summaries": f"{GRAPH}, {_DEG} SELECT vn.id, label, kind, ontology_type, tokens, community_id, coalesce(degree, 0) AS degree FROM vn LEFT JOIN dg ON vn.id = dg.id",
    "explain_node": f"""{GRAPH}, x AS (SELECT 'out' AS direction, dst AS other, relation, tier, score FROM ve WHERE src = '{ROOT}' UNION ALL SELECT 'in', src, relation, tier, score FROM ve WHERE dst = '{ROOT}')
SELECT direction, other, coalesce(label, other) AS label, kind, relation, x.tier, x.score FROM x LEFT JOIN vn ON other = id""",
    "tier_violations": f"""WITH {VE}, al AS (SELECT src, dst, tier, score FROM ve UNION ALL SELECT DISTINCT source_node, target_node, confidence_tier, confidence FROM probe_state) SELECT src, dst, tier, score FROM al WHERE score IS NOT NULL AND NOT coalesce((tier = 'EXTRACTED' AND score BETWEEN 0.95 AND 1.0)
OR (tier = 'INFERRED' AND score BETWEEN 0.30 AND 0.94) OR (tier = 'AMBIGUOUS' AND score BETWEEN 0.0 AND 0.29), false)""",
    "lifecycle_migration": f"""WITH {VE} SELECT src, dst, CASE WHEN source_pass IN ('ast', 'code') THEN 'deterministic' WHEN source_pass = 'conv' THEN 'anchored' ELSE lifecycle END AS lifecycle,
NOT coalesce(source_pass IN ('ast', 'code', 'conv'), false) AS blocked FROM ve""",
    "edge_filter": f"WITH {VE} SELECT relation, tier, count(*) AS n FROM ve WHERE {PASS.format(least=0.5)} GROUP BY ALL",
    "federated_view": f"""WITH {VN} SELECT CASE WHEN starts_with(id, 'nimbus::') OR starts_with(id, 'code::') OR starts_with(id, 'conv::') THEN id ELSE concat_ws('::', namespace, id) END AS qualified, kind FROM vn""",
    "impact_upstream": _impact("upstream", 3, 0.7, "weakest"),
    "impact_decay": _impact("downstream", 2, 0.3, "decay"),
    "shortest_paths": _distances(3, 0.5),
    "pagerank": _pagerank(PPR_ROUNDS),
}
