"""Registered queries of code graphs, atomizing, reports and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.operators import atomize, code, embed, graph, levels, records, report
from trellis.plans.sqlparts import GRAPH, VN
from trellis.session import cut, table

NOW = "2026-01-01 00:00:00"


def _nodes(spark, d, *cols):
    return graph.valid_nodes(table(spark, d, "nodes"), *cols)


def _files(spark, d):
    return records.last_files(table(spark, d, "files"))


def code_definitions(spark, d):
    defs, _ = code.parse_files(_files(spark, d))
    return defs.select("id", "parent", "kind", "label", "signature", "is_async", "line_start", "line_end")


def code_edges(spark, d):
    _, edges = code.graph_of(_files(spark, d))
    return edges.drop("pos")


def atomize_scan(spark, d):
    return atomize.scan(_files(spark, d).filter(F.col("path").endswith(".md")), NOW).select("doc_path", "doc_sha", "section", "title", "start_line", "lines")


def community_prompts(spark, d):
    return report.community_prompts(_nodes(spark, d, "community_id", "content")).select("community_id", "members", F.length("prompt").alias("chars"))


def view_links(spark, d):
    n, e = _nodes(spark, d, "label", "kind", "community_id"), graph.valid_edges(table(spark, d, "edges"))
    return report.view_records(n, e, 2)[1]


def pending_embeddings(spark, d):
    return embed.pending(_nodes(spark, d, "kind", "content", "content_hash"), table(spark, d, "embed_cache")).select("id", "content_hash")


def entity_groups(spark, d):
    """Neighbouring chunks of a source grouped by the capitalised names they share."""
    c = table(spark, d, "chunks").filter("text IS NOT NULL").select("source_idx", F.col("chunk_id").cast("int").alias("idx"), "text").distinct()
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]{6,}"), F.lit(0)))
    return levels.entity_groups(c.select("source_idx", "idx", names.alias("entities")))


QUERIES = {f.__name__: f for f in (code_definitions, code_edges, atomize_scan, community_prompts, view_links, pending_embeddings, entity_groups)}

SQL = {
    "community_prompts": f"""WITH {VN}, l AS (SELECT community_id, id, '- ' || id || ': ' || substr(coalesce(content, ''), 1, 500) AS line FROM vn WHERE community_id IS NOT NULL),
u AS (SELECT *, sum(length(line)) OVER (PARTITION BY community_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS used FROM l),
s AS (SELECT community_id, CAST(count(*) AS INTEGER) AS members FROM l GROUP BY 1 HAVING count(*) >= 3),
f AS (SELECT community_id, count(*) AS n, sum(length(line)) + count(*) - 1 AS c FROM u WHERE used <= 12000 GROUP BY 1)
SELECT s.community_id, members, CAST(c + CASE WHEN members > n THEN length(chr(10) || '… ' || (members - n) || ' more') ELSE 0 END AS INTEGER) AS chars FROM s JOIN f ON s.community_id = f.community_id""",
    "view_links": f"""{GRAPH}, d AS (SELECT id, count(*) AS k FROM (SELECT src AS id FROM ve UNION ALL SELECT dst FROM ve) GROUP BY id), n AS (SELECT vn.id FROM vn JOIN d ON vn.id = d.id WHERE k >= 2)
SELECT src, dst, relation, greatest(0.5, 1.5 * coalesce(weight, 1.0)) AS width FROM ve WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""",
    "pending_embeddings": f"""WITH {VN}, c AS (SELECT node_id, sha FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY append_seq DESC) AS k FROM embed_cache WHERE node_id IS NOT NULL) WHERE k = 1)
SELECT id, content_hash FROM vn WHERE kind IN ('note', 'knowledge', 'image', 'pdf', 'audio', 'function', 'class', 'module') AND trim(content) <> '' AND NOT EXISTS (SELECT 1 FROM c WHERE c.node_id = vn.id AND c.sha = vn.content_hash)""",
}
