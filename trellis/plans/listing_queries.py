"""Registered queries of federation, the inbox, and listings, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.functions.clock import iso_micros
from trellis.operators import code, federation, graph, inbox, levels, link, listing, metrics, probe, records
from trellis.plans.retrieval_queries import _FILES, _ROUTE
from trellis.plans.sqlparts import CHUNK, GRAPH, VE, VN, VV, words
from trellis.session import cut, table

KNOWN = ["code", "conv", "nimbus"]
SCAN, MODEL = "2026-01-02T00:00:00+00:00", "vec-small-2"
AT = "2026-01-01T00:00:00+00:00"
PART = "report"


def _nodes(spark, d, *cols):
    return graph.valid_nodes(table(spark, d, "nodes"), *cols)


def _edges(spark, d):
    return graph.valid_edges(table(spark, d, "edges"))


def _state(spark, d):
    return table(spark, d, "probe_state").filter("edge_id IS NOT NULL").distinct()


def _routed(spark, d):
    return probe.route(records.distinct_probe(table(spark, d, "probe_state")), probe.PROFILES["bge-m3"])


def _inbox(spark, d):
    return inbox.entries(_routed(spark, d), _state(spark, d), AT)


def federated_edges(spark, d):
    n = cut(_nodes(spark, d, "namespace", "kind", "tags"))
    return federation.unified_edges(n, _edges(spark, d), federation.tag_bridges(n), KNOWN).select("src", "dst", "relation", "tier", "weight")


def _unified(spark, d):
    n = cut(_nodes(spark, d, "namespace", "kind", "tags", "tokens"))
    e = cut(federation.unified_edges(n, _edges(spark, d), federation.tag_bridges(n), KNOWN))
    return cut(federation.unified_nodes(n, KNOWN).select("id", "namespace", "tokens")), e


def federated_bfs(spark, d):
    n, e = _unified(spark, d)
    return federation.walk(n, e, "nimbus::KNOW-000001", 4000, 3)


def federated_dfs(spark, d):
    n, e = _unified(spark, d)
    return federation.walk(n, e, "nimbus::KNOW-000001", 2000, 3, order="dfs")


def namespace_dirs(spark, d):
    return federation.top_dirs(_nodes(spark, d, "namespace"), KNOWN)


def namespace_samples(spark, d):
    return federation.sample_ids(_nodes(spark, d, "namespace"))


def inbox_entries(spark, d):
    return _inbox(spark, d).select("id", "source", "target", "confidence", "top_k_rank", "status", F.size("probe_signals").alias("signals"), inbox.longest_seen().alias("longest"))


def inbox_by_confidence(spark, d):
    return inbox.pending(_inbox(spark, d), 10, "confidence").select("id", "confidence")


def inbox_by_seen(spark, d):
    return inbox.pending(_inbox(spark, d), 10, "consecutive_seen").select("id", inbox.longest_seen().alias("longest"))


def promoted_edges(spark, d):
    return inbox.promoted_edges(_routed(spark, d), _state(spark, d))


def anchored_state(spark, d):
    return inbox.anchor(_state(spark, d), _routed(spark, d)).groupBy("lifecycle_class").agg(F.count("*").alias("n"))


def _decisions(box):
    """Entries with an even rank are approved, the others rejected: a stated set of decisions."""
    status = F.when(F.col("top_k_rank") % 2 == 0, "approved").otherwise("rejected")
    return box.select("id", status.alias("status"), F.lit(AT).alias("decided_at"), F.lit("reviewer").alias("decided_by"))


def approved_edges(spark, d):
    box = cut(_inbox(spark, d))
    return inbox.approve(box, _decisions(box))[1].select("src", "dst", "score", "lifecycle")


def decided_inbox(spark, d):
    box = cut(_inbox(spark, d))
    return inbox.approve(box, _decisions(box))[0].select("id", "status", "decided_by")


def route_counters(spark, d):
    """A later routing, in which the scores of all edges are a tenth lower, on the inbox of the first."""
    box = cut(_inbox(spark, d))
    lower = records.distinct_probe(table(spark, d, "probe_state")).withColumn("confidence", F.col("confidence") * 0.9)
    return inbox.counters(probe.route(lower, probe.PROFILES["bge-m3"]), box)


def probe_record(spark, d):
    """The observed state after a scan that sees all edges that are not deterministic, and one new edge of each source."""
    state = cut(_state(spark, d))
    seen = state.filter("lifecycle_class <> 'deterministic'").select(
        F.substring_index("source_node", "::", 1).alias("src_ns"), inbox.bare(F.col("source_node")).alias("src"), F.substring_index("target_node", "::", 1).alias("dst_ns"), inbox.bare(F.col("target_node")).alias("dst"),
        F.col("edge_kind").alias("relation"), F.lit("EXTRACTED").alias("tier"), F.lit(0.8).alias("weight"), "source_file",
    )
    new = seen.select("src_ns", "src", F.lit("nimbus").alias("dst_ns"), F.lit("new-note").alias("dst"), F.lit("bridge").alias("relation"), F.lit("odd").alias("tier"), F.lit(0.6).alias("weight"), F.lit("x").alias("source_file")).distinct()
    got = probe.record(state, seen.unionByName(new), SCAN, MODEL, SCAN)
    return got.select("edge_id", "confidence_tier", "confidence", "last_seen_parsed_at", "consecutive_seen", "model_id", "lifecycle_class")


def trusted_cross_edges(spark, d):
    s = table(spark, d, "probe_state").filter("edge_id IS NOT NULL")
    return s.filter((F.coalesce("confidence", F.lit(0.0)) >= 0.7) & F.col("confidence_tier").isin("INFERRED")).select("edge_id", "confidence").distinct()


def cross_edges_of_node(spark, d):
    s = table(spark, d, "probe_state").filter("edge_id IS NOT NULL")
    return s.filter(F.col("source_node").contains("KNOW-00001") | F.col("target_node").contains("KNOW-00001")).select("edge_id", "source_node", "target_node").distinct()


def cross_edges_by_month(spark, d):
    s = table(spark, d, "probe_state").filter("edge_id IS NOT NULL").select("edge_id", iso_micros(F.col("first_seen_at"), True).alias("us")).distinct()
    return s.groupBy(F.floor(F.col("us") / 86400000000).alias("day")).agg(F.count("*").alias("n"))


def community_detail(spark, d):
    return listing.community_detail(_nodes(spark, d, "community_id", "label", "kind", "ontology_type"), _edges(spark, d), PART)


def community_of_type(spark, d):
    return listing.community_detail(_nodes(spark, d, "community_id", "label", "kind", "ontology_type"), _edges(spark, d), "a", "fact")


def mention_targets(spark, d):
    return listing.mention_targets(_nodes(spark, d, "namespace", "label", "kind", "metadata"), _edges(spark, d))


def community_legend(spark, d):
    return listing.legend(_nodes(spark, d, "label", "kind", "community_id"), _edges(spark, d))


def search_filenames(spark, d):
    return listing.file_names(records.last_files(table(spark, d, "files")), "edges")


def batches_applied(spark, d):
    """Which batches have all of their titles among those of the accepted history."""
    c = table(spark, d, "chunks").select("batch_no", "title")
    return listing.covered(c.filter("batch_no > 0"), c.filter("batch_no = 0"), "batch_no", "title")


def file_links(spark, d):
    f = records.last_files(table(spark, d, "files"))
    return f.select("path", listing.quoted(F.concat(F.lit("notes of "), "path", F.lit(" (1+1)*~"))).alias("link"))


def edge_passes(spark, d):
    e = _edges(spark, d)
    return e.groupBy(listing.source_pass(F.col("relation"), F.col("tier")).alias("pass"), "relation").agg(F.count("*").alias("n"))


def vault_tree(spark, d):
    return listing.vault_tree(_nodes(spark, d, "namespace", "kind"), "nimbus", "notes")


def entry_with_extension(spark, d):
    return listing.entries(_nodes(spark, d, "label", "aliases", "namespace"), "report.md", "", KNOWN)


def entry_in_namespace(spark, d):
    return listing.entries(_nodes(spark, d, "label", "aliases", "namespace"), "nimbus::report", "", KNOWN)


def migration_or_nothing(spark, d):
    return graph.migrate_all(_edges(spark, d)).groupBy("lifecycle").agg(F.count("*").alias("n"))


def migration_of_parsed(spark, d):
    return graph.migrate_all(_edges(spark, d).filter("source_pass IN ('ast', 'code', 'conv')")).groupBy("lifecycle").agg(F.count("*").alias("n"))


def entry_scores(spark, d):
    """How much each function of the graph looks like an entry point, by the calls of the graph."""
    defs = _nodes(spark, d, "namespace", "kind", "label").filter("namespace = 'code'").withColumn("label", F.trim("label"))
    calls = _edges(spark, d).filter("relation = 'calls'").select("src", "dst", "write_seq")
    return code.entry_scores(defs, calls)


def graph_flows(spark, d):
    """Flows over the calls of the graph, in the order in which they were written."""
    defs = cut(_nodes(spark, d, "namespace", "kind", "label").filter("namespace = 'code'").withColumn("label", F.trim("label")))
    calls = cut(_edges(spark, d).filter("relation = 'calls'").select("src", "dst", F.col("write_seq").alias("pos")))
    return code.flows(defs, calls, least=0.4, min_steps=2)


def context_sufficiency(spark, d):
    c = cut(table(spark, d, "chunks").select("chunk_id", "source_idx", "idx", "text", "title").filter("text IS NOT NULL").distinct())
    return metrics.context_sufficiency(levels.keyword_hits(table(spark, d, "qa"), c, 5))


def exact_neighbours(spark, d):
    v = cut(records.last_vectors(table(spark, d, "embed_cache")).select(F.col("node_id").alias("id"), "vec"))
    return link.similar_pairs(v, 0.9).select("a", "b", F.round("score", 6).alias("score"))


def embeddable_kinds(spark, d):
    n = _nodes(spark, d, "kind", "content", "metadata")
    return records.embeddable(n).groupBy("kind").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        federated_edges, federated_bfs, federated_dfs, namespace_dirs, namespace_samples, inbox_entries, inbox_by_confidence, inbox_by_seen, promoted_edges, anchored_state, approved_edges, decided_inbox, route_counters,
        probe_record, trusted_cross_edges, cross_edges_of_node, cross_edges_by_month, community_detail, community_of_type, mention_targets, community_legend, search_filenames, batches_applied, file_links, edge_passes,
        vault_tree, entry_with_extension, entry_in_namespace, migration_or_nothing, migration_of_parsed, entry_scores, graph_flows, context_sufficiency, exact_neighbours, embeddable_kinds,
    )
}


def _q(node: str, ns: str) -> str:
    return f"CASE WHEN starts_with({node}, 'code::') OR starts_with({node}, 'conv::') OR starts_with({node}, 'nimbus::') THEN {node} ELSE {ns} || '::' || {node} END"


_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_DOC, _BARE = _STRIP.format(x="target_node"), "regexp_replace({x}, '^.*?::', '', 's')"
_KEY = f"replace(replace({_DOC}, '::', '__'), '/', '_') || '__to__' || replace(replace(source_node, '::', '__'), '/', '_')"
_FULL = "fs AS (SELECT DISTINCT * FROM probe_state WHERE edge_id IS NOT NULL)"
_BOX = f"""{_ROUTE}, {_FULL},
qu AS (SELECT {_KEY.replace('target_node', 'ro.target_node').replace('source_node', 'ro.source_node')} AS id, {_DOC.replace('target_node', 'ro.target_node')} AS source, ro.source_node AS target, ro.rank, fs.* EXCLUDE (source_node, target_node)
  FROM ro JOIN fs ON ro.edge_id = fs.edge_id WHERE action = 'queued'),
bx AS (SELECT id, source, target, arg_max(confidence, (coalesce(confidence, 0), edge_id)) AS confidence, arg_max(rank, (coalesce(confidence, 0), edge_id)) AS top_k_rank, CAST(count(*) AS INTEGER) AS signals, max(coalesce(consecutive_seen, 0)) AS longest FROM qu GROUP BY ALL)"""
_PROMOTED = f"""SELECT {_BARE.format(x=_DOC.replace('target_node', 'ro.target_node'))} AS src, ro.source_node AS dst, 'mentions_symbol' AS relation, 'INFERRED' AS tier, max(fs.confidence) AS score, 1.0::DOUBLE AS weight, 'conv' AS source_pass, 'anchored' AS lifecycle
FROM ro JOIN fs ON ro.edge_id = fs.edge_id WHERE action = 'auto_promoted' GROUP BY ALL"""
_LOWER = _ROUTE.replace("SELECT DISTINCT edge_id, source_node, target_node, confidence,", "SELECT DISTINCT edge_id, source_node, target_node, confidence * 0.9 AS confidence,")
_DEG = "dg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM ve UNION ALL SELECT dst FROM ve) GROUP BY id)"
_CE = "ce AS (SELECT e.*, a.community_id AS src_c, b.community_id AS dst_c FROM ve e LEFT JOIN vn a ON e.src = a.id LEFT JOIN vn b ON e.dst = b.id)"
_DETAIL = f"""{GRAPH}, {_CE}, cd AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM ce WHERE src_c = dst_c UNION ALL SELECT dst FROM ce WHERE src_c = dst_c) GROUP BY id),
gd AS (SELECT n.community_id, n.label, row_number() OVER (PARTITION BY n.community_id ORDER BY coalesce(c.degree, 0) DESC, n.id) AS rank FROM vn n LEFT JOIN cd c ON n.id = c.id WHERE n.community_id IS NOT NULL),
lb AS (SELECT community_id, string_agg(label, ' · ' ORDER BY rank) AS name FROM gd WHERE rank <= 3 GROUP BY community_id),
pk AS (SELECT *, CASE WHEN community_id = '{{x}}' THEN 0 WHEN contains(lower(name), '{{x}}') THEN 1 END AS p FROM lb),
pi AS (SELECT community_id, name FROM pk WHERE p = (SELECT min(p) FROM pk))
SELECT n.community_id, name AS label, n.id, kind, coalesce(degree, 0) AS degree FROM vn n JOIN pi ON n.community_id = pi.community_id LEFT JOIN cd ON n.id = cd.id"""
_ENTRY = """CASE WHEN lower(label) = 'report' THEN 1 WHEN lower(id) = 'report' THEN 2 WHEN list_contains(list_transform(coalesce(aliases, []), lambda a: lower(a)), 'report') THEN 3
  WHEN contains(lower(label), 'report') THEN 4 WHEN lower(id) = 'tag:report' THEN 5 END"""
_MIGRATED = "CASE WHEN source_pass IN ('ast', 'code') THEN 'deterministic' WHEN source_pass = 'conv' THEN 'anchored' END"

SQL = {
    "federated_edges": f"""{GRAPH}, ow AS (SELECT {_q('e.src', "coalesce(a.namespace, 'nimbus')")} AS src, {_q('e.dst', "coalesce(b.namespace, a.namespace, 'nimbus')")} AS dst, relation, tier, coalesce(weight, 1.0) AS weight
  FROM ve e LEFT JOIN vn a ON e.src = a.id LEFT JOIN vn b ON e.dst = b.id),
t AS (SELECT DISTINCT namespace, tag FROM (SELECT namespace, unnest(tags) AS tag FROM vn) WHERE tag IS NOT NULL),
br AS (SELECT x.namespace || '::tag:' || x.tag AS src, y.namespace || '::tag:' || y.tag AS dst FROM t x JOIN t y ON x.tag = y.tag AND x.namespace <> y.namespace)
SELECT * FROM ow WHERE NOT EXISTS (SELECT 1 FROM br WHERE br.src = ow.src AND br.dst = ow.dst) UNION ALL SELECT src, dst, 'shared_tag', 'INFERRED', 0.5 FROM br""",
    "namespace_dirs": f"""WITH {VN}, p AS (SELECT namespace, string_split(CASE WHEN starts_with(id, namespace || '::') THEN substr(id, length(namespace) + 3) ELSE id END, '/') AS p FROM vn
  WHERE NOT ((starts_with(id, 'code::') AND namespace <> 'code') OR (starts_with(id, 'conv::') AND namespace <> 'conv') OR (starts_with(id, 'nimbus::') AND namespace <> 'nimbus'))),
c AS (SELECT namespace, p[1] AS dir, count(*) AS nodes FROM p WHERE len(p) >= 2 GROUP BY ALL)
SELECT namespace, dir, nodes, CAST(row_number() OVER (PARTITION BY namespace ORDER BY nodes DESC, dir) AS INTEGER) AS rank FROM c QUALIFY rank <= 8""",
    "namespace_samples": f"WITH {VN} SELECT namespace, id FROM vn WHERE contains(id, '/') QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY id) <= 3",
    "inbox_entries": f"WITH {_BOX} SELECT id, source, target, confidence, top_k_rank, 'pending' AS status, signals, longest FROM bx",
    "inbox_by_confidence": f"WITH {_BOX} SELECT id, confidence FROM bx ORDER BY confidence DESC NULLS LAST, id LIMIT 10",
    "inbox_by_seen": f"WITH {_BOX} SELECT id, longest FROM bx ORDER BY longest DESC, id LIMIT 10",
    "promoted_edges": f"WITH {_ROUTE}, {_FULL} {_PROMOTED}",
    "anchored_state": f"WITH {_ROUTE}, {_FULL} SELECT CASE WHEN edge_id IN (SELECT edge_id FROM ro WHERE action = 'auto_promoted') THEN 'anchored' ELSE lifecycle_class END AS lifecycle_class, count(*) AS n FROM fs GROUP BY ALL",
    "approved_edges": f"WITH {_BOX} SELECT {_BARE.format(x='source')} AS src, target AS dst, confidence AS score, 'anchored' AS lifecycle FROM bx WHERE top_k_rank % 2 = 0",
    "decided_inbox": f"WITH {_BOX} SELECT id, CASE WHEN top_k_rank % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status, 'reviewer' AS decided_by FROM bx",
    "route_counters": f"""WITH {_BOX}, r2 AS (WITH {_LOWER} SELECT {_KEY} AS id, action FROM ro), j AS (SELECT r2.*, bx.id IS NOT NULL AS held FROM r2 LEFT JOIN bx ON r2.id = bx.id)
SELECT count(CASE WHEN action = 'auto_promoted' THEN 1 END) AS promoted, count(CASE WHEN action = 'queued' AND NOT held THEN 1 END) AS queued, count(CASE WHEN action = 'discarded' AND held THEN 1 END) AS rolled_back, count(CASE WHEN action = 'discarded' AND NOT held THEN 1 END) AS discarded FROM j""",
    "probe_record": f"""WITH {_FULL},
sn AS (SELECT DISTINCT split_part(source_node, '::', 1) || '::' || {_BARE.format(x='source_node')} || '→' || split_part(target_node, '::', 1) || '::' || {_BARE.format(x='target_node')} AS edge_id, 'EXTRACTED' AS tier, 0.8 AS w
  FROM fs WHERE lifecycle_class <> 'deterministic' AND split_part(source_node, '::', 1) <> split_part(target_node, '::', 1)
  UNION SELECT DISTINCT split_part(source_node, '::', 1) || '::' || {_BARE.format(x='source_node')} || '→nimbus::new-note', 'INFERRED', 0.6 FROM fs WHERE lifecycle_class <> 'deterministic' AND split_part(source_node, '::', 1) <> 'nimbus'),
j AS (SELECT coalesce(fs.edge_id, sn.edge_id) AS edge_id, fs.edge_id IS NOT NULL AS old, sn.edge_id IS NOT NULL AS hit, fs.* EXCLUDE (edge_id), sn.tier, sn.w, coalesce(lower(lifecycle_class) = 'anchored', false) AS anchored,
  last_seen_parsed_at IS NOT DISTINCT FROM 'MIGRATION_PENDING' AS waits, model_id IS DISTINCT FROM '{MODEL}' AS other, last_seen_parsed_at IS DISTINCT FROM '{SCAN}' AS again FROM fs FULL JOIN sn ON fs.edge_id = sn.edge_id)
SELECT edge_id, CASE WHEN old THEN confidence_tier ELSE tier END AS confidence_tier, CASE WHEN NOT old OR (hit AND NOT anchored AND (waits OR other)) THEN CAST(w AS DOUBLE) ELSE confidence END AS confidence,
  CASE WHEN NOT old OR (hit AND NOT anchored AND (waits OR other OR again)) THEN '{SCAN}' ELSE last_seen_parsed_at END AS last_seen_parsed_at,
  CASE WHEN NOT old THEN 1 WHEN hit AND NOT anchored AND NOT waits AND other THEN 1 WHEN hit AND NOT anchored AND NOT waits AND again THEN coalesce(consecutive_seen, 0) + 1 ELSE consecutive_seen END AS consecutive_seen,
  CASE WHEN NOT old OR (hit AND NOT anchored AND (waits OR other)) THEN '{MODEL}' ELSE model_id END AS model_id, CASE WHEN old THEN lifecycle_class ELSE 'probabilistic' END AS lifecycle_class FROM j""",
    "trusted_cross_edges": "SELECT DISTINCT edge_id, confidence FROM probe_state WHERE edge_id IS NOT NULL AND coalesce(confidence, 0) >= 0.7 AND confidence_tier = 'INFERRED'",
    "cross_edges_of_node": "SELECT DISTINCT edge_id, source_node, target_node FROM probe_state WHERE edge_id IS NOT NULL AND (contains(source_node, 'KNOW-00001') OR contains(target_node, 'KNOW-00001'))",
    "cross_edges_by_month": "SELECT CAST(datediff('day', DATE '1970-01-01', CAST(CAST(first_seen_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS DATE)) AS BIGINT) AS day, count(*) AS n FROM (SELECT DISTINCT edge_id, first_seen_at FROM probe_state WHERE edge_id IS NOT NULL) GROUP BY ALL",
    "community_detail": _DETAIL.format(x=PART),
    "community_of_type": _DETAIL.format(x="a") + " WHERE ontology_type = 'fact'",
    "mention_targets": f"""{GRAPH} SELECT src, dst, coalesce(label, list_last(string_split(dst, '::'))) AS label, coalesce(kind, '?') AS kind, coalesce(sig, '') AS signature, coalesce(tier, 'INFERRED') AS tier, score
FROM ve LEFT JOIN (SELECT id, label, kind, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.signature') END AS sig FROM vn WHERE namespace = 'code') c ON dst = id
WHERE relation = 'mentions_symbol' AND score >= 0.7 AND coalesce(tier, 'INFERRED') IN ('EXTRACTED', 'INFERRED')""",
    "community_legend": f"""{GRAPH}, {_DEG}, d AS (SELECT community_id, id, list_last(string_split(label, '::')) AS label, coalesce(degree, 0) AS degree FROM vn LEFT JOIN dg USING (id) WHERE kind IN ('note', 'knowledge') AND community_id IS NOT NULL),
h AS (SELECT community_id, label, row_number() OVER (PARTITION BY community_id ORDER BY degree DESC, id) AS k, count(*) OVER (PARTITION BY community_id) AS members FROM d)
SELECT community_id, members, label AS hub, CAST(row_number() OVER (ORDER BY members DESC, community_id) AS INTEGER) AS rank FROM h WHERE k = 1 ORDER BY rank LIMIT 8""",
    "search_filenames": f"WITH {_FILES} SELECT path FROM fl WHERE contains(lower(list_last(string_split(path, '/'))), 'edges')",
    "batches_applied": """WITH o AS (SELECT DISTINCT batch_no, title FROM chunks WHERE batch_no > 0 AND title IS NOT NULL), w AS (SELECT DISTINCT title FROM chunks WHERE batch_no = 0)
SELECT batch_no, count(*) AS items, count(*) - count(w.title) AS missing, count(*) = count(w.title) AS complete FROM o LEFT JOIN w ON o.title = w.title GROUP BY batch_no""",
    "file_links": f"WITH {_FILES} SELECT path, replace(url_encode('notes of ' || path || ' (1+1)*~'), '%2F', '/') AS link FROM fl",
    "edge_passes": f"WITH {VE} SELECT CASE WHEN relation IN ('calls', 'imports', 'inherits') THEN 'code' WHEN tier = 'INFERRED' THEN 'llm' ELSE 'ast' END AS pass, relation, count(*) AS n FROM ve GROUP BY ALL",
    "vault_tree": f"WITH {VN} SELECT 'nimbus:vault:notes' AS src, id AS dst FROM vn WHERE namespace = 'nimbus' AND kind IN ('note', 'knowledge', 'tag', 'category')",
    "entry_with_extension": f"WITH {VN}, en AS (SELECT id, namespace, label, {_ENTRY} AS priority FROM vn) SELECT id, namespace, priority FROM en WHERE priority IS NOT NULL QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY priority, CASE WHEN priority = 4 THEN length(label) ELSE 0 END, id) = 1",
    "entry_in_namespace": f"WITH {VN}, en AS (SELECT id, namespace, label, {_ENTRY} AS priority FROM vn WHERE namespace = 'nimbus') SELECT id, namespace, priority FROM en WHERE priority IS NOT NULL ORDER BY priority, CASE WHEN priority = 4 THEN length(label) ELSE 0 END, id LIMIT 1",
    "migration_or_nothing": f"WITH {VE}, b AS (SELECT count(*) > 0 AS blocked FROM ve WHERE source_pass IS NULL OR source_pass NOT IN ('ast', 'code', 'conv')) SELECT CASE WHEN blocked THEN lifecycle ELSE {_MIGRATED} END AS lifecycle, count(*) AS n FROM ve, b GROUP BY ALL",
    "migration_of_parsed": f"WITH {VE} SELECT {_MIGRATED} AS lifecycle, count(*) AS n FROM ve WHERE source_pass IN ('ast', 'code', 'conv') GROUP BY ALL",
    "entry_scores": f"""{GRAPH}, ca AS (SELECT src, dst FROM ve WHERE relation = 'calls'), i AS (SELECT dst AS id, count(*) AS n FROM ca GROUP BY 1), o AS (SELECT src AS id, count(*) AS n FROM ca GROUP BY 1),
f AS (SELECT id, trim(label) AS label FROM vn WHERE namespace = 'code' AND kind IN ('function', 'method'))
SELECT f.id, round(least(1.0, CASE WHEN NOT starts_with(label, '_') THEN 0.2 ELSE 0.0 END + CASE WHEN i.n IS NULL THEN 0.4 ELSE 0.0 END + CASE WHEN coalesce(o.n, 0) >= 2 THEN 0.2 ELSE 0.0 END
  + CASE WHEN lower(label) IN ('main', 'run', 'start', 'serve', 'execute', 'dispatch', 'handle', 'process', 'boot', 'launch', 'init', 'setup') THEN 0.3 WHEN regexp_matches(lower(label), '^(on|handle|process|run|dispatch)_') THEN 0.25 ELSE 0.0 END), 6)::DOUBLE AS score
FROM f LEFT JOIN i ON f.id = i.id LEFT JOIN o ON f.id = o.id""",
    "exact_neighbours": f"WITH {VV} SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.vec, b.vec), 6) AS score FROM vv a JOIN vv b ON a.id < b.id WHERE list_cosine_similarity(a.vec, b.vec) >= 0.9",
    "embeddable_kinds": f"""WITH {VN} SELECT kind, count(*) AS n FROM vn WHERE kind IN ('note', 'knowledge', 'image', 'pdf', 'audio', 'function', 'class', 'module') AND trim(content) <> ''
AND NOT coalesce(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.embed') END = 'false', false) GROUP BY kind""",
    "context_sufficiency": f"""WITH {CHUNK}, q AS (SELECT DISTINCT qa_id, question, answer FROM qa WHERE question IS NOT NULL),
qw AS (SELECT qa_id, unnest({words("question")}) AS w FROM q), cw AS (SELECT chunk_id, unnest({words("text")}) AS w FROM ch), fr AS (SELECT w, 1.0 / count(*) AS weight FROM cw GROUP BY w),
s AS (SELECT qa_id, chunk_id, round(sum(weight), 9) AS score FROM qw JOIN cw USING (w) JOIN fr USING (w) GROUP BY ALL),
h AS (SELECT s.qa_id, s.chunk_id, row_number() OVER (PARTITION BY s.qa_id ORDER BY score DESC, s.chunk_id) AS rank FROM s QUALIFY rank <= 5),
hw AS (SELECT DISTINCT qa_id, w FROM h JOIN cw USING (chunk_id)), aw AS (SELECT DISTINCT qa_id, unnest({words("answer")}) AS w FROM q),
c AS (SELECT aw.qa_id, count(hw.w) / count(*) AS share FROM aw LEFT JOIN hw ON aw.qa_id = hw.qa_id AND aw.w = hw.w GROUP BY 1)
SELECT DISTINCT h.qa_id AS query_id, round(coalesce(share, 0.0), 6) AS covered, coalesce(share, 0.0) >= 0.5 AS sufficient FROM h LEFT JOIN c ON h.qa_id = c.qa_id""",
}
