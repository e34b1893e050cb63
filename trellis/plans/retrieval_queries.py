"""Registered queries of retrieval, linking, observed edges, splitting and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.functions import text
from trellis.operators import entities, graph, levels, link, metrics, probe, records, retrieve, split, validate
from trellis.plans.sqlparts import CHUNK, GRAPH, VE, VN, VV, overlap, words
from trellis.session import cut, table

QUERY = ["orphan", "sweeper", "edge", "ledger"]
PHRASE = "orphan sweeper"
ENTRY = "report"


def _nodes(spark, d, *cols):
    return graph.valid_nodes(table(spark, d, "nodes"), *cols)


def _edges(spark, d):
    return graph.valid_edges(table(spark, d, "edges"))


def _chunks(spark, d):
    return table(spark, d, "chunks").select("chunk_id", "source_idx", "idx", "text", "title").filter(F.col("text").isNotNull()).distinct()


def _vectors(spark, d):
    v = records.last_vectors(table(spark, d, "embed_cache"))
    return v.select(F.col("node_id").alias("id"), "vec")


def bm25_search(spark, d):
    return retrieve.bm25(_chunks(spark, d), "chunk_id", F.col("text"), QUERY).select("id", F.round("score", 6).alias("score"))


def vector_search(spark, d):
    v = _vectors(spark, d)
    q = v.orderBy("id").limit(1).collect()
    return retrieve.vector_search(v, "id", "vec", q[0]["vec"] if q else [], 20).select("id", F.round("score", 6).alias("score"))


def knn_topk(spark, d):
    e = table(spark, d, "embeddings")
    return retrieve.knn(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 5).select("id", "other", F.round("score", 6).alias("score"), "rank")


def exact_search(spark, d):
    return retrieve.exact(_nodes(spark, d, "label"), "id", "label", ENTRY)


def hybrid_search(spark, d):
    n = cut(_nodes(spark, d, "label", "content", "namespace"))
    v = cut(_vectors(spark, d))
    q = v.orderBy("id").limit(1).collect()
    hits = retrieve.hybrid(n, v, QUERY, list(q[0]["vec"]) if q else None, 10)
    return hits.select("id", F.round("score", 6).alias("score"), "hits")


def search_knowledge(spark, d):
    n = cut(_nodes(spark, d, "label", "content", "namespace", "kind", "tokens"))
    hits = retrieve.hybrid(n, _vectors(spark, d), QUERY, None, 5)
    return retrieve.expand(cut(hits), n, _edges(spark, d), 0.5)


def entry_resolution(spark, d):
    return retrieve.entry_points(_nodes(spark, d, "label", "aliases", "namespace"), ENTRY)


def entry_per_namespace(spark, d):
    return retrieve.entry_points(_nodes(spark, d, "label", "aliases", "namespace"), ENTRY, True)


def search_files(spark, d):
    return retrieve.search_lines(records.last_files(table(spark, d, "files")), PHRASE)


def _rendered(spark, d, *cols):
    """Notes as they are written out: the content, then their typed relations as links and their tags."""
    n = _nodes(spark, d, "content", "relations", "tags", *[c for c in cols if c not in ("relations", "tags")])
    none = F.array().cast("array<string>")
    targets = F.array_distinct(F.flatten(F.coalesce(F.map_values("relations"), F.array().cast("array<array<string>>"))))
    links = F.transform(F.filter(targets, lambda t: t.isNotNull()), lambda t: F.concat(F.lit("[["), t, F.lit("]]")))
    tags = F.transform(F.filter(F.coalesce("tags", none), lambda t: t.isNotNull()), lambda t: F.concat(F.lit("#"), t))
    return n.withColumn("content", F.concat_ws(" ", F.coalesce("content", F.lit("")), F.array_join(F.coalesce(links, none), " "), F.array_join(tags, " ")))


def wikilinks(spark, d):
    return link.wikilinks(_nodes(spark, d, "content"))


def name_index(spark, d):
    return link.name_index(_nodes(spark, d, "label", "aliases", "knowledge_id", "source_file"))


def wikilink_edges(spark, d):
    n = cut(_rendered(spark, d, "label", "aliases", "knowledge_id", "source_file"))
    return link.resolve_links(link.wikilinks(n), link.name_index(n))


def typed_relations(spark, d):
    n = cut(_nodes(spark, d, "relations", "label", "aliases", "knowledge_id", "source_file"))
    return link.typed_relations(n, link.name_index(n))


def inline_tags(spark, d):
    return _rendered(spark, d).select("id", F.explode(text.inline_tags(F.col("content"))).alias("tag"))


def tag_cooccurrence(spark, d):
    return link.tag_pairs(_nodes(spark, d, "tags"))


def shared_tag_bridges(spark, d):
    return link.shared_tag_bridges(_nodes(spark, d, "tags", "namespace"))


def symbol_links(spark, d):
    """The symbols of the code graph in all files of the vault, of which the given ones name symbols in code only."""
    notes = records.last_files(table(spark, d, "files")).select(F.col("path").alias("id"), "content")
    return link.symbol_links(notes, _nodes(spark, d, "label", "namespace", "kind"))


def drift_check(spark, d):
    return link.drift(_nodes(spark, d, "namespace"), _edges(spark, d))


def drift_flags(spark, d):
    n = cut(_nodes(spark, d, "namespace"))
    return link.flag_suspected(n, link.drift(n, _edges(spark, d)))


def similarity_edges(spark, d):
    return link.similarity_edges(_vectors(spark, d), _edges(spark, d))


def embedding_bridges(spark, d):
    ns = _nodes(spark, d, "namespace").select("id", F.col("namespace").alias("grp"))
    return link.embedding_bridges(cut(_vectors(spark, d).join(ns, "id")), 0.7)


def _observed(spark, d):
    e = table(spark, d, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2020-01-01"))
    return e.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("edge_id"), day.alias("scan"), F.concat(F.lit("m"), F.floor(day / 10).cast("string")).alias("model_id"), F.round("value", 4).alias("confidence"))


def probe_fold(spark, d):
    return probe.fold_observations(_observed(spark, d))


def _state(spark, d):
    return records.distinct_probe(table(spark, d, "probe_state"))


def tier2_candidates(spark, d):
    return probe.ranked_candidates(_state(spark, d)).select("edge_id", "rank", "candidate")


def edge_routes(spark, d):
    return probe.route(_state(spark, d), probe.PROFILES["bge-m3"])


def route_report(spark, d):
    return probe.route(_state(spark, d), probe.PROFILES["bge-m3"]).groupBy("action").agg(F.count("*").alias("n"))


def inbox_top(spark, d):
    r = probe.route(_state(spark, d), probe.PROFILES["bge-m3"]).filter("action = 'queued'")
    return r.select(probe.inbox_key(F.col("source_node"), F.col("target_node")).alias("inbox_id"), "rank", "tier")


def new_cross_edges(spark, d):
    return records.first_seen_since(table(spark, d, "probe_state"), "2025-09-01T00:00:00+00:00").select("edge_id")


def _atoms(splitter, **options):
    def run(spark, d):
        return split.atoms(_chunks(spark, d), "chunk_id", "text", splitter, **options)

    return run


def splitter_scores(spark, d):
    c = _chunks(spark, d)
    return metrics.splitter_scores(split.atoms(c, "chunk_id", "text", "sentence"), c, "chunk_id", "text")


def l1_windows(spark, d):
    return levels.windows(_chunks(spark, d), "source_idx", ["idx", "chunk_id"], "chunk_id", "text", 3)


def _evaluation(spark, d):
    """Each question against the chunks, by shared words: the hits of a keyword retriever."""
    return levels.keyword_hits(table(spark, d, "qa"), _chunks(spark, d), 5)


def retrieval_scores(spark, d):
    return metrics.retrieval_scores(_evaluation(spark, d), 5)


def retrieval_iou(spark, d):
    c = cut(_chunks(spark, d))
    return metrics.retrieval_iou(levels.keyword_hits(table(spark, d, "qa"), c, 5), c, "chunk_id", "text")


def splitter_table(spark, d):
    c = cut(_chunks(spark, d))
    return metrics.splitter_table({n: split.atoms(c, "chunk_id", "text", n) for n in ("paragraph", "sentence")}, c, "chunk_id", "text")


def quarantined_edges(spark, d):
    return validate.check_edges(_edges(spark, d))[1].select("src", "dst", "tier", "score", "problem")


def stale_mentions(spark, d):
    changed = _nodes(spark, d, "kind", "maturity").filter("kind = 'function' AND maturity = 'growing'").select("id")
    return validate.mark_stale(_edges(spark, d), changed, "2026-01-01").select("src", "symbol", "code_node")


def query_entities(spark, d):
    q = table(spark, d, "qa").filter("question IS NOT NULL").select("qa_id", "question").distinct()
    return q.select("qa_id", F.explode(entities.names_in(F.col("question"))).alias("entity"))


def walk_retrieval(spark, d):
    """For every question the ten documents of highest rank by walks from the names in it."""
    q = table(spark, d, "qa").filter("question IS NOT NULL").select("qa_id", "question").distinct()
    seeds = q.select(F.col("qa_id").alias("grp"), F.explode(entities.names_in(F.col("question"))).alias("e")).select("grp", F.concat(F.lit("entity:"), "e").alias("id"), F.lit(1.0).alias("mass"))
    atoms = table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), entities.names_in(F.col("text")).alias("entities"))
    return entities.walk_many(entities.atom_entity_graph(atoms), seeds, 10).select(F.col("grp").alias("qa_id"), "id", F.round(F.col("score") + 1e-12, 9).alias("score"), "rank")


def boundary_clarity(spark, d):
    v = _vectors(spark, d).join(_nodes(spark, d, "namespace"), "id")
    return metrics.boundary_clarity(v, "namespace", "id")


def gold_alignment(spark, d):
    qa = table(spark, d, "qa").filter("answer IS NOT NULL AND source_text IS NOT NULL").distinct()
    atoms = split.atoms(qa, "qa_id", "source_text", "sentence").select(F.col("id").alias("case_id"), F.col("atom").alias("text"))
    gold = qa.select(F.col("qa_id").alias("case_id"), F.col("answer").alias("text"))
    got = metrics.gold_alignment(atoms, gold)
    return got.select("case_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def char_budget(spark, d):
    n = _nodes(spark, d, "community_id", "content")
    return levels.char_budget(n.filter(F.col("community_id").isNotNull() & F.col("content").isNotNull()), "community_id", "id", "content", 2000)


def embed_status(spark, d):
    return records.embed_status(_nodes(spark, d, "kind", "content", "content_hash"), table(spark, d, "embed_cache"))


def cache_gc(spark, d):
    """The given cache names its lines by the sha1 of the node's id."""
    live = _nodes(spark, d, "kind").select("id", F.sha1(F.col("id").cast("binary")).alias("content_hash"))
    return records.live_cache(table(spark, d, "embed_cache"), live).select("node_id", "sha", "append_seq")


def incremental_diff(spark, d):
    return records.diff_files(table(spark, d, "files"), "2025-07-01 00:00:00")


def deleted_sources(spark, d):
    return records.without_source(_nodes(spark, d, "source_file", "kind"), records.last_files(table(spark, d, "files"))).select("id", "source_file")


def know_ids(spark, d):
    return records.allocate_ids(_chunks(spark, d).select("chunk_id"), "chunk_id", 5000)


def dedup_recent(spark, d):
    return records.recent_decisions(table(spark, d, "dedup_log"), 20)


def dedup_actions(spark, d):
    return records.decision_summary(table(spark, d, "dedup_log"))


def contains_edges(spark, d):
    return records.contains_edges(table(spark, d, "tree_nodes"))


def sections(spark, d):
    return levels.sections(records.last_files(table(spark, d, "files")).filter(F.col("path").endswith(".md")), "path", "content")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_search, vector_search, knn_topk, exact_search, hybrid_search, search_knowledge, entry_resolution, entry_per_namespace, search_files, wikilinks, name_index, wikilink_edges, typed_relations, inline_tags,
        tag_cooccurrence, shared_tag_bridges, symbol_links, drift_check, drift_flags, similarity_edges, embedding_bridges, probe_fold, tier2_candidates, edge_routes, route_report, inbox_top, new_cross_edges,
        splitter_scores, l1_windows, retrieval_scores, retrieval_iou, splitter_table, quarantined_edges, stale_mentions, query_entities, walk_retrieval, boundary_clarity, gold_alignment, char_budget, embed_status, cache_gc, incremental_diff, deleted_sources, know_ids, dedup_recent, dedup_actions, contains_edges, sections,
    )
} | {"split_sentence": _atoms("sentence"), "split_paragraph": _atoms("paragraph"), "split_window": _atoms("fixed_window", size=200, overlap=40)}

_T = "regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+')"
_BM25 = r"""
tk AS (SELECT id, list_filter(regexp_extract_all(coalesce(body, ''), '[\p{L}\p{N}_]+'), lambda t: length(t) > 1) AS t FROM bd),
st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tk),
po AS (SELECT term, id, len, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM tk) GROUP BY ALL),
df AS (SELECT term, ln((SELECT n FROM st) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM po GROUP BY term),
fl AS (SELECT avg(idf) AS m FROM df),
bm AS (SELECT id, sum((CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean))) AS score
  FROM po JOIN df ON po.term = df.term, st, fl WHERE po.term IN ({terms}) GROUP BY id HAVING score > 0)
""".replace("{terms}", ", ".join(f"'{t}'" for t in QUERY))
_SENT = r"list_filter(list_transform(regexp_extract_all(text, '```[\s\S]*?```|[^.?!。？！\n]*[.?!。？！]|[^.?!。？！\n]+'), lambda s: CASE WHEN starts_with(s, '```') THEN s ELSE trim(regexp_replace(s, '[ \t\r]+', ' ', 'g')) END), lambda s: s <> '')"


def _enumerate(parts: str) -> str:
    return f"WITH {CHUNK}, p AS (SELECT chunk_id, {parts} AS a FROM ch) SELECT chunk_id AS id, CAST(i - 1 AS INTEGER) AS idx, a[i] AS atom FROM (SELECT chunk_id, a, unnest(range(1, len(a) + 1)) AS i FROM p)"


_LINKS = r"""lk AS (SELECT id, CAST(i - 1 AS INTEGER) AS pos, a[i] AS raw, regexp_extract(a[i], '\[\[([^\[\]]+)\]\]', 1) AS x FROM (SELECT id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT id, regexp_extract_all(content, '!?\[\[[^\[\]]+\]\]') AS a FROM vn))),
wl AS (SELECT id, pos, trim(regexp_extract(x, '^([^#^|]*)', 1)) AS target, regexp_extract(x, '#([^\^|]*)', 1) AS section, regexp_extract(x, '\^([^|]*)', 1) AS block, regexp_extract(x, '\|(.*)$', 1) AS display,
  CASE WHEN starts_with(raw, '!') THEN 'embeds' WHEN regexp_extract(x, '#([^\^|]*)', 1) <> '' THEN 'links_to_section' WHEN regexp_extract(x, '\^([^|]*)', 1) <> '' THEN 'links_to_block' ELSE 'links_to' END AS relation FROM lk)"""
_RENDERED = """rn AS (SELECT id, concat_ws(' ', coalesce(content, ''), array_to_string(list_transform(list_filter(coalesce(list_distinct(flatten(map_values(relations))), []), lambda t: t IS NOT NULL), lambda t: '[[' || t || ']]'), ' '),
  array_to_string(list_transform(list_filter(coalesce(tags, []), lambda t: t IS NOT NULL), lambda t: '#' || t), ' ')) AS content FROM vn)"""
_INDEX = r"""kf AS (SELECT DISTINCT id, tier, lower(key) AS key FROM (SELECT id, CASE WHEN knowledge_id IS NOT NULL THEN 3 WHEN list_contains(string_split(source_file, '/'), 'knowledge') THEN 1 ELSE 0 END AS tier,
  unnest(list_concat([label, knowledge_id], coalesce(aliases, []))) AS key FROM vn) WHERE key IS NOT NULL),
ni AS (SELECT key, min(id) AS id FROM (SELECT *, max(tier) OVER (PARTITION BY key) AS top FROM kf) WHERE tier = top GROUP BY key HAVING count(*) = 1)"""
_STATE = r"ps AS (SELECT DISTINCT edge_id, source_node, target_node, confidence, consecutive_seen, lifecycle_class, last_seen_parsed_at FROM probe_state WHERE edge_id IS NOT NULL)"
_ROUTE = f"""{_STATE},
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_node ORDER BY coalesce(confidence, 0) DESC, edge_id) AS INTEGER) AS rank, round(max(coalesce(confidence, 0)) OVER (PARTITION BY source_node) * 0.75, 9) AS floor FROM ps),
cd AS (SELECT *, round(coalesce(confidence, 0), 9) >= floor AND rank <= 5 AS candidate,
  CASE WHEN coalesce(lower(lifecycle_class) = 'anchored' OR last_seen_parsed_at = 'MIGRATION_PENDING', false) THEN 3 WHEN coalesce(confidence, 0) >= 0.75 AND rank = 1 AND coalesce(consecutive_seen, 0) >= 2 THEN 1
  WHEN coalesce(confidence, 0) >= 0.70 AND (rank = 1 OR coalesce(consecutive_seen, 0) >= 2) THEN 2 ELSE 3 END AS tier FROM rk),
ro AS (SELECT edge_id, source_node, target_node, rank, tier, CASE WHEN tier = 1 THEN 'auto_promoted' WHEN tier = 2 AND candidate THEN 'queued' ELSE 'discarded' END AS action FROM cd)"""
_FILES = "fl AS (SELECT path, content FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY arrived_at DESC, file_seq DESC) AS k FROM files WHERE path IS NOT NULL) WHERE k = 1 AND content IS NOT NULL)"
_ENTRY = f"""en AS (SELECT id, namespace, label, CASE WHEN lower(label) = '{ENTRY}' THEN 1 WHEN lower(id) = '{ENTRY}' THEN 2 WHEN list_contains(list_transform(coalesce(aliases, []), lambda a: lower(a)), '{ENTRY}') THEN 3
  WHEN contains(lower(label), '{ENTRY}') THEN 4 WHEN lower(id) = 'tag:{ENTRY}' THEN 5 END AS priority FROM vn)"""
_SIZE = "CASE WHEN priority = 4 THEN length(label) ELSE 0 END"

def _walks(rounds: int) -> str:
    names = r"list_distinct(list_transform(regexp_extract_all({x}, '\p{{Lu}}[\p{{L}}\p{{N}}]+(?:[ ]\p{{Lu}}[\p{{L}}\p{{N}}]+)*'), lambda x: lower(x)))"
    parts = [
        f"o AS (SELECT DISTINCT 'atom:' || CAST(doc_id AS VARCHAR) AS a, 'entity:' || e AS b FROM (SELECT doc_id, unnest({names.format(x='text')}) AS e FROM documents WHERE text IS NOT NULL))",
        "bo AS (SELECT a, b FROM o UNION ALL SELECT b, a FROM o), tot AS (SELECT a, count(*) AS t FROM bo GROUP BY a), st AS (SELECT bo.a, b, 1.0::DOUBLE / t AS p FROM bo JOIN tot ON bo.a = tot.a)",
        f"sd AS (SELECT DISTINCT qa_id, 'entity:' || e AS id FROM (SELECT qa_id, unnest({names.format(x='question')}) AS e FROM qa WHERE question IS NOT NULL) WHERE 'entity:' || e IN (SELECT a FROM tot))",
        "r0 AS (SELECT qa_id, id, 1.0::DOUBLE / count(*) OVER (PARTITION BY qa_id) AS r FROM sd), ho AS (SELECT * FROM r0)",
    ]
    for i in range(1, rounds + 1):
        parts.append(f"r{i} AS (SELECT qa_id, id, sum(r) AS r FROM (SELECT qa_id, b AS id, r * p * 0.7 AS r FROM r{i - 1} JOIN st ON id = a UNION ALL SELECT qa_id, id, 0.3 * r FROM ho) GROUP BY ALL)")
    return f"WITH {', '.join(parts)} SELECT qa_id, substr(id, 6) AS id, round(r + 1e-12, 9) AS score, CAST(row_number() OVER (PARTITION BY qa_id ORDER BY round(r + 1e-14, 12) DESC, id) AS INTEGER) AS rank FROM r{rounds} WHERE starts_with(id, 'atom:') QUALIFY rank <= 10"


SQL = {
    "bm25_search": f"WITH {CHUNK}, bd AS (SELECT chunk_id AS id, text AS body FROM ch), {_BM25} SELECT id, round(score, 6) AS score FROM bm",
    "vector_search": f"WITH {VV}, q AS (SELECT vec AS v FROM vv ORDER BY id LIMIT 1), s AS (SELECT id, list_cosine_similarity(vec, v) AS c FROM vv, q) SELECT id, round(c, 6) AS score FROM s ORDER BY round(c, 9) DESC, id LIMIT 20",
    "knn_topk": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS id, b.vec_id AS other, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT id, other, c, CAST(row_number() OVER (PARTITION BY id ORDER BY round(c, 9) DESC, other) AS INTEGER) AS rank FROM p) SELECT id, other, round(c, 6) AS score, rank FROM r WHERE rank <= 5""",
    "exact_search": f"WITH {VN} SELECT id FROM vn WHERE contains(lower(id), '{ENTRY}') OR contains(lower(label), '{ENTRY}')",
    "hybrid_search": f"""WITH {VN}, {VV}, bd AS (SELECT id, concat_ws(' ', label, label, content) AS body FROM vn), {_BM25},
q AS (SELECT vec AS v FROM vv ORDER BY id LIMIT 1), cs AS (SELECT id, list_cosine_similarity(vec, v) AS c FROM vv, q),
s AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM bm QUALIFY r <= 40
  UNION ALL SELECT id, row_number() OVER (ORDER BY id) AS r FROM vn WHERE contains(lower(id), '{" ".join(QUERY)}') OR contains(lower(label), '{" ".join(QUERY)}') QUALIFY r <= 40
  UNION ALL SELECT id, row_number() OVER (ORDER BY round(c, 9) DESC, id) AS r FROM cs QUALIFY r <= 40),
f AS (SELECT id, sum(1.0 / (60 + r)) AS score, count(*) AS hits FROM s WHERE id IN (SELECT id FROM vn) GROUP BY id)
SELECT id, round(score, 6) AS score, hits FROM f ORDER BY round(score, 9) DESC, id LIMIT 10""",
    "search_knowledge": f"""{GRAPH}, bd AS (SELECT id, concat_ws(' ', label, label, content) AS body FROM vn), {_BM25},
s AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM bm QUALIFY r <= 20
  UNION ALL SELECT id, row_number() OVER (ORDER BY id) AS r FROM vn WHERE contains(lower(id), '{" ".join(QUERY)}') OR contains(lower(label), '{" ".join(QUERY)}') QUALIFY r <= 20),
h AS (SELECT id FROM (SELECT id, sum(1.0 / (60 + r)) AS sc FROM s GROUP BY id) ORDER BY round(sc, 9) DESC, id LIMIT 5),
bo AS (SELECT src AS a, dst AS b FROM ve WHERE coalesce(score, 1.0) >= 0.5 AND coalesce(tier, 'EXTRACTED') IN ('EXTRACTED', 'INFERRED') UNION ALL SELECT dst, src FROM ve WHERE coalesce(score, 1.0) >= 0.5 AND coalesce(tier, 'EXTRACTED') IN ('EXTRACTED', 'INFERRED')),
x AS (SELECT id, NULL AS via FROM h UNION ALL SELECT b, min(a) FROM bo JOIN h ON bo.a = h.id WHERE b NOT IN (SELECT id FROM h) GROUP BY b)
SELECT vn.id, label, kind, tokens, via FROM x JOIN vn ON x.id = vn.id""",
    "entry_resolution": f"WITH {VN}, {_ENTRY} SELECT id, namespace, priority FROM en WHERE priority IS NOT NULL ORDER BY priority, {_SIZE}, id LIMIT 1",
    "entry_per_namespace": f"WITH {VN}, {_ENTRY} SELECT id, namespace, priority FROM en WHERE priority IS NOT NULL QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY priority, {_SIZE}, id) = 1",
    "search_files": f"WITH {_FILES}, l AS (SELECT path, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT path, string_split(content, chr(10)) AS a FROM fl)) SELECT path, CAST(i AS INTEGER) AS line_no, substr(a[i], 1, 200) AS text FROM l WHERE contains(lower(a[i]), '{PHRASE}')",
    "wikilinks": f"WITH {VN}, {_LINKS} SELECT * FROM wl",
    "name_index": f"WITH {VN}, {_INDEX} SELECT key, id FROM ni",
    "wikilink_edges": f"WITH {VN}, {_RENDERED}, {_LINKS.replace('FROM vn)', 'FROM rn)')}, {_INDEX} SELECT DISTINCT wl.id AS src, ni.id AS dst, relation FROM wl JOIN ni ON lower(target) = key WHERE wl.id <> ni.id",
    "typed_relations": f"""WITH {VN}, {_INDEX}, r AS (SELECT id, e.key AS relation, unnest(e.value) AS target FROM (SELECT id, unnest(map_entries(relations)) AS e FROM vn))
SELECT DISTINCT r.id AS src, ni.id AS dst, relation FROM r JOIN ni ON lower(target) = ni.key WHERE r.id <> ni.id AND relation IN ('supersedes', 'superseded_by', 'depends_on', 'refines', 'contradicts', 'references')""",
    "inline_tags": rf"WITH {VN}, {_RENDERED} SELECT id, unnest(list_distinct(regexp_extract_all(regexp_replace(regexp_replace(content, '```[\s\S]*?```', ' ', 'g'), '`[^`\n]*`', ' ', 'g'), '(?:^|[ \t\r\n])#([A-Za-z_][A-Za-z0-9_/-]*)', 1))) AS tag FROM rn",
    "tag_cooccurrence": f"""WITH {VN}, t AS (SELECT DISTINCT id, tag FROM (SELECT id, unnest(tags) AS tag FROM vn) WHERE tag IS NOT NULL)
SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS nodes FROM t a JOIN t b ON a.id = b.id AND a.tag < b.tag GROUP BY ALL""",
    "shared_tag_bridges": f"""WITH {VN}, t AS (SELECT DISTINCT namespace, tag FROM (SELECT namespace, unnest(tags) AS tag FROM vn) WHERE tag IS NOT NULL)
SELECT a.tag, a.namespace AS ns_a, b.namespace AS ns_b, 0.5::DOUBLE AS weight FROM t a JOIN t b ON a.tag = b.tag AND a.namespace < b.namespace""",
    "symbol_links": rf"""WITH {VN}, {_FILES}, sy AS (SELECT DISTINCT trim(label) AS symbol, id AS dst FROM vn WHERE namespace = 'code' AND kind IN ('function', 'class', 'module') AND length(trim(label)) >= 5 AND trim(label) NOT IN {tuple(link.GENERIC)}),
ns AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM sy),
w AS (SELECT src, symbol, 1 AS via, count(*) AS occurrences FROM (SELECT path AS src, unnest(regexp_extract_all(content, '[\p{{L}}\p{{N}}_]+')) AS symbol FROM fl) GROUP BY ALL
  UNION ALL SELECT src, symbol, 0, count(*) FROM (SELECT path AS src, trim(unnest(regexp_extract_all(content, '\[\[([^\]|]+)(\|[^\]]+)?\]\]', 1))) AS symbol FROM fl) GROUP BY ALL)
SELECT src, w.symbol, dst, CASE WHEN n > 1 THEN 'AMBIGUOUS' WHEN via = 0 THEN 'EXTRACTED' ELSE 'INFERRED' END AS tier, CASE WHEN n > 1 THEN 0.2 WHEN via = 0 THEN 1.0 ELSE 0.9 END::DOUBLE AS score,
  CASE WHEN via = 0 THEN 1.0 ELSE least(1.0, round(0.5 + 0.1 * occurrences, 6)) END::DOUBLE AS weight, occurrences
FROM w JOIN ns ON w.symbol = ns.symbol QUALIFY row_number() OVER (PARTITION BY src, w.symbol, dst ORDER BY via) = 1""",
    "similarity_edges": f"""WITH {VE}, {VV}, p AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.vec, y.vec) AS c FROM vv x JOIN vv y ON x.id <> y.id WHERE list_cosine_similarity(x.vec, y.vec) >= 0.65),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) <= 10), o AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, round(max(c), 4) AS score FROM k GROUP BY 1, 2)
SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM ve WHERE least(ve.src, ve.dst) = o.src AND greatest(ve.src, ve.dst) = o.dst)""",
    "embedding_bridges": f"""WITH {VN}, {VV}, g AS (SELECT vv.id, vec, namespace AS grp FROM vv JOIN vn ON vv.id = vn.id), p AS (SELECT x.id AS src, y.id AS dst, y.grp AS other, list_cosine_similarity(x.vec, y.vec) AS c FROM g x JOIN g y ON x.grp < y.grp WHERE list_cosine_similarity(x.vec, y.vec) >= 0.7)
SELECT src, dst, round(c, 4) AS score FROM p QUALIFY row_number() OVER (PARTITION BY src, other ORDER BY round(c, 9) DESC, dst) <= 5""",
    "drift_check": f"""{GRAPH} SELECT DISTINCT src, dst, CASE WHEN id IS NULL THEN 'not_found' ELSE 'valid' END AS status FROM ve LEFT JOIN (SELECT id FROM vn WHERE namespace = 'code') c ON dst = id WHERE relation = 'mentions_symbol'""",
    "drift_flags": f"""{GRAPH}, x AS (SELECT DISTINCT src, dst FROM ve WHERE relation = 'mentions_symbol' AND dst NOT IN (SELECT id FROM vn WHERE namespace = 'code') AND src IN (SELECT id FROM vn))
SELECT src, count(*) AS lost, array_to_string(list_sort(list_distinct(list(list_last(string_split(dst, '::'))))), ',') AS symbols FROM x GROUP BY src""",
    "probe_fold": """WITH o AS (SELECT user_id || ':' || event_type AS edge_id, datediff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS scan, round(value, 4) AS confidence FROM events),
o1 AS (SELECT edge_id, scan, max(confidence) AS confidence, 'm' || CAST(scan // 10 AS VARCHAR) AS model_id FROM o GROUP BY edge_id, scan),
s AS (SELECT *, CASE WHEN lag(scan) OVER w IS NULL OR lag(model_id) OVER w <> model_id THEN 1 ELSE 0 END AS nm, CASE WHEN lag(scan) OVER w IS NULL OR lag(model_id) OVER w <> model_id OR lag(scan) OVER w + 1 <> scan THEN 1 ELSE 0 END AS br FROM o1 WINDOW w AS (PARTITION BY edge_id ORDER BY scan)),
r AS (SELECT *, sum(nm) OVER w AS epoch, sum(br) OVER w AS island FROM s WINDOW w AS (PARTITION BY edge_id ORDER BY scan)),
l AS (SELECT edge_id, max(epoch) AS e, max(island) AS i, min(scan) AS first_scan, max(scan) AS last_scan, arg_max(model_id, scan) AS model_id FROM r GROUP BY edge_id),
g AS (SELECT l.edge_id, any_value(l.model_id) AS model_id, arg_min(CASE WHEN epoch = e THEN confidence END, CASE WHEN epoch = e THEN scan END) AS confidence,
  any_value(first_scan) AS first_scan, any_value(last_scan) AS last_scan, count(CASE WHEN island = i THEN 1 END) AS run FROM r JOIN l ON r.edge_id = l.edge_id GROUP BY l.edge_id)
SELECT edge_id, model_id, confidence, first_scan, last_scan, CAST(CASE WHEN last_scan = (SELECT max(scan) FROM o) THEN run ELSE 0 END AS INTEGER) AS consecutive_seen FROM g""",
    "tier2_candidates": f"WITH {_ROUTE} SELECT edge_id, rank, candidate FROM cd",
    "edge_routes": f"WITH {_ROUTE} SELECT * FROM ro",
    "route_report": f"WITH {_ROUTE} SELECT action, count(*) AS n FROM ro GROUP BY action",
    "inbox_top": f"WITH {_ROUTE} SELECT replace(replace(source_node, '::', '__'), '/', '_') || '__to__' || replace(replace(target_node, '::', '__'), '/', '_') AS inbox_id, rank, tier FROM ro WHERE action = 'queued'",
    "new_cross_edges": "SELECT DISTINCT edge_id FROM probe_state WHERE CAST(first_seen_at AS TIMESTAMPTZ) >= TIMESTAMPTZ '2025-09-01 00:00:00+00'",
    "split_sentence": _enumerate(_SENT),
    "split_paragraph": _enumerate(r"list_filter(list_transform(regexp_split_to_array(text, '\n[ \t\r]*\n'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"),
    "split_window": _enumerate("list_filter(list_transform(range(0, length(text), 160), lambda p: trim(substr(text, p + 1, 200))), lambda s: s <> '')"),
    "splitter_scores": rf"""WITH {CHUNK}, am AS (SELECT chunk_id AS id, text AS source, unnest({_SENT}) AS atom FROM ch),
m AS (SELECT id, source, atom, greatest(0.0, 1.0 - 0.3 * (len(list_filter(regexp_split_to_array(atom, '[.?!。？！][ \t\r\n]'), lambda s: trim(s) <> '')) - 1) - greatest(0.0, (len(list_filter(regexp_split_to_array(trim(atom), '\s+'), lambda w: w <> '')) - 50) / 100.0)) AS a,
  CASE WHEN regexp_matches(trim(atom), '(?i)^(it|this|that|these|those|they|he|she|its|their)([^\p{{L}}\p{{N}}_]|$)') THEN 0.0 ELSE 1.0 END AS s,
  CASE WHEN len({words("source")}) = 0 THEN 0.0 WHEN len({words("atom")}) = 0 THEN 1.0 ELSE len(list_intersect({words("atom")}, {words("source")})) / len({words("atom")}) END AS f, length(trim(atom)) AS n FROM am),
g AS (SELECT id, count(*) AS atoms, avg(a) AS a, avg(s) AS s, avg(f) AS f, CASE WHEN max(length(trim(source))) = 0 THEN 0.0 ELSE least(1.0, sum(n) / max(length(trim(source)))) END AS c FROM m GROUP BY id)
SELECT id, atoms, round(a, 6) AS atomicity, round(s, 6) AS self_contained, round(f, 6) AS faithfulness, round(c, 6) AS coverage, round((a + s + f + c) / 4, 6) AS overall FROM g""",
    "retrieval_iou": f"""WITH {CHUNK}, q AS (SELECT DISTINCT qa_id, question, coalesce(source_text, '') AS source FROM qa WHERE question IS NOT NULL),
qw AS (SELECT qa_id, unnest({words("question")}) AS w FROM q), cw AS (SELECT chunk_id, unnest({words("text")}) AS w FROM ch), fr AS (SELECT w, 1.0 / count(*) AS weight FROM cw GROUP BY w),
s AS (SELECT qa_id, chunk_id, round(sum(weight), 9) AS score FROM qw JOIN cw USING (w) JOIN fr USING (w) GROUP BY ALL),
h AS (SELECT qa_id, chunk_id FROM s QUALIFY row_number() OVER (PARTITION BY qa_id ORDER BY score DESC, chunk_id) <= 5),
sw AS (SELECT qa_id, unnest({words("source")}) AS w FROM q), sn AS (SELECT qa_id, count(*) AS n FROM sw GROUP BY 1),
r AS (SELECT qa_id, chunk_id FROM (SELECT sw.qa_id, chunk_id, count(*) AS k FROM sw JOIN cw USING (w) GROUP BY ALL) JOIN sn USING (qa_id) WHERE k / n >= 0.3),
u AS (SELECT qa_id, count(*) AS u FROM (SELECT * FROM h UNION SELECT * FROM r) GROUP BY 1), b AS (SELECT qa_id, count(*) AS b FROM (SELECT * FROM h INTERSECT SELECT * FROM r) GROUP BY 1)
SELECT u.qa_id AS query_id, round(coalesce(b, 0) / u, 6) AS iou FROM u LEFT JOIN b ON u.qa_id = b.qa_id""",
    "gold_alignment": f"""WITH q AS (SELECT DISTINCT qa_id, answer, source_text AS text FROM qa WHERE answer IS NOT NULL AND source_text IS NOT NULL), a AS (SELECT qa_id, answer, unnest({_SENT}) AS atom FROM q),
m AS (SELECT qa_id, CASE WHEN len({words("atom")}) + len({words("answer")}) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({words("atom")}, {words("answer")})) / (len({words("atom")}) + len({words("answer")})) END AS f FROM a),
g AS (SELECT qa_id, avg(f) AS p, max(f) AS r FROM m GROUP BY qa_id)
SELECT qa_id AS case_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM g""",
    "quarantined_edges": rf"""WITH {VE}, p AS (SELECT src, dst, tier, score, CASE WHEN NOT coalesce(tier IN ('EXTRACTED', 'INFERRED', 'AMBIGUOUS'), false) THEN 'tier'
  WHEN tier = 'EXTRACTED' AND (starts_with(src, 'conv::') OR starts_with(dst, 'conv::')) THEN 'conversation'
  WHEN score IS NOT NULL AND NOT ((tier = 'EXTRACTED' AND score BETWEEN 0.95 AND 1.0) OR (tier = 'INFERRED' AND score BETWEEN 0.30 AND 0.94) OR (tier = 'AMBIGUOUS' AND score BETWEEN 0.0 AND 0.29)) THEN 'score' END AS problem FROM ve)
SELECT * FROM p WHERE problem IS NOT NULL""",
    "stale_mentions": f"""{GRAPH} SELECT DISTINCT src, list_last(string_split(dst, '::')) AS symbol, dst AS code_node FROM ve WHERE relation = 'mentions_symbol' AND dst IN (SELECT id FROM vn WHERE kind = 'function' AND maturity = 'growing')""",
    "query_entities": r"""WITH q AS (SELECT DISTINCT qa_id, question FROM qa WHERE question IS NOT NULL)
SELECT qa_id, unnest(list_distinct(list_transform(regexp_extract_all(question, '\p{Lu}[\p{L}\p{N}]+(?:[ ]\p{Lu}[\p{L}\p{N}]+)*'), lambda x: lower(x)))) AS entity FROM q""",
    "l1_windows": f"""WITH {CHUNK}, r AS (SELECT *, (row_number() OVER (PARTITION BY source_idx ORDER BY idx, chunk_id) - 1) // 3 AS g FROM ch)
SELECT source_idx AS source, CAST(g AS INTEGER) AS grp, count(*) AS members, string_agg(text, ' ' ORDER BY idx, chunk_id) AS text FROM r GROUP BY source_idx, g""",
    "walk_retrieval": _walks(4),
    "boundary_clarity": f"""WITH {VN}, {VV}, j AS (SELECT vn.namespace, vv.id, vec, lag(vec) OVER (PARTITION BY vn.namespace ORDER BY vv.id) AS b FROM vv JOIN vn ON vv.id = vn.id)
SELECT namespace, count(*) AS n, round(1 - coalesce(avg(CASE WHEN b IS NOT NULL THEN list_cosine_similarity(b, vec) END), 0), 6) AS clarity FROM j GROUP BY namespace""",
    "char_budget": f"""WITH {VN}, r AS (SELECT community_id, id, length(content) AS n, sum(length(content)) OVER (PARTITION BY community_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS used FROM vn WHERE community_id IS NOT NULL AND content IS NOT NULL)
SELECT community_id AS grp, count(CASE WHEN used <= 2000 THEN 1 END) AS kept, count(CASE WHEN used > 2000 THEN 1 END) AS more, CAST(coalesce(sum(CASE WHEN used <= 2000 THEN n END), 0) AS BIGINT) AS chars FROM r GROUP BY 1""",
    "embed_status": f"""WITH {VN}, e AS (SELECT id, content_hash FROM vn WHERE kind IN ('note', 'knowledge', 'image', 'pdf', 'audio', 'function', 'class', 'module') AND trim(content) <> ''),
c AS (SELECT node_id, sha FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY append_seq DESC) AS k FROM embed_cache WHERE node_id IS NOT NULL) WHERE k = 1)
SELECT count(*) AS embeddable, count(CASE WHEN c.sha = e.content_hash THEN 1 END) AS cached, count(*) - count(CASE WHEN c.sha = e.content_hash THEN 1 END) AS pending FROM e LEFT JOIN c ON e.id = c.node_id""",
    "cache_gc": f"WITH {VN} SELECT DISTINCT node_id, sha, append_seq FROM embed_cache c WHERE EXISTS (SELECT 1 FROM vn WHERE vn.id = c.node_id AND sha1(vn.id) = c.sha)",
    "incremental_diff": """WITH v AS (SELECT path, arrived_at, file_seq, CASE WHEN content IS NOT NULL THEN sha256(content) END AS h FROM files WHERE path IS NOT NULL),
b AS (SELECT path, h FROM v WHERE arrived_at < TIMESTAMP '2025-07-01 00:00:00' QUALIFY row_number() OVER (PARTITION BY path ORDER BY arrived_at DESC, file_seq DESC) = 1),
n AS (SELECT path, h FROM v QUALIFY row_number() OVER (PARTITION BY path ORDER BY arrived_at DESC, file_seq DESC) = 1)
SELECT n.path, CASE WHEN b.h IS NULL AND n.h IS NOT NULL THEN 'added' WHEN b.h IS NOT NULL AND n.h IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM n LEFT JOIN b ON n.path = b.path WHERE n.h IS DISTINCT FROM b.h""",
    "deleted_sources": f"WITH {VN}, {_FILES} SELECT id, source_file FROM vn WHERE source_file <> '' AND kind NOT IN ('fact', 'tag', 'category', 'knowledge') AND source_file NOT IN (SELECT path FROM fl)",
    "know_ids": f"WITH {CHUNK} SELECT chunk_id, 'KNOW-' || lpad(CAST(5000 + row_number() OVER (ORDER BY chunk_id) - 1 AS VARCHAR), 6, '0') AS know_id FROM (SELECT DISTINCT chunk_id FROM ch)",
    "dedup_recent": "SELECT log_seq, decision_id, action, claim_title FROM (SELECT DISTINCT log_seq, decision_id, action, claim_title FROM dedup_log) ORDER BY log_seq DESC LIMIT 20",
    "dedup_actions": """SELECT action, coalesce(rollback_status, '') AS rollback_status, count(*) AS n, round(avg(CASE WHEN similarity_score BETWEEN 0 AND 1 THEN similarity_score END), 6) AS mean_score
FROM (SELECT DISTINCT log_seq, action, rollback_status, similarity_score FROM dedup_log WHERE log_seq IS NOT NULL) GROUP BY ALL""",
    "contains_edges": "SELECT src, dst FROM (SELECT parent_id AS src, id AS dst, content FROM tree_nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrived_at DESC, node_seq DESC) = 1) WHERE content IS NOT NULL AND src IS NOT NULL",
    "retrieval_scores": f"""WITH {CHUNK}, q AS (SELECT DISTINCT qa_id, question, answer, source_text FROM qa WHERE question IS NOT NULL),
qw AS (SELECT qa_id, unnest({words("question")}) AS w FROM q), cw AS (SELECT chunk_id, unnest({words("text")}) AS w FROM ch), fr AS (SELECT w, 1.0 / count(*) AS weight FROM cw GROUP BY w),
s AS (SELECT qa_id, chunk_id, round(sum(weight), 9) AS score FROM qw JOIN cw USING (w) JOIN fr USING (w) GROUP BY ALL),
h AS (SELECT s.qa_id, s.chunk_id, row_number() OVER (PARTITION BY s.qa_id ORDER BY score DESC, s.chunk_id) AS rank FROM s QUALIFY rank <= 5),
x AS (SELECT h.qa_id, rank, {overlap("ch.text", "coalesce(q.source_text, '')")} >= 0.3 AS rel, {overlap("ch.text", "coalesce(q.answer, '')")} >= 0.5 AS got FROM h JOIN ch USING (chunk_id) JOIN q USING (qa_id)),
g AS (SELECT qa_id, max(got::INT)::DOUBLE AS recall, sum(rel::INT) / 5 AS p, coalesce(1.0 / min(CASE WHEN rel THEN rank END), 0.0) AS m FROM x GROUP BY qa_id)
SELECT qa_id AS query_id, recall, round(p, 6) AS precision, round(m, 6) AS mrr, round(0.4 * recall + 0.35 * m + 0.25 * p, 6) AS average FROM g""",
}
