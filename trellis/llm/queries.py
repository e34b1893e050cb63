"""Registered queries of the training-data problems and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.llm import bpe, funcdoc, fuzzy, history, leak, markup, neighbours, residue
from trellis.session import table


def _records(spark, d):
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("rec_table"), F.col("chunk_id").alias("id"), "text")
    claims = table(spark, d, "dedup_log").select(F.lit("dedup_log").alias("rec_table"), F.col("log_seq").alias("id"), F.col("claim_title").alias("text"))
    return chunks.unionByName(claims)


def p1_found(spark, d):
    return fuzzy.alike_pairs(_records(spark, d))


def p1_links(spark, d):
    return fuzzy.alike_report(_records(spark, d))


def p2_found(spark, d):
    chunks = table(spark, d, "chunks").select("chunk_id", "text", "batch_no")
    store = history.new_store(spark)
    history.begin(store, chunks.filter("batch_no = 0"))
    return history.dedup_batches(store, chunks.filter("batch_no > 0"))


def p4_found(spark, d):
    vectors = neighbours.valid_vectors(table(spark, d, "embed_cache"))
    best = neighbours.nearest(vectors, k=5, least=0.8)
    return best.select(F.least("node_id", "other").alias("node_a"), F.greatest("node_id", "other").alias("node_b")).distinct()


def _vault(spark, d):
    return markup.vault_rows(table(spark, d, "files"), table(spark, d, "tree_nodes"))


def p6_found(spark, d):
    got = markup.clean_documents(_vault(spark, d))
    return got.select("rec_table", "rec_seq", F.explode("markups").alias("markup")).distinct()


def p6_clean(spark, d):
    return markup.clean_documents(_vault(spark, d)).select("rec_table", "rec_seq", "clean").distinct()


def _pairs(spark, d):
    return funcdoc.function_docs(table(spark, d, "tree_nodes"), table(spark, d, "nodes").select("id", "kind", "seq"))


def p7_found(spark, d):
    return _pairs(spark, d).select("node_seq")


def p7_pairs(spark, d):
    return _pairs(spark, d)


def p8_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", bpe.token_ids(F.col("text")).alias("ids"))


def p9_found(spark, d):
    return leak.leaks(table(spark, d, "documents"), table(spark, d, "qa")).select("doc_id", "qa_id")


def p9_passages(spark, d):
    return leak.leaks(table(spark, d, "documents"), table(spark, d, "qa"))


def p10_found(spark, d):
    return residue.residue(table(spark, d, "documents")).select("doc_id")


def p10_reasons(spark, d):
    return residue.residue(table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p1_links": p1_links, "p2_found": p2_found, "p4_found": p4_found, "p6_found": p6_found, "p6_clean": p6_clean, "p7_found": p7_found, "p7_pairs": p7_pairs, "p8_ids": p8_ids, "p9_found": p9_found, "p9_passages": p9_passages, "p10_found": p10_found, "p10_reasons": p10_reasons}

_GRAMS = r"""
rec AS (
  SELECT DISTINCT 'chunks' AS rec_table, chunk_id AS id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM chunks
  UNION SELECT 'dedup_log', log_seq, trim(regexp_replace(lower(claim_title), '[^\p{L}\p{N}]+', ' ', 'g')) FROM dedup_log),
g AS (SELECT DISTINCT rec_table, id, unnest(list_transform(range(1, length(norm) - 2), lambda i: substr(norm, i, 4))) AS g FROM rec WHERE length(norm) >= 4),
n AS (SELECT rec_table, id, count(*) AS n FROM g GROUP BY ALL),
i AS (SELECT a.rec_table, a.id AS id_a, b.id AS id_b, count(*) AS k FROM g a JOIN g b ON a.rec_table = b.rec_table AND a.g = b.g AND a.id < b.id GROUP BY ALL),
alike AS (SELECT i.rec_table, id_a, id_b FROM i JOIN n x ON i.rec_table = x.rec_table AND id_a = x.id JOIN n y ON i.rec_table = y.rec_table AND id_b = y.id
  WHERE k >= 0.70 * (x.n + y.n - k))
"""

SQL = {
    "p1_found": f"WITH {_GRAMS} SELECT rec_table, id_a, id_b FROM alike",
    "p1_links": f"""WITH {_GRAMS},
cl AS (SELECT rec_table, norm, min(id) AS class_id FROM rec WHERE norm IS NOT NULL AND id IS NOT NULL GROUP BY ALL),
mem AS (SELECT r.rec_table, r.id, c.class_id FROM rec r JOIN cl c ON r.rec_table = c.rec_table AND r.norm = c.norm),
lk AS (SELECT a.rec_table, x.class_id AS p, y.class_id AS q FROM alike a JOIN mem x ON a.rec_table = x.rec_table AND a.id_a = x.id JOIN mem y ON a.rec_table = y.rec_table AND a.id_b = y.id WHERE x.class_id <> y.class_id),
n2 AS (SELECT rec_table, p, count(DISTINCT q) AS n FROM (SELECT * FROM lk UNION SELECT rec_table, q, p FROM lk) GROUP BY ALL)
SELECT mem.rec_table, id, class_id, coalesce(n, 0) AS links FROM mem LEFT JOIN n2 ON mem.rec_table = n2.rec_table AND class_id = p""",
    "p4_found": r"""
WITH l AS (SELECT node_id, vec FROM (SELECT DISTINCT node_id, vec, append_seq FROM embed_cache) QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY append_seq DESC) = 1),
v AS (SELECT node_id, vec::DOUBLE[] AS vec FROM l WHERE len(vec) = 64 AND len(list_filter(vec, lambda x: isnan(x) OR x IS NULL)) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
p AS (SELECT a.node_id AS a, b.node_id AS b, list_cosine_similarity(a.vec, b.vec) AS c FROM v a JOIN v b ON a.node_id <> b.node_id),
t AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY round(c, 12) DESC, b) AS k FROM p)
SELECT DISTINCT least(a, b) AS node_a, greatest(a, b) AS node_b FROM t WHERE k <= 5 AND c >= 0.8""",
}
