"""Registered queries of the general data-pipeline problems (3 and 5), with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.operators import incremental, orphans
from trellis.session import table


def p3_found(spark, d):
    got = orphans.orphan_references(table(spark, d, "edges"), table(spark, d, "probe_state"), table(spark, d, "nodes"))
    return got.select("ref_table", "ref_key", "period").distinct()


def p3_report(spark, d):
    return orphans.orphan_report(table(spark, d, "edges"), table(spark, d, "probe_state"), table(spark, d, "nodes"))


def p5_found(spark, d):
    return incremental.changed_records(table(spark, d, "files"), table(spark, d, "tree_nodes"), table(spark, d, "nodes"), table(spark, d, "ingest_runs"))


def p5_ledger(spark, d):
    runs = table(spark, d, "ingest_runs")
    parts = [("files", "file_seq", "arrived_at"), ("tree_nodes", "node_seq", "arrived_at"), ("nodes", "seq", "written_at")]
    out = [incremental.run_ledger(table(spark, d, t), runs, s, at).select("run_no", F.lit(t).alias("rec_table"), "lo", "hi") for t, s, at in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p5_found": p5_found, "p5_ledger": p5_ledger}

_REFS = r"""
refs AS (
  SELECT 'edges' AS ref_table, CAST(write_seq AS VARCHAR) AS ref_key,
    regexp_replace(CASE WHEN lower(trim(relation)) = 'links_to_section' THEN split_part(dst, '#', 1)
         WHEN lower(trim(relation)) = 'links_to_block' THEN split_part(dst, '^', 1) ELSE dst END, '^\s+|\s+$', '', 'g') AS target,
    written_at AS t
  FROM edges
  UNION ALL
  SELECT 'probe_state', edge_id, regexp_replace(target_node, '^\s+|\s+$', '', 'g'),
    date_trunc('second', CAST(first_seen_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC')
  FROM probe_state),
state AS (
  SELECT id, arg_max(namespace, seq) AS ns, max(seq) AS s, min(written_at) AS first_at FROM nodes GROUP BY id),
gone AS (SELECT DISTINCT n.id FROM nodes n JOIN state s ON n.id = s.id AND n.seq = s.s WHERE n.removed_at IS NOT NULL),
parent AS (
  SELECT 'edges' AS ref_table, s.id AS target, g.id IS NOT NULL AS gone, first_at FROM state s LEFT JOIN gone g ON s.id = g.id
  UNION ALL
  SELECT 'probe_state', CASE WHEN starts_with(s.id, ns || '::') THEN s.id ELSE ns || '::' || s.id END, g.id IS NOT NULL, first_at
  FROM state s LEFT JOIN gone g ON s.id = g.id),
judged AS (
  SELECT DISTINCT r.ref_table, r.ref_key, strftime(r.t, '%Y-%m') AS period,
    CASE WHEN p.target IS NULL THEN 'missing' WHEN p.gone THEN 'removed' WHEN p.first_at > r.t THEN 'later' END AS reason
  FROM refs r LEFT JOIN parent p ON r.ref_table = p.ref_table AND r.target = p.target
  WHERE r.target IS NOT NULL AND r.target <> '')
"""

_VERSIONS = r"""
v AS (
  SELECT 'files' AS rec_table, path AS rec_key, arrived_at AS t, file_seq AS s, CASE WHEN content IS NOT NULL THEN sha256(content) END AS state FROM files
  UNION ALL SELECT 'tree_nodes', id, arrived_at, node_seq, CASE WHEN content IS NOT NULL THEN sha256(content) END FROM tree_nodes
  UNION ALL SELECT 'nodes', id, written_at, seq, CASE WHEN removed_at IS NULL THEN sha256(coalesce(content, '')) || coalesce('=' || source_file, '-') END FROM nodes),
ok AS (SELECT run_no, started_at FROM ingest_runs WHERE lower(trim(status)) = 'success')
"""

SQL = {
    "p3_found": f"WITH {_REFS} SELECT DISTINCT ref_table, ref_key, period FROM judged WHERE reason IS NOT NULL",
    "p3_report": f"""WITH {_REFS} SELECT ref_table, period, count(DISTINCT ref_key) AS refs,
  count(DISTINCT CASE WHEN reason IS NOT NULL THEN ref_key END) AS orphans,
  count(DISTINCT CASE WHEN reason = 'missing' THEN ref_key END) AS missing,
  count(DISTINCT CASE WHEN reason = 'removed' THEN ref_key END) AS removed,
  count(DISTINCT CASE WHEN reason = 'later' THEN ref_key END) AS later
FROM judged GROUP BY ref_table, period""",
    "p5_found": f"""WITH {_VERSIONS},
seen AS (SELECT o.run_no, o.started_at, v.rec_table, v.rec_key, v.state,
    row_number() OVER (PARTITION BY o.run_no, v.rec_table, v.rec_key ORDER BY v.t DESC, v.s DESC) AS k
  FROM ok o JOIN v ON v.t < o.started_at),
st AS (SELECT run_no, rec_table, rec_key, state FROM seen WHERE k = 1),
nxt AS (SELECT run_no, lag(run_no) OVER (ORDER BY started_at) AS prev FROM ok)
SELECT a.run_no, a.rec_table, a.rec_key FROM st a JOIN nxt n ON a.run_no = n.run_no
LEFT JOIN st b ON b.run_no = n.prev AND b.rec_table = a.rec_table AND b.rec_key = a.rec_key
WHERE n.prev IS NOT NULL AND a.state IS NOT NULL AND (b.state IS NULL OR a.state <> b.state)""",
    "p5_ledger": f"""WITH {_VERSIONS},
r AS (SELECT DISTINCT v.rec_table, v.s, (SELECT min_by(o.run_no, o.started_at) FROM ok o WHERE o.started_at > v.t) AS run_no FROM v),
g AS (SELECT rec_table, run_no, s, s - row_number() OVER (PARTITION BY rec_table, run_no ORDER BY s) AS k FROM r WHERE run_no IS NOT NULL)
SELECT run_no, rec_table, min(s) AS lo, max(s) AS hi FROM g GROUP BY rec_table, run_no, k""",
}
