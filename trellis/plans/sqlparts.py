"""Common table expressions shared by the SQL twins."""

VN = r"vn AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM nodes WHERE id IS NOT NULL) WHERE k = 1 AND removed_at IS NULL)"
VE = r"""te AS (SELECT regexp_replace(src, '^\s+|\s+$', '', 'g') AS src, regexp_replace(dst, '^\s+|\s+$', '', 'g') AS dst, lower(regexp_replace(relation, '^\s+|\s+$', '', 'g')) AS relation,
  tier, score, weight, source_pass, lifecycle, write_seq FROM edges),
ve AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY write_seq DESC) AS k FROM te WHERE src <> '' AND dst <> '') WHERE k = 1)"""
GRAPH = f"WITH {VN},\n{VE}"
PASS = "coalesce(score, 1.0) >= {least} AND coalesce(tier, 'EXTRACTED') IN ('EXTRACTED', 'INFERRED')"
VV = r"""lv AS (SELECT node_id AS id, vec::DOUBLE[] AS vec FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY append_seq DESC) AS k FROM embed_cache WHERE node_id IS NOT NULL) WHERE k = 1 AND len(vec) = 64),
vv AS (SELECT id, vec FROM lv WHERE len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0)"""
CHUNK = "ch AS (SELECT DISTINCT chunk_id, source_idx, idx, text, title FROM chunks WHERE text IS NOT NULL)"
WORD = r"[\p{L}\p{N}_]+"


def words(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '{WORD}'))"


def overlap(a: str, b: str) -> str:
    """The share of b's words found in a."""
    return f"(CASE WHEN len({words(b)}) = 0 THEN 0.0 ELSE len(list_intersect({words(a)}, {words(b)})) / len({words(b)}) END)"
