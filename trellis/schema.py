"""Vocabularies, score ranges and schemas of the property graph."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: tiers and the score range that a parser's record of each must keep
TIER_RANGE = {"EXTRACTED": (0.95, 1.0), "INFERRED": (0.30, 0.94), "AMBIGUOUS": (0.0, 0.29)}
# fixed values: what one hop of each tier leaves of a path's score
TIER_DECAY = {"EXTRACTED": 1.0, "INFERRED": 0.6, "AMBIGUOUS": 0.2}
TRUSTED = ("EXTRACTED", "INFERRED")
LIFECYCLES = ("probabilistic", "deterministic", "anchored")
RELATION_TYPES = ("supersedes", "superseded_by", "depends_on", "refines", "contradicts", "references")
CONTENT_KINDS = ("note", "knowledge", "function", "class", "module", "flow")
HOME = "nimbus"

NODE = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "label", "kind", "namespace", "source_file", "content")] + [T.StructField("tokens", T.IntegerType())])
EDGE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("src", "dst", "relation", "tier")]
    + [T.StructField("score", T.DoubleType()), T.StructField("weight", T.DoubleType())]
    + [T.StructField(c, T.StringType()) for c in ("source_pass", "lifecycle")]
    + [T.StructField("write_seq", T.LongType())]
)
EMBEDDING = T.StructType([T.StructField("node_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
EMBED_LINE = T.StructType([T.StructField("node_id", T.StringType()), T.StructField("sha", T.StringType()), T.StructField("vec", T.ArrayType(T.FloatType()))])
PROBE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("edge_id", "source_node", "target_node", "edge_kind", "confidence_tier")]
    + [T.StructField("confidence", T.DoubleType())]
    + [T.StructField(c, T.StringType()) for c in ("first_seen_at", "last_seen_at", "last_seen_parsed_at", "source_file")]
    + [T.StructField("consecutive_seen", T.IntegerType()), T.StructField("model_id", T.StringType()), T.StructField("lifecycle_class", T.StringType()), T.StructField("evidence", T.ArrayType(T.StringType()))]
)
INBOX = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "source", "target", "edge_kind")]
    + [T.StructField("confidence", T.DoubleType())]
    + [T.StructField(c, T.StringType()) for c in ("confidence_tier", "model_id")]
    + [T.StructField("top_k_rank", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("status", "created_at", "decided_at", "decided_by", "decision_note")]
)
DEDUP = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("decision_id", "timestamp", "action", "claim_title", "source_doc")]
    + [T.StructField("similarity_score", T.DoubleType())]
    + [T.StructField(c, T.StringType()) for c in ("pre_state", "reused_id", "rollback_status")]
)
