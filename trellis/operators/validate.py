"""What parsers may write: checks that part rows into valid ones and ones set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis import schema

CONVERSATION = r"conv::|ConvParser"


def edge_problem(evidence: Column | None = None) -> Column:
    """Why an edge may not be written, null if it may: unknown tier, a score outside of its tier's range, or extracted from a conversation."""
    fits = F.lit(False)
    for tier, (lo, hi) in schema.TIER_RANGE.items():
        fits = fits | ((F.col("tier") == tier) & F.col("score").between(lo, hi))
    talk = (F.col("tier") == "EXTRACTED") & (F.col("src").rlike("^conv::") | F.col("dst").rlike("^conv::"))
    if evidence is not None:
        talk = talk | ((F.col("tier") == "EXTRACTED") & F.coalesce(F.exists(evidence, lambda x: x.rlike(CONVERSATION)), F.lit(False)))
    return F.when(~F.coalesce(F.col("tier").isin(*schema.TIER_RANGE), F.lit(False)), "tier").when(talk, "conversation").when(F.col("score").isNotNull() & ~fits, "score")


def check_edges(edges: DataFrame, evidence: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges that may be written, and the others with the column ``problem``."""
    told = edges.withColumn("problem", edge_problem(F.col(evidence) if evidence else None))
    return told.filter("problem IS NULL").drop("problem"), told.filter("problem IS NOT NULL")


def conversation_tier(edges: DataFrame) -> DataFrame:
    """Edges of conversation trees as they may be written: INFERRED at .80."""
    talk = F.col("src").startswith("conv::") | F.col("dst").startswith("conv::")
    return edges.withColumn("tier", F.when(talk, "INFERRED").otherwise(F.col("tier"))).withColumn("score", F.when(talk, 0.8).otherwise(F.col("score")))


def mark_stale(edges: DataFrame, changed: DataFrame, at: str) -> DataFrame:
    """Mentions of changed code nodes (changed: id): (src, symbol, code_node, changed_at), each once."""
    hit = edges.filter("relation = 'mentions_symbol'").join(changed.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    return hit.select("src", F.substring_index("dst", "::", -1).alias("symbol"), F.col("dst").alias("code_node"), F.lit(at).alias("changed_at")).distinct()


def delete_by_source(nodes: DataFrame, edges: DataFrame, source_file: str, namespace: str) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes of one file and without their edges."""
    gone = nodes.filter((F.col("source_file") == source_file) & (F.col("namespace") == namespace)).select("id")
    left = nodes.join(gone, "id", "left_anti")
    return left, edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")


def has_changed(nodes: DataFrame, source_file: str, namespace: str, content_hash: str) -> bool:
    """Whether a file's node has another hash, or none."""
    same = (F.col("source_file") == source_file) & (F.col("namespace") == namespace) & (F.col("content_hash") == content_hash)
    return nodes.filter(same).isEmpty()
