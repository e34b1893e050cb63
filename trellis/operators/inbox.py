"""The review inbox: entries, promotion and approval as edges, listings, and what a routing run did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.operators import probe
from trellis.operators.orphans import strip_ws

RELATION = "mentions_symbol"


def bare(node: Column) -> Column:
    """An id without its namespace."""
    return F.regexp_replace(node, r"(?s)^.*?::", "")


def entries(routed: DataFrame, state: DataFrame, created_at: str) -> DataFrame:
    """Pending entries of queued edges, from the document to the code: one signal per observed edge.

    ``routed`` as from ``probe.route``. Edges of one pair of nodes are one entry, which holds their
    signals; its confidence is the highest, ties by edge.
    """
    s = state.select("edge_id", "edge_kind", "confidence", "confidence_tier", "model_id", "consecutive_seen", "first_seen_at", "last_seen_at")
    q = routed.filter("action = 'queued'").join(s, "edge_id")
    doc, code = strip_ws(F.col("target_node")), F.col("source_node")
    signal = F.struct(F.col("edge_kind").alias("kind"), F.col("confidence").alias("score"), "consecutive_seen", "first_seen_at", F.coalesce("last_seen_at", "first_seen_at").alias("last_seen_at"))
    best = F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), "edge_id", "confidence", "confidence_tier", "model_id", "rank")
    got = q.groupBy(probe.inbox_key(doc, code).alias("id"), doc.alias("source"), code.alias("target")).agg(F.max(best).alias("b"), F.array_sort(F.collect_set(signal)).alias("probe_signals"))
    return got.select(
        "id", "source", "target", F.lit(RELATION).alias("edge_kind"), "b.confidence", "b.confidence_tier", "b.model_id", F.col("b.rank").alias("top_k_rank"), "probe_signals",
        F.lit("pending").alias("status"), F.lit(created_at).alias("created_at"), *[F.lit(None).cast("string").alias(c) for c in ("decided_at", "decided_by", "decision_note")],
    )


def longest_seen(signals: str = "probe_signals") -> Column:
    """The most scans in a row that one of an entry's signals was seen; 0 without signals."""
    return F.coalesce(F.array_max(F.transform(signals, lambda s: F.coalesce(s["consecutive_seen"], F.lit(0)))), F.lit(0))


def pending(inbox: DataFrame, n: int = 10, sort_by: str = "confidence") -> DataFrame:
    """The first n pending entries by confidence, created_at or consecutive_seen, the largest first; ties by id."""
    keys = {"confidence": F.col("confidence"), "created_at": F.col("created_at"), "consecutive_seen": longest_seen()}
    if sort_by not in keys:
        raise ValueError(f"sort_by must be one of {sorted(keys)}")
    return inbox.filter("status = 'pending'").orderBy(F.desc_nulls_last(keys[sort_by]), "id").limit(n)


def listed(inbox: DataFrame, status: str | None = None, n: int = 50) -> DataFrame:
    """The first n entries of a status, or of all, by time of creation and id."""
    rows = inbox if status is None else inbox.filter(F.col("status") == status)
    return rows.orderBy("created_at", "id").limit(n)


def _edge(source: Column, target: Column, score: Column) -> list[Column]:
    return [bare(source).alias("src"), target.alias("dst"), F.lit(RELATION).alias("relation"), F.lit("INFERRED").alias("tier"), score.alias("score"), F.lit(1.0).alias("weight"), F.lit("conv").alias("source_pass"), F.lit("anchored").alias("lifecycle")]


def promoted_edges(routed: DataFrame, state: DataFrame) -> DataFrame:
    """Anchored edges of the automatically promoted observations, from the document to the code, whatever their direction was."""
    p = routed.filter("action = 'auto_promoted'").join(state.select("edge_id", "confidence"), "edge_id")
    return p.select(*_edge(strip_ws(F.col("target_node")), F.col("source_node"), F.col("confidence"))).groupBy("src", "dst", "relation", "tier", "weight", "source_pass", "lifecycle").agg(F.max("score").alias("score")).select("src", "dst", "relation", "tier", "score", "weight", "source_pass", "lifecycle")


def anchor(state: DataFrame, routed: DataFrame) -> DataFrame:
    """Observed state in which promoted edges are anchored, so that later scans and routings leave them."""
    up = routed.filter("action = 'auto_promoted'").select("edge_id", F.lit(True).alias("_up")).distinct()
    return state.join(up, "edge_id", "left").withColumn("lifecycle_class", F.when(F.col("_up"), "anchored").otherwise(F.col("lifecycle_class"))).drop("_up").select(*state.columns)


def approve(inbox: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply (id, status, decided_at, decided_by) to pending entries: the inbox after it, and the anchored edges of what was approved now.

    Other statuses than approved and rejected are refused; entries that are decided stay as they are.
    """
    fine = decisions.filter(F.col("status").isin("approved", "rejected"))
    now = inbox.filter("status = 'pending'").join(fine.filter("status = 'approved'").select("id").distinct(), "id", "left_semi")
    return probe.decide(inbox, fine), now.select(*_edge(F.col("source"), F.col("target"), F.col("confidence")))


def write_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """``edges`` with ``new`` over them: one per pair of nodes, the new one."""
    return edges.join(new.select("src", "dst"), ["src", "dst"], "left_anti").select(*new.columns).unionByName(new)


def counters(routed: DataFrame, inbox: DataFrame) -> DataFrame:
    """One row of a routing run on an inbox: promoted, queued (new entries only), rolled_back (pending entries that fell), discarded (the rest that fell).

    Edges that fell and whose entry is decided count nowhere.
    """
    held = inbox.select(F.col("id").alias("key"), "status").groupBy("key").agg(F.min("status").alias("status"))
    r = routed.withColumn("key", probe.inbox_key(strip_ws(F.col("target_node")), F.col("source_node"))).join(held, "key", "left")
    count = lambda c, name: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).cast("long").alias(name)
    a, s = F.col("action"), F.col("status")
    return r.agg(count(a == "auto_promoted", "promoted"), count((a == "queued") & s.isNull(), "queued"), count((a == "discarded") & (s == "pending"), "rolled_back"), count((a == "discarded") & s.isNull(), "discarded"))


def roll_back(inbox: DataFrame, routed: DataFrame, at: str) -> DataFrame:
    """The inbox after a routing run: pending entries whose edges all fell are discarded."""
    key = probe.inbox_key(strip_ws(F.col("target_node")), F.col("source_node"))
    fell = routed.groupBy(key.alias("id")).agg(F.min((F.col("action") == "discarded").cast("int")).alias("_fell")).filter("_fell = 1")
    now = (F.col("status") == "pending") & F.col("_fell").isNotNull()
    new = {"status": F.lit("discarded"), "decided_at": F.lit(at), "decided_by": F.lit("classifier")}
    return inbox.join(fell, "id", "left").select(*[F.when(now, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in inbox.columns])
