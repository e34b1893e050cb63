"""Observed cross-namespace edges: the state of each edge over repeated scans, tiers, routing, the review inbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PENDING = "MIGRATION_PENDING"
# fixed values: thresholds per embedding model (minimum, consecutive scans, second minimum, margin, cap, consecutive scans)
PROFILES = {
    "default": (0.85, 2, 0.75, 0.25, 5, 2),
    "bge-m3": (0.75, 2, 0.70, 0.25, 5, 2),
    "qwen3": (0.85, 2, 0.78, 0.20, 5, 2),
}


def fold_observations(obs: DataFrame) -> DataFrame:
    """The state after all scans from (edge_id, scan, model_id, confidence), scans being whole numbers.

    A new edge counts 1; another model or a missed scan starts again at 1; the
    confidence is that of the start of the current model's run. An edge that the last
    scan of all did not see counts 0. Returns (edge_id, model_id, confidence,
    first_scan, last_scan, consecutive_seen). Repeated observations in a scan count
    once, the one with the highest confidence. Islands are found with windows over the
    edge's own scans.
    """
    one = obs.filter(F.col("edge_id").isNotNull() & F.col("scan").isNotNull()).groupBy("edge_id", "scan").agg(F.max(F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), "model_id")).alias("m"))
    one = one.select("edge_id", "scan", F.col("m.c").alias("confidence"), F.col("m.model_id").alias("model_id"))
    w = Window.partitionBy("edge_id").orderBy("scan")
    model = ~F.col("model_id").eqNullSafe(F.lag("model_id").over(w)) | F.lag("scan").over(w).isNull()
    steps = one.withColumn("new_model", model.cast("int")).withColumn("break", (model | (F.col("scan") != F.lag("scan").over(w) + 1)).cast("int"))
    runs = steps.withColumn("epoch", F.sum("new_model").over(w)).withColumn("island", F.sum("break").over(w))
    last = runs.groupBy("edge_id").agg(
        F.max(F.struct("island", "epoch", "scan", "model_id")).alias("l"), F.min("scan").alias("first_scan")
    )
    tail = runs.join(last, "edge_id")
    got = tail.groupBy("edge_id", "first_scan", F.col("l.scan").alias("last_scan"), F.col("l.model_id").alias("model_id")).agg(
        F.sum((F.col("island") == F.col("l.island")).cast("int")).alias("run"),
        F.min_by(F.when(F.col("epoch") == F.col("l.epoch"), F.col("confidence")), F.when(F.col("epoch") == F.col("l.epoch"), F.col("scan"))).alias("confidence"),
    )
    final = obs.agg(F.max("scan").alias("final"))
    return got.crossJoin(F.broadcast(final)).select(  # final is one row
        "edge_id", "model_id", "confidence", "first_scan", "last_scan", F.when(F.col("last_scan") == F.col("final"), F.col("run")).otherwise(0).cast("int").alias("consecutive_seen")
    )


def record(state: DataFrame, seen: DataFrame, scan: str, model_id: str, now: str) -> DataFrame:
    """``state`` (one row per edge_id) after one scan that saw the bridges ``seen``.

    ``seen`` has (src_ns, src, dst_ns, dst, relation, tier, weight, source_file). Bridges within a
    namespace are left out; of a bridge seen twice the heaviest counts. An anchored edge keeps
    everything but the time it was seen; a new one starts at 1; one that waits for its first real
    scan (PENDING) takes this scan's values and keeps its count; another model starts again at 1;
    another scan adds 1; the same scan changes nothing. An unknown tier is INFERRED.
    """
    key = F.concat("src_ns", F.lit("::"), "src", F.lit("→"), "dst_ns", F.lit("::"), "dst")
    tier_ = F.when(F.col("tier").isin("EXTRACTED", "INFERRED", "AMBIGUOUS"), F.col("tier")).otherwise("INFERRED")
    new = seen.filter(F.col("src_ns") != F.col("dst_ns")).select(
        key.alias("edge_id"), F.concat_ws("::", "src_ns", "src").alias("n_source"), F.concat_ws("::", "dst_ns", "dst").alias("n_target"), F.coalesce("relation", F.lit("bridge")).alias("n_kind"), tier_.alias("n_tier"), F.coalesce("weight", F.lit(0.7)).alias("n_conf"), F.coalesce("source_file", F.lit("")).alias("n_file"),
    )
    one = new.groupBy("edge_id", "n_source", "n_target").agg(F.max_by(F.struct("n_kind", "n_tier", "n_conf", "n_file"), F.struct("n_conf", "n_kind", "n_tier", "n_file")).alias("n"))
    j = state.withColumn("_old", F.lit(True)).join(one, "edge_id", "full")
    old, hit = F.col("_old").isNotNull(), F.col("n").isNotNull()
    anchored = F.lower("lifecycle_class") == "anchored"
    waits = F.col("last_seen_parsed_at").eqNullSafe(F.lit(PENDING))
    other = ~F.col("model_id").eqNullSafe(F.lit(model_id))
    again = ~F.col("last_seen_parsed_at").eqNullSafe(F.lit(scan))
    free = old & hit & ~F.coalesce(anchored, F.lit(False))
    moved = free & (waits | other | again)
    fresh = free & (waits | other)
    cols = {
        "source_node": F.coalesce("source_node", "n_source"),
        "target_node": F.coalesce("target_node", "n_target"),
        "edge_kind": F.when(old, F.col("edge_kind")).otherwise(F.col("n.n_kind")),
        "confidence_tier": F.when(old, F.col("confidence_tier")).otherwise(F.col("n.n_tier")),
        "confidence": F.when(fresh | ~old, F.col("n.n_conf")).otherwise(F.col("confidence")),
        "first_seen_at": F.when(old, F.col("first_seen_at")).otherwise(F.lit(now)),
        "last_seen_at": F.when(~old | moved | (old & hit & anchored), F.lit(now)).otherwise(F.col("last_seen_at")),
        "last_seen_parsed_at": F.when(~old | moved, F.lit(scan)).otherwise(F.col("last_seen_parsed_at")),
        "source_file": F.when(old, F.col("source_file")).otherwise(F.col("n.n_file")),
        "consecutive_seen": F.when(~old, 1).when(free & ~waits & other, 1).when(free & ~waits & again, F.coalesce("consecutive_seen", F.lit(0)) + 1).otherwise(F.col("consecutive_seen")).cast("int"),
        "model_id": F.when(fresh | ~old, F.lit(model_id)).otherwise(F.col("model_id")),
        "lifecycle_class": F.when(old, F.col("lifecycle_class")).otherwise(F.lit("probabilistic")),
    }
    return j.select(*[cols.get(c, F.col(c)).alias(c) for c in state.columns])


def sweep(state: DataFrame, seen: DataFrame, source_file: str) -> DataFrame:
    """State after a scan of one source file: its probabilistic edges that were not seen count 0. A blank file sweeps nothing."""
    if not source_file.strip():
        return state
    s = seen.select("edge_id", F.lit(True).alias("_seen")).distinct()
    missed = (F.col("source_file") == source_file) & (F.lower("lifecycle_class") == "probabilistic") & F.col("_seen").isNull()
    return state.join(s, "edge_id", "left").withColumn("consecutive_seen", F.when(missed, 0).otherwise(F.col("consecutive_seen"))).drop("_seen")


def ranked_candidates(state: DataFrame, margin: float = 0.25, cap: int = 5) -> DataFrame:
    """Per source node the rank of each edge by confidence, and whether it lies within the margin and cap of the second tier."""
    c = F.coalesce("confidence", F.lit(0.0))
    w = Window.partitionBy("source_node").orderBy(F.desc(c), "edge_id")
    top = F.max(c).over(Window.partitionBy("source_node"))
    r = state.withColumn("rank", F.row_number().over(w)).withColumn("floor", F.round(top * (1 - margin), 9))
    return r.withColumn("candidate", (F.round(c, 9) >= F.col("floor")) & (F.col("rank") <= cap)).drop("floor")


def tier(t1: float, n1: int, t2: float, n2: int) -> Column:
    """Tier 1, 2 or 3 of a ranked state row; anchored and pending rows are 3."""
    c, n, top = F.coalesce("confidence", F.lit(0.0)), F.coalesce("consecutive_seen", F.lit(0)), F.col("rank") == 1
    frozen = (F.lower("lifecycle_class") == "anchored") | (F.col("last_seen_parsed_at") == PENDING)
    return F.when(F.coalesce(frozen, F.lit(False)), 3).when((c >= t1) & top & (n >= n1), 1).when((c >= t2) & (top | (n >= n2)), 2).otherwise(3)


def route(state: DataFrame, profile: tuple = PROFILES["default"]) -> DataFrame:
    """(edge_id, source_node, target_node, rank, tier, action): promoted, queued, or discarded."""
    t1, n1, t2, margin, cap, n2 = profile
    r = ranked_candidates(state, margin, cap).withColumn("tier", tier(t1, n1, t2, n2))
    action = F.when(F.col("tier") == 1, "auto_promoted").when((F.col("tier") == 2) & F.col("candidate"), "queued").otherwise("discarded")
    return r.select("edge_id", "source_node", "target_node", "rank", "tier", action.alias("action"))


def inbox_key(doc: Column, code: Column) -> Column:
    def plain(c: Column) -> Column:
        return F.replace(F.replace(c, F.lit("::"), F.lit("__")), F.lit("/"), F.lit("_"))

    return F.concat(plain(doc), F.lit("__to__"), plain(code))


def decide(inbox: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply (id, status, decided_at, decided_by) to pending entries; decided ones stay as they are."""
    d = decisions.select("id", F.col("status").alias("_s"), F.col("decided_at").alias("_a"), F.col("decided_by").alias("_b"))
    now = (F.col("status") == "pending") & F.col("_s").isNotNull()
    return inbox.join(d, "id", "left").select(
        *[{"status": F.when(now, F.col("_s")).otherwise(F.col("status")).alias("status"), "decided_at": F.when(now, F.col("_a")).otherwise(F.col("decided_at")).alias("decided_at"), "decided_by": F.when(now, F.col("_b")).otherwise(F.col("decided_by")).alias("decided_by")}.get(c, F.col(c)) for c in inbox.columns]
    )


def insert_inbox(inbox: DataFrame, entries: DataFrame) -> DataFrame:
    """Add entries whose id is not there yet; what was decided never comes back."""
    return inbox.unionByName(entries.join(inbox.select("id"), "id", "left_anti"), allowMissingColumns=True)
