"""References to records that do not exist (problem 3).

Distinct non-null foreign keys are checked once against the parent keys (an
anti-join that also keeps removed and not-yet-written parents), and only the
offending keys are joined back to the references.

Scale: references are first reduced to one row per key with its earliest time
(combined on the map side), so a key that holds a third of all references is one
row in the join with the parents. The join back is salted: the offending keys,
a small share, are repeated ``salt`` times and the references of one key are
spread over as many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.clock import iso_micros, micros_of, month_of

SALT = 16


def strip_ws(c: Column) -> Column:
    """Trim every outer white-space character, Unicode ones included."""
    return F.regexp_replace(c, r"(?U)^[\s\x{200B}\x{FEFF}]+|[\s\x{200B}\x{FEFF}]+$", "")


def bare_target(dst: Column, relation: Column) -> Column:
    """The id in a link target: the anchor of section and block links is cut off."""
    rel = F.lower(strip_ws(relation))
    cut = (
        F.when(rel == "links_to_section", F.substring_index(dst, "#", 1))
        .when(rel == "links_to_block", F.substring_index(dst, "^", 1))
        .otherwise(dst)
    )
    return strip_ws(cut)


def references(edges: DataFrame, probe_state: DataFrame) -> DataFrame:
    """(ref_table, ref_key, target, ref_us) of both referring tables; null and blank targets are none."""
    e = edges.select(
        F.lit("edges").alias("ref_table"),
        F.col("write_seq").cast("string").alias("ref_key"),
        bare_target(F.col("dst"), F.col("relation")).alias("target"),
        micros_of("written_at").alias("ref_us"),
    )
    p = probe_state.select(
        F.lit("probe_state").alias("ref_table"),
        F.col("edge_id").alias("ref_key"),
        strip_ws(F.col("target_node")).alias("target"),
        iso_micros(F.col("first_seen_at"), whole_seconds=True).alias("ref_us"),
    )
    return e.unionByName(p).filter(F.col("target").isNotNull() & (F.col("target") != ""))


def parents(nodes: DataFrame) -> DataFrame:
    """One row per (ref_table, target) that exists: whether its last row removes it, and its first time.

    ``edges`` name a node by its id, ``probe_state`` by ``namespace::id`` unless the
    id already starts with its namespace.
    """
    per_id = (
        nodes.filter(F.col("id").isNotNull())
        .select("id", "namespace", "seq", F.col("removed_at").isNotNull().alias("gone"), micros_of("written_at").alias("us"))
        .groupBy("id")
        .agg(F.max(F.struct(F.coalesce("seq", F.lit(-1)).alias("seq"), "gone", "namespace")).alias("last"), F.min("us").alias("first_us"))
    )
    prefix = F.concat(F.col("last.namespace"), F.lit("::"))
    full = F.when(F.col("last.namespace").isNull() | F.col("id").startswith(prefix), F.col("id")).otherwise(F.concat(prefix, F.col("id")))
    named = F.explode(F.array(F.struct(F.lit("edges").alias("ref_table"), F.col("id").alias("target")), F.struct(F.lit("probe_state").alias("ref_table"), full.alias("target"))))
    flat = per_id.select(named.alias("n"), F.col("last.gone").alias("gone"), "first_us").select("n.ref_table", "n.target", "gone", "first_us")
    return flat.groupBy("ref_table", "target").agg(F.min("gone").alias("gone"), F.min("first_us").alias("first_us"))


def orphan_references(edges: DataFrame, probe_state: DataFrame, nodes: DataFrame, salt: int = SALT) -> DataFrame:
    """References whose target is missing, removed or written later than the reference.

    Returns (ref_table, ref_key, period, reason): reason is ``missing``,
    ``removed`` or ``later``; period is the month of the reference, null where its
    time is. Null and blank targets are no references, repeated rows count once,
    an empty parent table makes every reference an orphan, further columns are
    ignored. A reference without a time cannot be earlier than its target.
    """
    refs = references(edges, probe_state)
    keys = refs.groupBy("ref_table", "target").agg(F.min("ref_us").alias("least_us"))
    bad = (
        keys.join(parents(nodes), ["ref_table", "target"], "left")
        .filter(F.col("gone").isNull() | F.col("gone") | (F.col("first_us") > F.col("least_us")))
        .select(
            "ref_table",
            "target",
            F.when(F.col("gone").isNull(), "missing").when(F.col("gone"), "removed").otherwise("later").alias("reason"),
            "first_us",
            F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("salt"),
        )
    )
    salted = refs.withColumn("salt", F.pmod(F.xxhash64("ref_key", "ref_us"), F.lit(salt)).cast("int"))
    hit = salted.join(bad, ["ref_table", "target", "salt"]).filter((F.col("reason") != "later") | (F.col("first_us") > F.col("ref_us")))
    return hit.select("ref_table", "ref_key", month_of(F.col("ref_us")).alias("period"), "reason").distinct()


def orphan_report(edges: DataFrame, probe_state: DataFrame, nodes: DataFrame) -> DataFrame:
    """Orphans and all references per table and month (null month: references without a time)."""
    orphans = orphan_references(edges, probe_state, nodes)
    bad = orphans.groupBy("ref_table", "period").agg(
        F.count("*").alias("orphans"),
        *[F.sum(F.when(F.col("reason") == r, 1).otherwise(0)).alias(r) for r in ("missing", "removed", "later")],
    )
    everything = references(edges, probe_state).select("ref_table", "ref_key", month_of(F.col("ref_us")).alias("period")).distinct()
    total = everything.groupBy("ref_table", "period").agg(F.count("*").alias("refs"))
    on = total["ref_table"].eqNullSafe(bad["ref_table"]) & total["period"].eqNullSafe(bad["period"])
    return total.join(bad, on, "left").select(
        total["ref_table"], total["period"], "refs", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("orphans", "missing", "removed", "later")]
    )
