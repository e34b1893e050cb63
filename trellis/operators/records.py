"""State tables kept as logs: embedding cache, files, probe state, deduplication decisions, allocated ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions.clock import iso_micros
from trellis.session import cut


def last_by(rows: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    """The last row per key in the order given, nulls first: (key, columns...). One partial aggregation, no sort."""
    o = F.struct(*order)
    last = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), o).alias("v"))
    return last.select(key, *[F.col(f"v.{c}").alias(c) for c in columns])


def last_vectors(cache: DataFrame, dim: int = 64) -> DataFrame:
    """(node_id, vec) of the last line per node whose vector can be used: right length, no null or NaN, not all zero."""
    v = F.col("vec")
    ok = v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return last_by(cache, "node_id", ["append_seq"], "vec").filter(F.coalesce(ok, F.lit(False)))


def last_files(files: DataFrame) -> DataFrame:
    """(path, content) of the last arrival per path unless it is a deletion."""
    return last_by(files, "path", ["arrived_at", "file_seq"], "content").filter(F.col("content").isNotNull())


def distinct_probe(state: DataFrame) -> DataFrame:
    cols = ("edge_id", "source_node", "target_node", "confidence", "consecutive_seen", "lifecycle_class", "last_seen_parsed_at")
    return state.filter(F.col("edge_id").isNotNull()).select(*cols).distinct()


def first_seen_since(state: DataFrame, since: str) -> DataFrame:
    """Edges first seen at or after a time, whatever the notation of theirs."""
    return state.filter(iso_micros(F.col("first_seen_at")) >= iso_micros(F.lit(since))).select("edge_id", "source_node", "target_node").distinct()


# fixed values: kinds of nodes whose content is worth a vector
EMBEDDABLE = ("note", "knowledge", "image", "pdf", "audio", "function", "class", "module")


def embeddable(nodes: DataFrame) -> DataFrame:
    """Nodes of the embeddable kinds with content, but those whose ``metadata`` (JSON, a column that may be missing) says embed: false."""
    rows = nodes.filter(F.col("kind").isin(*EMBEDDABLE) & (F.trim("content") != ""))
    return rows.filter(~F.get_json_object("metadata", "$.embed").eqNullSafe(F.lit("false"))) if "metadata" in nodes.columns else rows


def embed_status(nodes: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: embeddable nodes, those whose last cached line has their hash, and the rest."""
    c = last_by(cache, "node_id", ["append_seq"], "sha")
    j = embeddable(nodes).join(c, F.col("id") == F.col("node_id"), "left")
    hit = F.coalesce(F.col("sha") == F.col("content_hash"), F.lit(False)).cast("long")
    return j.agg(F.count("*").alias("embeddable"), F.coalesce(F.sum(hit), F.lit(0)).cast("long").alias("cached")).select("embeddable", "cached", (F.col("embeddable") - F.col("cached")).alias("pending"))


def live_cache(cache: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cache lines whose node still has the hash they were made for."""
    live = nodes.select(F.col("id").alias("node_id"), F.col("content_hash").alias("sha"))
    return cache.join(live, ["node_id", "sha"], "left_semi").dropDuplicates(["node_id", "sha", "append_seq"])


def diff_files(files: DataFrame, since: str) -> DataFrame:
    """(path, change): what was added, changed or deleted since a time, by the bytes of the content."""
    h = files.withColumn("h", F.sha2(F.col("content").cast("binary"), 256))
    order = ["arrived_at", "file_seq"]
    now = last_by(h, "path", order, "h")
    then = last_by(h.filter(F.col("arrived_at") < F.lit(since).cast("timestamp_ntz")), "path", order, "h").withColumnRenamed("h", "before")
    change = F.when(F.col("before").isNull() & F.col("h").isNotNull(), "added").when(F.col("before").isNotNull() & F.col("h").isNull(), "deleted").otherwise("changed")
    return now.join(then, "path", "left").filter(~F.col("h").eqNullSafe(F.col("before"))).select("path", change.alias("change"))


def without_source(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes of files that are gone."""
    own = nodes.filter((F.col("source_file") != "") & ~F.col("kind").isin("fact", "tag", "category", "knowledge"))
    return own.join(files.select(F.col("path").alias("source_file")), "source_file", "left_anti")


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "n") -> DataFrame:
    """``rows`` with their number from 1 within ``by`` in the order given, without putting a whole group in order in one task.

    Rows are spread by ranges of (by, order) and numbered within their range; how many rows of a group
    lie in the ranges before, one number per range and group, is added. A group of a third of all
    rows lies in as many ranges as its size asks for; rows that tie in the whole order keep together.
    """
    keys = [*by, *order]
    # written once, so that both uses below see the same ranges
    ranged = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    local = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)))
    sizes = ranged.groupBy("_part", *by).agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_size")) if by else sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size"))
    renamed = before.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_before")
    on = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return local.join(renamed, on).select(*rows.columns, (F.col("_n") + F.col("_before")).cast("long").alias(name))


def allocate_ids(rows: DataFrame, key: str, first: int, prefix: str = "KNOW", width: int = 6) -> DataFrame:
    """(key, know_id): consecutive ids in the order of the key, null keys left out."""
    one = rows.select(key).filter(F.col(key).isNotNull()).distinct()
    return numbered(one, [], [key]).select(key, F.format_string(f"{prefix}-%0{width}d", F.col("n") - 1 + first).alias("know_id"))


def recent_decisions(log: DataFrame, n: int = 10) -> DataFrame:
    return log.select("log_seq", "decision_id", "action", "claim_title").distinct().orderBy(F.desc("log_seq")).limit(n)


def decision_summary(log: DataFrame) -> DataFrame:
    """Decisions by action and rollback: count, and the mean of the scores that lie within 0 and 1."""
    one = log.filter(F.col("log_seq").isNotNull()).select("log_seq", "action", "rollback_status", "similarity_score").distinct()
    s = F.when(F.col("similarity_score").between(0, 1), F.col("similarity_score"))
    return one.groupBy("action", F.coalesce("rollback_status", F.lit("")).alias("rollback_status")).agg(F.count("*").alias("n"), F.round(F.avg(s), 6).alias("mean_score"))


def contains_edges(tree: DataFrame) -> DataFrame:
    """(src, dst) from each valid tree node's parent to it."""
    last = last_by(tree, "id", ["arrived_at", "node_seq"], "parent_id", "content")
    return last.filter(F.col("content").isNotNull() & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("src"), F.col("id").alias("dst"))


def roll_back(log: DataFrame, edges: DataFrame, decision_id: str) -> tuple[DataFrame, DataFrame]:
    """Undo a reuse decision: its mention edges go, the decision is marked. A decision that was rolled back stays so."""
    hit = log.filter((F.col("decision_id") == decision_id) & F.col("rollback_status").isNull()).select(F.col("source_doc").alias("src"), F.col("reused_id").alias("dst"))
    gone = hit.withColumn("_gone", F.lit(True))
    left = edges.join(gone, ["src", "dst"], "left").filter(F.col("_gone").isNull() | (F.col("source_pass") != "dedup")).drop("_gone")
    mark = (F.col("decision_id") == decision_id) & F.col("rollback_status").isNull()
    return log.withColumn("rollback_status", F.when(mark, "rolled_back").otherwise(F.col("rollback_status"))), left
