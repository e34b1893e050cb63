"""Listings and look-ups on the graph: communities in detail, mention targets, legends, file names, sets of texts, ids of entry."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis import schema
from trellis.operators import graph, retrieve

#: Kinds that a legend of communities counts.
DOC_KINDS = ("note", "knowledge")


def community_detail(nodes: DataFrame, edges: DataFrame, wanted: str, ontology: str | None = None) -> DataFrame:
    """Members of the communities whose id is ``wanted`` or whose label holds it: (community_id, label, id, kind, degree).

    An exact id comes before labels. Degrees are those inside of the community; ``ontology``
    keeps members of that type.
    """
    labels = graph.community_labels(graph.god_nodes(nodes, edges)).withColumnRenamed("label", "name")
    rated = labels.withColumn("p", F.when(F.col("community_id") == wanted, 0).when(F.lower("name").contains(wanted.lower()), 1)).filter("p IS NOT NULL")
    best = rated.agg(F.min("p").alias("p"))
    picked = rated.join(F.broadcast(best), "p").select("community_id", "name")  # best is one row
    inside = graph.with_communities(nodes, edges).filter(F.col("src_c") == F.col("dst_c"))
    m = nodes if ontology is None else nodes.filter(F.col("ontology_type") == ontology)
    got = m.join(picked, "community_id").join(graph.degree(inside), "id", "left")
    return got.select("community_id", F.col("name").alias("label"), "id", "kind", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def mention_targets(nodes: DataFrame, edges: DataFrame, min_score: float = 0.7, tiers: tuple[str, ...] | None = schema.TRUSTED) -> DataFrame:
    """(src, dst, label, kind, signature, tier, score) of code that notes mention; what is no node keeps the last part of its id as label and '?' as kind."""
    m = edges.filter((F.col("relation") == "mentions_symbol") & (F.coalesce("score", F.lit(0.0)) >= min_score))
    if tiers is not None:
        m = m.filter(F.coalesce("tier", F.lit("INFERRED")).isin(*tiers))
    code = nodes.filter(F.col("namespace") == "code").select(F.col("id").alias("dst"), "label", "kind", F.get_json_object("metadata", "$.signature").alias("signature"))
    j = m.select("src", "dst", F.coalesce("tier", F.lit("INFERRED")).alias("tier"), "score").join(code, "dst", "left")
    return j.select("src", "dst", F.coalesce("label", F.substring_index("dst", "::", -1)).alias("label"), F.coalesce("kind", F.lit("?")).alias("kind"), F.coalesce("signature", F.lit("")).alias("signature"), "tier", "score")


def legend(nodes: DataFrame, edges: DataFrame, n: int = 8) -> DataFrame:
    """(community_id, members, hub, rank): the communities of most documents and their document of highest degree; ties by id."""
    docs = nodes.filter(F.col("kind").isin(*DOC_KINDS) & F.col("community_id").isNotNull()).select("id", "label", "community_id")
    d = docs.join(graph.degree(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    hub = F.min_by(F.substring_index("label", "::", -1), F.struct((-F.col("degree")).alias("d"), "id"))
    got = d.groupBy("community_id").agg(F.count("*").alias("members"), hub.alias("hub"))
    top = got.orderBy(F.desc("members"), "community_id").limit(n)
    # at most n rows are left to be numbered
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("members"), "community_id")))


def file_names(files: DataFrame, query: str) -> DataFrame:
    """(path): files whose name, without folders and in any case, holds the query."""
    return files.filter(F.lower(F.element_at(F.split("path", "/"), -1)).contains(query.lower())).select("path")


def capped(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in order, and in ``more`` how many were left out: one row of (more) is told with each."""
    total = rows.agg(F.count("*").alias("_n"))
    top = rows.orderBy(*order).limit(n)
    return top.crossJoin(F.broadcast(total)).withColumn("more", F.greatest(F.lit(0), F.col("_n") - n)).drop("_n")  # total is one row


def covered(parts: DataFrame, whole: DataFrame, group: str, item: str) -> DataFrame:
    """(group, items, missing, complete): whether all items of each group of ``parts`` are in ``whole``; nulls are no items.

    The test of a recovery: a batch whose records are all there was applied before the crash.
    """
    own = parts.filter(F.col(item).isNotNull()).select(group, item).distinct()
    there = whole.filter(F.col(item).isNotNull()).select(item, F.lit(1).alias("_there")).distinct()
    j = own.join(there, item, "left").groupBy(group).agg(F.count("*").alias("items"), F.sum(F.when(F.col("_there").isNull(), 1).otherwise(0)).cast("long").alias("missing"))
    return j.withColumn("complete", F.col("missing") == 0)


def quoted(path: Column) -> Column:
    """A path as part of a link: every byte percent-encoded but letters, digits, '-', '.', '_', '~' and '/'."""
    c = F.url_encode(path)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def source_pass(relation: Column, tier: Column) -> Column:
    """Which pass an edge comes from: code for calls, imports and inheritance, else a model for INFERRED ones, else the parser."""
    return F.when(relation.isin("calls", "imports", "inherits"), "code").when(tier == "INFERRED", "llm").otherwise("ast")


def vault_tree(nodes: DataFrame, namespace: str, vault: str) -> DataFrame:
    """(src, dst): contains edges from the virtual root of a vault to every document, tag and category of it."""
    own = nodes.filter((F.col("namespace") == namespace) & F.col("kind").isin("note", "knowledge", "tag", "category"))
    return own.select(F.lit(f"{namespace}:vault:{vault}").alias("src"), F.col("id").alias("dst"))


def without_extension(query: str) -> str:
    """A query without the file extension at its end; what looks like one but holds '::' belongs to the name."""
    stem, ext = posixpath.splitext(query)
    return stem if ext and "::" not in ext and "/" not in ext and " " not in ext else query


def entries(nodes: DataFrame, query: str, scope: str = "", known: list[str] | None = None) -> DataFrame:
    """Where a query enters several namespaces: (id, namespace, priority), one per namespace in order.

    ``ns::name`` with a known namespace looks there only, first for the id, then for the name. A file
    extension at the end is left off, unless the query as it stands is found. With a ``scope`` only ids beginning with it count.
    """
    rows = nodes.filter(F.col("id").startswith(scope)) if scope else nodes
    first, sep, rest = query.partition("::")
    if sep and first in (known or []):
        own = rows.filter(F.col("namespace") == first)
        direct = own.filter(F.col("id").isin(query, rest)).select("id", "namespace", F.lit(0).alias("priority")).orderBy("id").limit(1)
        named = retrieve.entry_points(own, without_extension(rest), True)
        return direct.unionByName(named.join(direct.select("namespace"), "namespace", "left_anti").select("id", "namespace", "priority"))
    plain = without_extension(query)
    found = retrieve.entry_points(rows, query, True)
    if plain == query:
        return found
    return found.unionByName(retrieve.entry_points(rows, plain, True).join(found.select("namespace"), "namespace", "left_anti").select(*found.columns))
