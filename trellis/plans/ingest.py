"""From a folder to a graph: extraction of a vault, union of namespaces, incremental runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis import schema
from trellis.functions import text
from trellis.operators import link
from trellis.operators.graph import qualify
from trellis.session import cut
from trellis.sources import files, state

#: Edges of a document in the order in which a later one replaces an earlier one of the same pair.
STAGES = ("wikilink", "tag", "category", "relation", "tag_co")


def _json_list(front, key: str):
    """A list under a key of the front matter; one value counts as a list of one."""
    many = F.from_json(F.get_json_object(front, f"$.{key}"), "array<string>")
    one = F.get_json_object(front, f"$.{key}")
    return F.coalesce(many, F.when(one.isNotNull() & ~one.startswith("["), F.array(one)), F.array().cast("array<string>"))


def vault_nodes(docs: DataFrame, namespace: str = schema.HOME) -> DataFrame:
    """One node per document (path, front, body, content_hash)."""
    front = F.col("front")
    get = lambda k: F.get_json_object(front, f"$.{k}")
    inline = text.inline_tags(F.col("body"))
    return docs.select(
        files.document_id(F.col("path"), front).alias("id"), text.knowledge_label(get("title"), text.file_stem(F.col("path"))).alias("label"), F.when(get("knowledge_id").isNotNull(), "knowledge").otherwise("note").alias("kind"),
        F.lit(namespace).alias("namespace"), F.col("path").alias("source_file"), F.col("body").alias("content"), "content_hash", text.estimate_tokens(F.col("body")).alias("tokens"), get("knowledge_id").alias("knowledge_id"), F.coalesce(get("canonical") == "true", F.lit(False)).alias("canonical"),
        _json_list(front, "aliases").alias("aliases"), F.array_union(_json_list(front, "tags"), inline).alias("tags"), get("category").alias("category"), F.from_json(get("relations"), "map<string,string>").alias("_rel"), "front",
    ).withColumn("relations", F.transform_values("_rel", lambda k, v: F.coalesce(F.from_json(v, "array<string>"), F.array(v)))).drop("_rel", "front")


def vault_graph(docs: DataFrame, namespace: str = schema.HOME) -> tuple[DataFrame, DataFrame]:
    """Nodes (documents, tags, categories) and edges of a vault; of several edges of a pair the last stage wins."""
    n = cut(vault_nodes(docs, namespace))
    index = cut(link.name_index(n))
    tags = n.select("id", F.explode("tags").alias("tag")).filter(F.col("tag").isNotNull())

    def edge(df: DataFrame, stage: str, tier: str = "EXTRACTED", score: float = 1.0) -> DataFrame:
        return df.select("src", "dst", "relation", F.lit(tier).alias("tier"), F.lit(score).alias("score"), F.lit(1.0).alias("weight"), F.lit("ast").alias("source_pass"), F.lit("deterministic").alias("lifecycle"), F.lit(STAGES.index(stage)).cast("long").alias("write_seq"))

    pairs = link.tag_pairs(n).select(F.concat(F.lit("tag:"), "tag_a").alias("a"), F.concat(F.lit("tag:"), "tag_b").alias("b"))
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"))).withColumn("relation", F.lit("tag_co"))
    edges = (
        edge(link.resolve_links(link.wikilinks(n), index), "wikilink")
        .unionByName(edge(tags.select(F.col("id").alias("src"), F.concat(F.lit("tag:"), "tag").alias("dst"), F.lit("tagged_as").alias("relation")), "tag"))
        .unionByName(edge(n.filter("category IS NOT NULL").select(F.col("id").alias("src"), F.concat(F.lit("category:"), "category").alias("dst"), F.lit("categorized_as").alias("relation")), "category"))
        .unionByName(edge(link.typed_relations(n, index), "relation"))
        .unionByName(edge(both, "tag_co", "INFERRED", 0.7))
    )
    rest = ("relation", "tier", "score", "weight", "source_pass", "lifecycle", "write_seq")
    last = edges.groupBy("src", "dst").agg(F.max_by(F.struct(*rest), F.struct("write_seq", "relation")).alias("v")).select("src", "dst", *[F.col(f"v.{c}").alias(c) for c in rest])
    shared = tags.select(F.concat(F.lit("tag:"), "tag").alias("id"), F.col("tag").alias("label"), F.lit("tag").alias("kind")).unionByName(
        n.filter("category IS NOT NULL").select(F.concat(F.lit("category:"), "category").alias("id"), F.col("category").alias("label"), F.lit("category").alias("kind"))
    )
    return n.unionByName(shared.distinct().withColumn("namespace", F.lit(namespace)), allowMissingColumns=True), last


def unified(parts: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of several namespaces with qualified ids."""
    known = sorted(parts)
    nodes = edges = None
    for ns, (n, e) in sorted(parts.items()):
        q = lambda c: qualify(F.col(c), F.lit(ns), known)  # noqa: E731, B023
        a, b = n.withColumn("id", q("id")), e.withColumn("src", q("src")).withColumn("dst", q("dst"))
        nodes = a if nodes is None else nodes.unionByName(a, allowMissingColumns=True)
        edges = b if edges is None else edges.unionByName(b, allowMissingColumns=True)
    return nodes, edges


def ingest(spark, root: str, store: str, namespace: str = schema.HOME) -> int:
    """Read a vault and save its graph as a new version."""
    docs = files.documents(files.read_texts(spark, root))
    nodes, edges = vault_graph(docs, namespace)
    return state.save_graph(nodes, edges, store)


def ingest_changes(spark, root: str, store: str, namespace: str = schema.HOME) -> tuple[int, int]:
    """Save a new version in which only changed documents are extracted again: (version, documents changed or gone).

    Old edges of a changed document and of a deleted one go; links are resolved over all names.
    """
    docs = cut(files.documents(files.read_texts(spark, root)))
    old_nodes, old_edges = state.load_graph(spark, store)
    before = old_nodes.filter(F.col("source_file").isNotNull()).select("id", F.col("source_file").alias("path"), F.col("content_hash").alias("old"))
    d = docs.select("path", "content_hash").join(before, "path", "full").filter(~F.col("content_hash").eqNullSafe(F.col("old")))
    changed = cut(d.select("path", "id"))
    n = changed.count()
    if not n:
        return state.current_version(spark, store), 0
    new_nodes, new_edges = vault_graph(docs, namespace)
    touched = changed.filter("id IS NOT NULL").select(F.col("id").alias("src")).union(new_nodes.join(changed.select(F.col("path").alias("source_file")), "source_file", "left_semi").select(F.col("id").alias("src"))).distinct()
    kept = old_edges.join(touched, "src", "left_anti").join(new_nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    edges = kept.unionByName(new_edges.join(touched, "src", "left_semi").select(*kept.columns))
    return state.save_graph(new_nodes, edges, store), n
