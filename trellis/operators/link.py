"""Links between nodes: names, tags, relations, symbols, similarity, bridges between namespaces, drift."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis import schema
from trellis.functions import text
from trellis.session import cut

MIN_SYMBOL = 5
# fixed values: labels too generic to be told from plain words
GENERIC = (
    "False None True class async yield raise while break import return lambda assert global except finally continue delete open type list dict tuple set str int float bool "
    "bytes iter next sorted range print super input format round enumerate filter hasattr getattr setattr delattr isinstance issubclass property staticmethod classmethod "
    "NotImplemented Ellipsis value error index count items keys values result output logger logging config settings data text path name label model"
).split()
#: Vectors in a block of similar_pairs.
BLOCK = 12_000


def wikilinks(docs: DataFrame, id_col: str = "id", body: str = "content") -> DataFrame:
    """(id, pos, target, section, block, display, relation) of every link, code included."""
    found = docs.select(F.col(id_col).alias("id"), F.posexplode(text.all_matches(F.col(body), text.LINK)).alias("pos", "raw"))
    inner = F.regexp_extract("raw", r"\[\[([^\[\]]+)\]\]", 1)
    name = F.regexp_extract(inner, r"^([^#^|]*)", 1)
    section = F.regexp_extract(inner, r"#([^\^|]*)", 1)
    block = F.regexp_extract(inner, r"\^([^|]*)", 1)
    relation = F.when(F.col("raw").startswith("!"), "embeds").when(section != "", "links_to_section").when(block != "", "links_to_block").otherwise("links_to")
    return found.select("id", "pos", F.trim(name).alias("target"), section.alias("section"), block.alias("block"), F.regexp_extract(inner, r"\|(.*)$", 1).alias("display"), relation.alias("relation"))


def name_index(nodes: DataFrame) -> DataFrame:
    """(key, id): lower-case labels, aliases and knowledge ids, each only if one document holds it in the highest tier.

    Tier 3 is a knowledge id, 2 the mark ``canonical`` (a column that may be missing), 1 a file
    under knowledge/, 0 any other.
    """
    marked = F.col("canonical") if "canonical" in nodes.columns else F.lit(False)
    tier = F.when(F.col("knowledge_id").isNotNull(), 3).when(marked, 2).when(F.array_contains(F.split("source_file", "/"), "knowledge"), 1).otherwise(0)
    keys = F.concat(F.array("label", "knowledge_id"), F.coalesce("aliases", F.array().cast("array<string>")))
    flat = nodes.select("id", F.coalesce(tier, F.lit(0)).alias("tier"), F.explode(keys).alias("key")).filter(F.col("key").isNotNull()).select("id", "tier", F.lower("key").alias("key")).distinct()
    best = flat.groupBy("key").agg(F.max("tier").alias("tier"))
    top = flat.join(best, ["key", "tier"]).groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return top.filter("n = 1").select("key", "id")


def resolve_links(links: DataFrame, index: DataFrame) -> DataFrame:
    """Edges (src, dst, relation) of links whose target is known; dangling links and links to oneself are dropped."""
    return links.withColumn("key", F.lower("target")).join(index.withColumnRenamed("id", "dst"), "key").filter(F.col("id") != F.col("dst")).select(F.col("id").alias("src"), "dst", "relation").distinct()


def typed_relations(nodes: DataFrame, index: DataFrame) -> DataFrame:
    """Edges of the known relation types named in a node's relations."""
    flat = nodes.select("id", F.explode("relations").alias("relation", "targets")).filter(F.col("relation").isin(*schema.RELATION_TYPES)).select("id", "relation", F.explode("targets").alias("target"))
    return resolve_links(flat, index)


def tag_pairs(nodes: DataFrame) -> DataFrame:
    """Tags that stand together on a node: (tag_a, tag_b, nodes), tag_a < tag_b.

    Pairs are made within a node's own short list, not by a join on the tag.
    """
    tags = F.array_sort(F.array_distinct(F.filter("tags", lambda t: t.isNotNull())))
    lists = nodes.select(tags.alias("t")).filter(F.size("t") > 1)
    pairs = F.flatten(F.transform("t", lambda a, i: F.transform(F.slice(F.col("t"), i + 2, F.size("t")), lambda b: F.struct(a.alias("tag_a"), b.alias("tag_b")))))
    return lists.select(F.explode(pairs).alias("p")).groupBy("p.tag_a", "p.tag_b").agg(F.count("*").alias("nodes"))


def shared_tag_bridges(nodes: DataFrame) -> DataFrame:
    """(tag, ns_a, ns_b, weight) for every tag that stands in more than one namespace."""
    ns = nodes.select("namespace", F.explode("tags").alias("tag")).filter(F.col("tag").isNotNull()).groupBy("tag").agg(F.array_sort(F.collect_set("namespace")).alias("ns"))
    pairs = F.flatten(F.transform("ns", lambda a, i: F.transform(F.slice(F.col("ns"), i + 2, F.size("ns")), lambda b: F.struct(a.alias("ns_a"), b.alias("ns_b")))))
    return ns.filter(F.size("ns") > 1).select("tag", F.explode(pairs).alias("p")).select("tag", "p.ns_a", "p.ns_b", F.lit(0.5).alias("weight"))


def symbols(nodes: DataFrame) -> DataFrame:
    """(symbol, id) of all code labels that can be mentioned: of at least five characters and not among the generic names."""
    code = nodes.filter((F.col("namespace") == "code") & F.col("kind").isin("function", "class", "module"))
    named = code.select(F.trim("label").alias("symbol"), "id").filter((F.length("symbol") >= MIN_SYMBOL) & ~F.col("symbol").isin(*GENERIC))
    return named.distinct()


def symbol_links(notes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mentions of code symbols in notes (id, content): (src, symbol, dst, tier, score, weight, occurrences).

    A wikilink to the symbol of one node is EXTRACTED 1.0, a word that is one INFERRED .9; where
    several nodes bear the symbol there is a link to each of them, AMBIGUOUS .2. Of a link and
    words that lead to the same node the link counts. Notes are cut into words once and
    joined with the symbols by equality, so only symbols that are one word are found as words.
    """
    known = symbols(nodes)
    many = known.groupBy("symbol").agg(F.count("*").alias("n"))
    told = known.withColumnRenamed("id", "dst").join(many, "symbol")
    texts = notes.filter(F.col("content").isNotNull()).select(F.col("id").alias("src"), "content")
    target = F.trim(F.regexp_extract("raw", r"\[\[([^\]|]+)", 1))
    linked = texts.select("src", F.explode(text.all_matches(F.col("content"), r"\[\[[^\]|]+(?:\|[^\]]+)?\]\]")).alias("raw")).select("src", target.alias("symbol"), F.lit(0).alias("by"))
    words = texts.select("src", F.explode(text.all_matches(F.col("content"), text.WORD)).alias("symbol"), F.lit(1).alias("by"))
    hit = linked.unionByName(words).groupBy("src", "symbol", "by").agg(F.count("*").alias("occurrences")).join(told, "symbol")
    one, link = F.col("n") == 1, F.col("by") == 0
    weight = F.when(link, 1.0).otherwise(F.least(F.lit(1.0), F.round(F.lit(0.5) + F.lit(0.1) * F.col("occurrences"), 6)))
    graded = hit.select(
        "src", "symbol", "dst", "by", F.when(~one, "AMBIGUOUS").when(link, "EXTRACTED").otherwise("INFERRED").alias("tier"), F.when(~one, 0.2).when(link, 1.0).otherwise(0.9).alias("score"), weight.alias("weight"), "occurrences",
    )
    rest = ("tier", "score", "weight", "occurrences")
    return graded.groupBy("src", "symbol", "dst").agg(F.min_by(F.struct(*rest), "by").alias("v")).select("src", "symbol", "dst", *[F.col(f"v.{c}").alias(c) for c in rest])


def relink_symbols(edges: DataFrame, links: DataFrame) -> DataFrame:
    """``edges`` with their mentions made anew: old ones go, but those that are anchored stay and are not overwritten."""
    mention = F.coalesce(F.col("relation") == "mentions_symbol", F.lit(False))
    anchored = F.coalesce(F.lower("lifecycle") == "anchored", F.lit(False))
    kept = edges.filter(~mention | anchored)
    new = links.select("src", "dst", F.lit("mentions_symbol").alias("relation"), "tier", "score", "weight", F.lit("ast").alias("source_pass"), F.lit("deterministic").alias("lifecycle"))
    fixed = kept.filter(mention).select("src", "dst")
    # an edge is one per pair of nodes: the mention replaces another relation, an anchored mention stays
    fresh = new.join(fixed, ["src", "dst"], "left_anti")
    return kept.join(fresh.select("src", "dst"), ["src", "dst"], "left_anti").select(*new.columns).unionByName(fresh)


def drift(nodes: DataFrame, edges: DataFrame, relation: str = "mentions_symbol") -> DataFrame:
    """Whether the code that notes mention is still there: (src, dst, status)."""
    code = nodes.filter(F.col("namespace") == "code").select(F.col("id").alias("dst"), F.lit("valid").alias("status"))
    return edges.filter(F.col("relation") == relation).select("src", "dst").distinct().join(code, "dst", "left").select("src", "dst", F.coalesce("status", F.lit("not_found")).alias("status"))


def flag_suspected(nodes: DataFrame, drifted: DataFrame) -> DataFrame:
    """Notes with lost references and the symbols they lost, in order: (src, lost, symbols)."""
    bad = drifted.filter(F.col("status") == "not_found").join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    return bad.groupBy("src").agg(F.count("*").alias("lost"), F.array_join(F.array_sort(F.collect_set(F.substring_index("dst", "::", -1))), ",").alias("symbols"))


def _block_pairs(least: float):
    schema_ = "a string, b string, score double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        norm = np.linalg.norm(x, axis=1)
        ok = norm > 0
        ids, x = pdf["id"].to_numpy()[ok], x[ok] / norm[ok, None]
        side = pdf["side"].to_numpy()[ok]
        # side 0: a block against itself; else rows of side 1 against rows of side 2
        one = not len(side) or side[0] == 0
        left, right = (np.arange(len(x)),) * 2 if one else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
        a, b, c = [], [], []
        for i in range(0, len(left), 512):
            rows = left[i : i + 512]
            cos = x[rows] @ x[right].T
            p, q = np.nonzero(cos >= least - 1e-9)
            if one:
                p, q = p[rows[p] < right[q]], q[rows[p] < right[q]]
            a.append(ids[rows[p]]), b.append(ids[right[q]]), c.append(cos[p, q])
        a, b, c = (np.concatenate(z) if z else np.empty(0, object) for z in (a, b, c))
        swap = np.array([u > v for u, v in zip(a, b)], bool)
        return pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "score": c.astype(np.float64)})

    return run, schema_


def similar_pairs(vectors: DataFrame, least: float, same_group: bool | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b, score), a < b, with a cosine of at least ``least``: all of them, by comparing every block of vectors with every other.

    With a column ``grp``, ``same_group`` keeps pairs of one group or of different groups
    only. Exact, so the work grows with the square of the vectors; a vector goes to as many
    pairs of blocks as there are blocks, and no task holds more than about two blocks. A
    vector of zeros is similar to none.
    """
    v = cut(vectors)
    n = max(1, math.ceil(v.count() / block))
    blk = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    wide = v.select("id", "vec", blk.alias("blk"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("o"))
    side = F.when(F.col("blk") == F.col("o"), 0).when(F.col("blk") < F.col("o"), 1).otherwise(2)
    parts = wide.select("id", "vec", F.least("blk", "o").alias("x"), F.greatest("blk", "o").alias("y"), side.cast("int").alias("side"))
    # few groups with much work in each, so they are spread by hand and not put together by AQE
    tasks = int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run, schema_ = _block_pairs(least)
    told = parts.repartition(tasks, "x", "y").groupBy("x", "y").applyInPandas(run, schema_).filter(F.col("score") >= least)
    if same_group is not None:
        g = v.select("id", "grp")
        told = told.join(g.select(F.col("id").alias("a"), F.col("grp").alias("grp_a")), "a").join(g.select(F.col("id").alias("b"), F.col("grp").alias("grp_b")), "b")
        told = told.filter(F.col("grp_a").eqNullSafe(F.col("grp_b")) == F.lit(same_group))
    return told.select("a", "b", "score")


def similarity_edges(vectors: DataFrame, edges: DataFrame, least: float = 0.65, k: int = 10) -> DataFrame:
    """New edges (src, dst, score) between nodes that are among each other's k most similar and not linked yet.

    Existing edges still take their places among the k; one edge per pair, from the smaller id.
    """
    pairs = cut(similar_pairs(vectors, least))
    both = pairs.select("a", "b", "score").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    w = Window.partitionBy("a").orderBy(F.desc(F.round("score", 9)), "b")
    near = both.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k)
    one = near.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.round(F.max("score"), 4).alias("score"))
    known = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return one.join(known, ["src", "dst"], "left_anti")


def embedding_bridges(vectors: DataFrame, least: float = 0.7, k: int = 5) -> DataFrame:
    """Edges (src, dst, score) between namespaces: for (id, vec, grp) the k most similar of each other namespace."""
    pairs = similar_pairs(vectors, least, same_group=False)
    g = vectors.select("id", "grp")
    told = pairs.join(g.select(F.col("id").alias("a"), F.col("grp").alias("ga")), "a").join(g.select(F.col("id").alias("b"), F.col("grp").alias("gb")), "b")
    # the namespace that comes first in order looks up its neighbours in the other
    first = F.col("ga") < F.col("gb")
    src, dst = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    flat = told.select(src.alias("src"), dst.alias("dst"), F.greatest("ga", "gb").alias("to"), "score")
    w = Window.partitionBy("src", "to").orderBy(F.desc(F.round("score", 9)), "dst")
    return flat.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k).select("src", "dst", F.round("score", 4).alias("score"))
