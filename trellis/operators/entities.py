"""Atoms and the entities they name: the bipartite graph, and retrieval by walks over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions import vec
from trellis.operators import link, rank
from trellis.session import cut

NAME = r"\p{Lu}[\p{L}\p{N}]+(?:[ ]\p{Lu}[\p{L}\p{N}]+)*"
SYNONYM, ATOM_SEED, SEED_ATOMS = 0.8, 0.1, 5


def names_in(text: Column) -> Column:
    """Runs of capitalised words, lower-cased: the entities of a text without a model."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)), lambda x: F.lower(x)))


def atom_entity_graph(atoms: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Links (a, b, weight) in both directions between ``atom:id`` and ``entity:name`` from (id, entities).

    With (id, vec) of entities, those with a cosine above SYNONYM are linked as well.
    """
    one = atoms.select(F.concat(F.lit("atom:"), F.col("id").cast("string")).alias("a"), F.explode(F.array_distinct("entities")).alias("e")).filter(F.col("e").isNotNull())
    links = one.select("a", F.concat(F.lit("entity:"), "e").alias("b"), F.lit(1.0).alias("weight"))
    if vectors is not None:
        near = link.similar_pairs(vectors, SYNONYM)
        links = links.unionByName(near.select(F.concat(F.lit("entity:"), "a").alias("a"), F.concat(F.lit("entity:"), "b").alias("b"), F.col("score").alias("weight")))
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def walk_retrieve(links: DataFrame, entities: list[str], atoms: DataFrame | None = None, query: list[float] | None = None, top_k: int = 25, damping: float = 0.3, rounds: int = 20) -> DataFrame:
    """The atoms (id, score) with the highest rank of walks that restart at the query's entities.

    With (id, vec) of atoms and a query vector the five nearest atoms are restarted at
    as well, at a tenth of the mass. Without any known seed all nodes are.
    """
    spark = links.sparkSession
    links = cut(links)
    seeds = links.select(F.col("a").alias("id")).filter(F.col("id").isin([f"entity:{e.lower()}" for e in entities])).distinct().withColumn("mass", F.lit(1.0))
    if atoms is not None and query is not None:
        q = F.array(*[F.lit(float(x)) for x in query])
        top = atoms.select(F.concat(F.lit("atom:"), F.col("id").cast("string")).alias("id"), vec.cosine(F.col("vec"), q).alias("s")).orderBy(F.desc("s"), "id").limit(SEED_ATOMS)
        seeds = seeds.unionByName(top.select("id", F.lit(ATOM_SEED).alias("mass")))
    seeds = cut(seeds.join(links.select(F.col("a").alias("id")).distinct(), "id", "left_semi"))
    got = rank.pagerank(links, None if seeds.isEmpty() else seeds, 1 - damping, rounds)
    out = got.filter(F.col("id").startswith("atom:")).select(F.expr("substring(id, 6)").alias("id"), F.col("rank").alias("score"))
    return out.orderBy(F.desc(F.round("score", 12)), "id").limit(top_k) if top_k else spark.createDataFrame([], out.schema)


def walk_many(links: DataFrame, seeds: DataFrame, top_k: int = 25, damping: float = 0.3, rounds: int = 4) -> DataFrame:
    """For many queries at once, each with its seeds (grp, id, mass): the top_k atoms (grp, id, score, rank), ties by id."""
    got = rank.personal_ranks(cut(links), seeds, 1 - damping, rounds).filter(F.col("id").startswith("atom:"))
    # a little more, so that a value on the edge of the twelfth place does not hang on the order of sums
    w = Window.partitionBy("grp").orderBy(F.desc(F.round(F.col("rank") + 1e-14, 12)), "id")
    ranked = got.select("grp", F.expr("substring(id, 6)").alias("id"), "rank").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= top_k)
    return ranked.select("grp", "id", F.col("rank").alias("score"), F.col("k").alias("rank"))


def to_groups(hits: DataFrame, members: DataFrame, top_k: int = 5) -> DataFrame:
    """Groups (members: id, parent) of ranked atoms (id, rank), in the order of their best atom."""
    best = hits.join(members, "id").groupBy(F.col("parent").alias("id")).agg(F.min("rank").alias("best"))
    return best.orderBy("best", "id").limit(top_k)
