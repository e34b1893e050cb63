"""Personalised PageRank and modularity communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.graph import undirected
from trellis.session import cut


def pagerank(links: DataFrame, seeds: DataFrame | None = None, alpha: float = 0.7, rounds: int = 20, cut_every: int = 4) -> DataFrame:
    """(id, rank) after a fixed number of rounds over (a, b, weight) in both directions.

    ``seeds`` (id, mass) says where walks restart and where the mass of nodes without
    links goes; without any it is everywhere alike. Each round is one join on the
    node and one partial aggregation; the links keep their partitioning.
    """
    out = links.groupBy("a").agg(F.sum("weight").alias("total"))
    # written by the node that they start from, so that no round shuffles them again
    tasks = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = cut(links.join(out, "a").select("a", "b", (F.col("weight") / F.col("total")).alias("p")).repartition(tasks, "a"))
    ids = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if seeds is None:
        start = ids.withColumn("mass", F.lit(1.0))
    else:
        start = ids.join(seeds.groupBy("id").agg(F.sum("mass").alias("mass")), "id", "left").fillna(0.0, ["mass"])
    total = start.agg(F.sum("mass")).head()[0] or 0.0
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    base = cut(start.select("id", ((F.col("mass") / total) if total else F.lit(1.0 / n)).alias("home")))
    rank = base.select("id", "home", F.lit(1.0 / n).alias("rank"))
    for i in range(rounds):
        flow = rank.select(F.col("id").alias("a"), "rank").join(steps, "a").groupBy(F.col("b").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("flow"))
        # in an undirected graph every node has links, so no mass is lost
        rank = base.join(flow, "id", "left").select("id", "home", (alpha * F.coalesce("flow", F.lit(0.0)) + (1 - alpha) * F.col("home")).alias("rank"))
        if (i + 1) % cut_every == 0:
            rank = cut(rank)
    return rank.select("id", "rank")


def personal_ranks(links: DataFrame, seeds: DataFrame, alpha: float = 0.7, rounds: int = 4, cut_every: int = 2) -> DataFrame:
    """(grp, id, rank): personalised ranks of many groups of seeds (grp, id, mass) at once, over (a, b, weight) in both directions.

    Walks begin at the seeds, so a group holds only the nodes that its walks have reached. Each
    round is a join on the node and one aggregation over all groups. Seeds that are no nodes are
    left out, and so are groups without any that is.
    """
    spark = links.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = links.groupBy("a").agg(F.sum("weight").alias("total"))
    steps = cut(links.join(out, "a").select("a", "b", (F.col("weight") / F.col("total")).alias("p")).repartition(tasks, "a"))
    there = seeds.join(out.select(F.col("a").alias("id")), "id", "left_semi").groupBy("grp", "id").agg(F.sum("mass").alias("mass"))
    total = there.groupBy("grp").agg(F.sum("mass").alias("all"))
    home = cut(there.join(total, "grp").filter("all > 0").select("grp", "id", (F.col("mass") / F.col("all")).alias("rank")))
    rank = home
    for i in range(rounds):
        moved = rank.withColumnRenamed("id", "a").join(steps, "a").select("grp", F.col("b").alias("id"), (F.col("rank") * F.col("p") * alpha).alias("rank"))
        rank = moved.unionByName(home.select("grp", "id", (F.col("rank") * (1 - alpha)).alias("rank"))).groupBy("grp", "id").agg(F.sum("rank").alias("rank"))
        if (i + 1) % cut_every == 0:
            rank = cut(rank)
    return rank


def communities(edges: DataFrame, rounds: int = 8, resolution: float = 1.0) -> DataFrame:
    """(id, community) by local moving on the undirected graph, largest weights first.

    In each round a node may join the neighbouring community with the largest gain of
    modularity; halves of the nodes, picked by hash, move in turn so that neighbours
    do not swap for ever. Communities are named by their least member.
    """
    pairs = cut(undirected(edges).filter(F.col("a") != F.col("b")))
    both = cut(pairs.select("a", "b", "weight").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    strength = cut(both.groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("k")))
    two_m = strength.agg(F.sum("k")).head()[0]
    if not two_m:
        return strength.select("id", F.col("id").alias("community"))
    member = strength.select("id", "k", F.col("id").alias("community"))
    for i in range(rounds):
        totals = member.groupBy("community").agg(F.sum("k").alias("tot"))
        to = both.join(member.select(F.col("id").alias("b"), "community"), "b").groupBy(F.col("a").alias("id"), "community").agg(F.sum("weight").alias("w"))
        own = member.select("id", "k", F.col("community").alias("own"))
        choice = to.join(totals, "community").join(own, "id")
        others = F.col("tot") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - resolution * F.col("k") * others / two_m, 9)
        best = choice.withColumn("gain", gain).groupBy("id").agg(F.max(F.struct("gain", F.expr("community = own").alias("stay"), "community")).alias("m"), F.max(F.expr("CASE WHEN community = own THEN gain END")).alias("now"))
        moves = best.filter((F.pmod(F.xxhash64("id"), F.lit(2)) == i % 2) & (F.col("m.gain") > F.coalesce("now", F.lit(0.0)))).select("id", F.col("m.community").alias("to"))
        member = cut(member.join(moves, "id", "left").select("id", "k", F.coalesce("to", "community").alias("community")))
    names = member.groupBy("community").agg(F.min("id").alias("name"))
    return member.join(names, "community").select("id", F.col("name").alias("community"))


def modularity(edges: DataFrame, member: DataFrame) -> float:
    """Modularity of a partition (id, community) on the undirected weighted graph."""
    pairs = undirected(edges).filter(F.col("a") != F.col("b"))
    m = pairs.agg(F.sum("weight")).head()[0] or 0.0
    if not m:
        return 0.0
    named = pairs.join(member.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(member.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    inside = named.filter(F.col("ca") == F.col("cb")).agg(F.sum("weight")).head()[0] or 0.0
    ends = named.select(F.explode(F.array("ca", "cb")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("d"))
    return inside / m - sum((r["d"] / (2 * m)) ** 2 for r in ends.agg(F.sum(F.pow("d", F.lit(2))).alias("s")).selectExpr("sqrt(s) AS d").collect())
