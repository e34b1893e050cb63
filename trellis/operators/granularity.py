"""A retrieval index of several granularities: atoms, groups of atoms, clusters of groups; and what is measured with it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators import levels, link, rank, split
from trellis.session import cut

Embed = Callable[[list[str]], list[list[float]]]
#: Fewer groups than this are one cluster; groups are linked from this cosine on.
FEW, LINKED = 10, 0.5


def with_vectors(rows: DataFrame, body: str, embed: Embed, batch: int = 32) -> DataFrame:
    """``rows`` with the vectors of a text column, ``batch`` texts to a call."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors: list[list[float]] = []
            for at in range(0, len(pdf), batch):
                vectors += embed(pdf[body].iloc[at : at + batch].tolist())
            yield pdf.assign(vec=[[float(x) for x in v] for v in vectors])

    return rows.mapInPandas(run, f"{schema}, vec array<double>")


def clusters(groups: DataFrame, least: float = LINKED, few: int = FEW, rounds: int = 6) -> DataFrame:
    """(id, cluster) of (id, vec): communities of the graph of similar groups; a group that is similar to none is a cluster of its own."""
    g = cut(groups.select("id", "vec"))
    if g.count() < few:
        first = g.agg(F.min("id").alias("cluster"))
        return g.select("id").crossJoin(F.broadcast(first))  # one row
    pairs = link.similar_pairs(g, least)
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("score").alias("weight"))
    found = rank.communities(edges, rounds)
    return g.select("id").join(found, "id", "left").select("id", F.coalesce("community", "id").alias("cluster"))


def build(docs: DataFrame, id_col: str, body: str, embed: Embed, splitter: str = "sentence", size: int = 3, tag: Callable[[str], str] | None = None) -> dict[str, DataFrame]:
    """The levels of an index: l0 (id, text, vec), members (id, parent), l1 (id, text, vec, cluster), l2 (id, tag, vec).

    Documents are split into atoms, ``size`` consecutive atoms of a document are a group, and groups are
    clustered by their vectors. A cluster's vector is the mean of its groups'; its tag comes from ``tag`` on the text of
    its first group, or is that text. Every level is written once.
    """
    atoms = split.atoms(docs, id_col, body, splitter)
    atoms = atoms.select(F.concat_ws(":", F.col("id").cast("string"), F.col("idx").cast("string")).alias("id"), F.col("id").cast("string").alias("doc"), "idx", F.col("atom").alias("text"))
    parent = F.concat_ws("#", "doc", F.floor(F.col("idx") / size).cast("string"))
    l0 = cut(with_vectors(atoms.select("id", "text"), "text", embed))
    members = atoms.select("id", parent.alias("parent"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    texts = atoms.groupBy(parent.alias("id")).agg(joined.alias("text"))
    l1 = cut(with_vectors(texts, "text", embed))
    l1 = cut(l1.join(clusters(l1), "id"))
    mean = l1.select("cluster", F.posexplode("vec").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))
    named = l1.groupBy(F.col("cluster").alias("id")).agg(F.min_by("text", "id").alias("tag"))
    if tag is not None:

        @F.pandas_udf("string")
        def tags(t: pd.Series) -> pd.Series:
            return t.map(tag)

        named = named.select("id", tags("tag").alias("tag"))
    return {"l0": l0, "members": members, "l1": l1, "l2": named.join(mean.withColumnRenamed("cluster", "id"), "id")}


def search(index: dict[str, DataFrame], query: str, embed: Embed, top_k: int = 5, by: str = "layers") -> DataFrame:
    """Groups for a query: ``flat`` the nearest groups, ``parents`` those of the nearest atoms, ``layers`` the nearest within the fitting clusters."""
    vector = embed([query])[0]
    if by == "flat":
        return levels.nearest(index["l1"], vector, top_k)
    if by == "parents":
        return levels.parents(index["l0"], index["members"], vector, top_k)
    return levels.multi_layer(index["l1"], index["l2"], query, vector, top_k)


def question_pairs(docs: DataFrame, ask: Callable[[str, int], list[tuple[str, str]]], n: int = 3) -> DataFrame:
    """(id, question, answer) that an injected model makes of (id, text), at most n a text; a text that it fails on gives none, blanks are dropped."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["id"], pdf["text"]):
                try:
                    got = ask(t, n)[:n]
                except Exception:  # noqa: BLE001
                    got = []
                rows += [(i, q, a) for q, a in got if q and q.strip() and a and a.strip()]
            yield pd.DataFrame(rows, columns=["id", "question", "answer"])

    return docs.filter(F.col("text").isNotNull()).select("id", "text").mapInPandas(run, f"id {kind}, question string, answer string")
