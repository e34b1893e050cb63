"""Quality of splitting and retrieval, as expressions and aggregates."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions import text, vec
from trellis.operators.records import numbered
from trellis.session import cut


def atomicity(atom: Column) -> Column:
    """1 less .3 for each further sentence and a hundredth for each word beyond fifty; at least 0."""
    sentences = F.size(F.filter(F.split(atom, r"[.?!。？！][ \t\r\n]"), lambda s: F.trim(s) != ""))
    words = F.size(F.filter(F.split(F.trim(atom), r"\s+"), lambda w: w != ""))
    return F.greatest(F.lit(0.0), 1.0 - 0.3 * (sentences - 1) - F.greatest(F.lit(0.0), (words - 50) / 100.0))


def self_contained(atom: Column) -> Column:
    return F.when(F.trim(atom).rlike(text.BACK_REFERENCE), 0.0).otherwise(1.0)


def faithfulness(atom: Column, source: Column) -> Column:
    """The share of the atom's words found in its source; 1 for an atom without words, 0 for a source without any."""
    a, s = text.word_set(atom), text.word_set(source)
    return F.when(F.size(s) == 0, 0.0).when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, s)) / F.size(a))


def word_f1(a: Column, b: Column) -> Column:
    x, y = text.word_set(a), text.word_set(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) + F.size(y)) == 0, 0.0).otherwise(2.0 * both / (F.size(x) + F.size(y)))


def splitter_scores(atoms: DataFrame, docs: DataFrame, id_col: str, body: str) -> DataFrame:
    """Per document (id, atoms, atomicity, self_contained, faithfulness, coverage, overall), each to 6 places."""
    d = docs.select(F.col(id_col).alias("id"), F.col(body).alias("source"))
    j = atoms.join(d, "id")
    g = j.groupBy("id").agg(
        F.count("*").alias("atoms"), F.avg(atomicity(F.col("atom"))).alias("a"), F.avg(self_contained(F.col("atom"))).alias("s"),
        F.avg(faithfulness(F.col("atom"), F.col("source"))).alias("f"), F.sum(F.length(F.trim("atom"))).alias("n"), F.max(F.length(F.trim("source"))).alias("m"),
    )
    cover = F.when(F.col("m") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("n") / F.col("m")))
    return g.select(
        "id", "atoms", F.round("a", 6).alias("atomicity"), F.round("s", 6).alias("self_contained"), F.round("f", 6).alias("faithfulness"), F.round(cover, 6).alias("coverage"),
        F.round((F.col("a") + F.col("s") + F.col("f") + cover) / 4, 6).alias("overall"),
    )


def gold_alignment(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Per case the F1 of the two means of best word-F1 matches, from (case_id, text) on both sides."""
    p = predicted.select("case_id", F.col("text").alias("p"), F.monotonically_increasing_id().alias("i"))
    g = gold.select("case_id", F.col("text").alias("g"), F.monotonically_increasing_id().alias("j"))
    m = p.join(g, "case_id").withColumn("f", word_f1(F.col("p"), F.col("g")))
    a = m.groupBy("case_id", "i").agg(F.max("f").alias("f")).groupBy("case_id").agg(F.avg("f").alias("precision"))
    b = m.groupBy("case_id", "j").agg(F.max("f").alias("f")).groupBy("case_id").agg(F.avg("f").alias("recall"))
    s = F.col("precision") + F.col("recall")
    return a.join(b, "case_id").select("case_id", "precision", "recall", F.when(s == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / s).alias("f1"))


def retrieval_scores(hits: DataFrame, top_k: int, relevant: float = 0.3, answer: float = 0.5) -> DataFrame:
    """Per query (query_id, recall, precision, mrr, average) from hits (query_id, rank, chunk, answer, source).

    A hit is relevant if it covers ``relevant`` of the source's words; recall asks whether
    any hit covers ``answer`` of the answer's. The precision's denominator stays top_k.
    """
    rel = text.overlap(F.col("chunk"), F.col("source")) >= relevant
    got = text.overlap(F.col("chunk"), F.col("answer")) >= answer
    g = hits.groupBy("query_id").agg(F.max(got.cast("int")).cast("double").alias("recall"), (F.sum(rel.cast("int")) / top_k).alias("precision"), F.min(F.when(rel, F.col("rank"))).alias("first"))
    mrr = F.coalesce(1.0 / F.col("first"), F.lit(0.0))
    return g.select("query_id", "recall", F.round("precision", 6).alias("precision"), F.round(mrr, 6).alias("mrr"), F.round(0.4 * F.col("recall") + 0.35 * mrr + 0.25 * F.col("precision"), 6).alias("average"))


def boundary_clarity(vectors: DataFrame, by: str, order: str, column: str = "vec") -> DataFrame:
    """1 less the mean cosine of neighbours in order; 1 for fewer than two vectors."""
    # neighbours meet by an equality join on their numbers, so a large group is not one task
    n = cut(numbered(vectors.select(by, order, column), [by], [order], "_n"))
    before = n.select(F.col(by).alias("_by"), (F.col("_n") + 1).alias("_m"), F.col(column).alias("before"))
    pairs = n.join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_n") == F.col("_m")), "left").withColumn("c", F.when(F.col("before").isNotNull(), vec.cosine(F.col("before"), F.col(column)))).drop("_n")
    return pairs.groupBy(by).agg(F.count("*").alias("n"), F.round(1.0 - F.coalesce(F.avg("c"), F.lit(0.0)), 6).alias("clarity"))


def splitter_table(atoms_by_name: dict[str, DataFrame], docs: DataFrame, id_col: str, body: str) -> DataFrame:
    """Means of the scores per splitter over all documents that it splits: (splitter, documents, atomicity, ..., overall)."""
    out = None
    for name, atoms in sorted(atoms_by_name.items()):
        s = splitter_scores(atoms, docs, id_col, body)
        row = s.agg(F.count("*").alias("documents"), *[F.round(F.avg(c), 4).alias(c) for c in ("atomicity", "self_contained", "faithfulness", "coverage", "overall")]).select(F.lit(name).alias("splitter"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def weighted_overall(atomicity: Column, contained: Column, faithful: Column, coverage: Column, gold: Column | None = None) -> Column:
    """Overall score: with a gold alignment .20/.15/.20/.15/.30, else a quarter each."""
    if gold is None:
        return F.round((atomicity + contained + faithful + coverage) / 4, 4)
    return F.round(0.20 * atomicity + 0.15 * contained + 0.20 * faithful + 0.15 * coverage + 0.30 * gold, 4)


def retrieval_iou(hits: DataFrame, chunks: DataFrame, id_col: str, body: str, relevant: float = 0.3) -> DataFrame:
    """Per query the share of retrieved and relevant chunks among all retrieved or relevant ones: (query_id, iou).

    ``hits`` has (query_id, chunk_id, source). A chunk is relevant if it covers ``relevant``
    of the source's words; such chunks are found by an equality join on the words, not by
    comparing every chunk with every source.
    """
    src = hits.select("query_id", "source").distinct()
    sw = src.select("query_id", text.word_set(F.col("source")).alias("s")).select("query_id", F.size("s").alias("n"), F.explode("s").alias("w"))
    cw = chunks.select(F.col(id_col).alias("chunk_id"), F.explode(text.word_set(F.col(body))).alias("w"))
    rel = cw.join(sw, "w").groupBy("query_id", "chunk_id").agg((F.count("*") / F.first("n")).alias("share")).filter(F.col("share") >= relevant).select("query_id", "chunk_id")
    got = hits.select("query_id", "chunk_id").distinct()
    union = got.union(rel).distinct().groupBy("query_id").agg(F.count("*").alias("u"))
    both = got.join(rel, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.count("*").alias("b"))
    return union.join(both, "query_id", "left").select("query_id", F.round(F.coalesce("b", F.lit(0)) / F.col("u"), 6).alias("iou"))


def context_sufficiency(hits: DataFrame, least: float = 0.5, judge: Callable[[str, str], float] | None = None) -> DataFrame:
    """(query_id, covered, sufficient): whether all hits of a query together are enough to answer it.

    ``hits`` has (query_id, rank, chunk, answer). Without a judge the share of the answer's words
    that the chunks hold decides; a judge is given the joined chunks and the answer, in rank order,
    and returns a score from 0 to 1. An empty answer is covered by nothing.
    """
    all_ = hits.groupBy("query_id", "answer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk"))), lambda x: x["chunk"]), "\n").alias("all"))
    if judge is None:
        score = text.overlap(F.col("all"), F.col("answer"))
    else:

        @F.pandas_udf("double")
        def judged(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([float(judge(x, y)) for x, y in zip(a, b)], dtype=float)

        score = judged("all", "answer")
    return all_.select("query_id", score.alias("score")).groupBy("query_id").agg(F.round(F.max("score"), 6).alias("covered")).withColumn("sufficient", F.col("covered") >= least)


def multi_hop(chunks: DataFrame, cases: DataFrame, answer: float = 0.4, relevant: float = 0.3, gold: float = 0.25) -> DataFrame:
    """Multi-hop scores per case: (case_id, answered, recall, mrr).

    ``chunks`` has (case_id, rank, chunk), ``cases`` (case_id, answer, paragraphs), the gold
    paragraphs. Answered: all chunks together cover the answer; recall: every gold paragraph is
    covered by some chunk; mrr: from the first chunk that covers any.
    """
    all_ = chunks.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk"))), lambda x: x["chunk"]), " ").alias("all"))
    answered = all_.join(cases, "case_id").select("case_id", (text.overlap(F.col("all"), F.col("answer")) >= answer).alias("answered"))
    pairs = chunks.join(cases.select("case_id", F.posexplode("paragraphs").alias("p", "paragraph")), "case_id").withColumn("o", text.overlap(F.col("chunk"), F.col("paragraph")))
    per = pairs.groupBy("case_id", "p").agg(F.max("o").alias("best"))
    recall = per.groupBy("case_id").agg(F.min((F.col("best") >= gold).cast("int")).cast("double").alias("recall"))
    first = pairs.filter(F.col("o") >= relevant).groupBy("case_id").agg((1.0 / F.min("rank")).alias("mrr"))
    return answered.join(recall, "case_id").join(first, "case_id", "left").select("case_id", "answered", "recall", F.coalesce("mrr", F.lit(0.0)).alias("mrr"))
