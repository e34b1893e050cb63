"""Levels of granularity: atoms, groups of atoms, clusters; and retrieval over them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions import text, vec
from trellis.operators.records import numbered


def windows(atoms: DataFrame, source: str, order: list[str], id_col: str, body: str, size: int = 3) -> DataFrame:
    """Runs of ``size`` consecutive atoms of a source: (source, grp, members, text)."""
    g = numbered(atoms.select(*dict.fromkeys([source, *order, id_col, body])), [source], order).withColumn("grp", F.floor((F.col("n") - 1) / size).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("n", F.col(body).alias("t"))))
    return g.groupBy(F.col(source).alias("source"), "grp").agg(F.count("*").alias("members"), parts.alias("p")).select("source", "grp", "members", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"))


def entity_groups(atoms: DataFrame, max_size: int = 5) -> DataFrame:
    """Groups of neighbouring atoms of a source that share an entity with their group: (source_idx, idx, grp).

    From (source_idx, idx, entities). A group of one joins the one before it, else the one
    after it. The fold runs over sorted partitions as a stream and holds two groups at
    a time, so the length of a source does not matter.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = object()
        number, before, group, shared = 0, None, [], set()
        rows: list[tuple] = []

        def close() -> None:
            """Put the finished group to the one before it, or that one out."""
            nonlocal number, before
            if not group:
                return
            if before is None:
                before = list(group)
            elif len(group) == 1 and len(before) < max_size or (number == 0 and len(before) == 1 and len(group) < max_size):
                before += group
            else:
                rows.extend((at, i, number) for i in before)
                number, before = number + 1, list(group)

        def finish() -> None:
            close()
            rows.extend((at, i, number) for i in before or [])

        for pdf in batches:
            for source, idx, entities in zip(pdf["source_idx"], pdf["idx"], pdf["entities"]):
                own = set(entities if entities is not None else [])
                if source != at:
                    finish()
                    at, number, before, group, shared = source, 0, None, [], set()
                if group and own & shared and len(group) < max_size:
                    group.append(idx)
                    shared |= own
                else:
                    close()
                    group, shared = [idx], own
            yield pd.DataFrame(rows, columns=["source_idx", "idx", "grp"])
            rows.clear()
        finish()
        yield pd.DataFrame(rows, columns=["source_idx", "idx", "grp"])

    ordered = atoms.filter("source_idx IS NOT NULL").select("source_idx", "idx", "entities").repartition("source_idx").sortWithinPartitions("source_idx", "idx")
    return ordered.mapInPandas(run, "source_idx int, idx int, grp int")


def nearest(level: DataFrame, query: list[float], top_k: int) -> DataFrame:
    """The top_k of (id, vec) by cosine: (id, score, rank)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    top = level.select("id", vec.cosine(F.col("vec"), q).alias("score")).orderBy(F.desc(F.round("score", 9)), "id").limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "id")))


def collapsed(l0: DataFrame, l1: DataFrame, query: list[float], top_k: int = 5) -> DataFrame:
    """Atoms and groups in one list."""
    return nearest(l0.select(F.concat(F.lit("l0:"), "id").alias("id"), "vec").unionByName(l1.select(F.concat(F.lit("l1:"), "id").alias("id"), "vec")), query, top_k)


def parents(l0: DataFrame, members: DataFrame, query: list[float], top_k: int = 5) -> DataFrame:
    """The groups (members: id, parent) of the 2k nearest atoms, in the order of their best atom."""
    hits = nearest(l0, query, 2 * top_k).join(members, "id")
    best = hits.groupBy(F.col("parent").alias("id")).agg(F.min("rank").alias("best"))
    return best.orderBy("best", "id").limit(top_k)


def multi_layer(l1: DataFrame, l2: DataFrame, query_text: str, query: list[float], top_k: int = 5) -> DataFrame:
    """Groups within the clusters whose tag shares .3 of its words with the query, else within the three nearest clusters, else all.

    ``l1`` has (id, vec, cluster), ``l2`` (id, tag, vec); clusters are few.
    """
    words = text.word_set(F.lit(query_text))
    tag = text.word_set(F.col("tag"))
    scope = l2.filter(F.size(F.array_intersect(tag, words)) / F.greatest(F.lit(1), F.size(tag)) >= 0.3).select(F.col("id").alias("cluster"))
    if scope.isEmpty():
        scope = nearest(l2, query, 3).select(F.col("id").alias("cluster"))
    within = l1.join(scope, "cluster", "left_semi")
    return nearest(within if not within.isEmpty() else l1, query, top_k)


def char_budget(rows: DataFrame, group: str, order: str, body: str, budget: int = 12_000) -> DataFrame:
    """Per group how many texts fit into a number of characters, in order: (grp, kept, more, chars)."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    used = rows.withColumn("n", F.length(body)).withColumn("used", F.sum("n").over(w))
    fits = F.col("used") <= budget
    return used.groupBy(F.col(group).alias("grp")).agg(
        F.sum(fits.cast("long")).alias("kept"), F.sum((~fits).cast("long")).alias("more"), F.coalesce(F.sum(F.when(fits, F.col("n"))), F.lit(0)).cast("long").alias("chars")
    )


def keyword_hits(qa: DataFrame, chunks: DataFrame, top_k: int = 5) -> DataFrame:
    """The top_k chunks of each question by shared words, weighted by their rarity: the input of the retrieval measures.

    Chunks are cut into words once; a word joins the questions that have it. Words are
    weighted before the join, so the hits of frequent words are summed, not ranked.
    """
    q = qa.filter(F.col("question").isNotNull()).select("qa_id", "question", "answer", "source_text").distinct()
    qw = q.select("qa_id", F.explode(text.word_set(F.col("question"))).alias("w"))
    cw = chunks.select("chunk_id", F.explode(text.word_set(F.col("text"))).alias("w"))
    fr = cw.join(qw.select("w").distinct(), "w", "left_semi").groupBy("w").agg((1.0 / F.count("*")).alias("weight"))
    s = cw.join(fr, "w").join(qw, "w").groupBy("qa_id", "chunk_id").agg(F.round(F.sum("weight"), 9).alias("score"))
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy("qa_id").orderBy(F.desc("score"), "chunk_id"))).filter(F.col("rank") <= top_k)
    j = r.join(chunks.select("chunk_id", "text"), "chunk_id").join(q, "qa_id")
    empty = F.lit("")
    return j.select(F.col("qa_id").alias("query_id"), "rank", "chunk_id", F.col("text").alias("chunk"), F.coalesce("answer", empty).alias("answer"), F.coalesce("source_text", empty).alias("source"))


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(#{1,6})[ \t]+\S", 1))


def sections(docs: DataFrame, id_col: str, body: str, max_level: int = 6) -> DataFrame:
    """Sections by headings outside of fences: (id, section, level, title, start_line, lines); section 0 is what stands before any.

    The text stays in its row: lines are folded with array functions, nothing is shuffled.
    """
    lines = F.split(F.replace(F.col(body), F.lit("\r\n"), F.lit("\n")), "\n")
    start = F.struct(F.lit(False).alias("code"), F.array().cast("array<struct<line:int,level:int,title:string>>").alias("heads"), F.lit(0).alias("n"))

    def step(acc: Column, line: Column) -> Column:
        fence = line.rlike(r"^ {0,3}(```|~~~)")
        level = heading_level(line)
        head = ~acc["code"] & ~fence & (level > 0) & (level <= max_level)
        title = F.trim(F.regexp_replace(line, r"^#{1,6}[ \t]+|[ \t]+#*[ \t]*$", ""))
        one = F.array(F.struct((acc["n"] + 1).alias("line"), level.alias("level"), title.alias("title")))
        return F.struct(F.when(fence, ~acc["code"]).otherwise(acc["code"]).alias("code"), F.when(head, F.concat(acc["heads"], one)).otherwise(acc["heads"]).alias("heads"), (acc["n"] + 1).alias("n"))

    folded = docs.filter(F.col(body).isNotNull()).select(F.col(id_col).alias("id"), F.aggregate(lines, start, step).alias("f"))
    heads = F.concat(F.array(F.struct(F.lit(1).alias("line"), F.lit(0).alias("level"), F.lit("").alias("title"))), F.col("f.heads"))
    flat = folded.select("id", F.col("f.n").alias("n"), heads.alias("h")).select("id", "n", "h", F.posexplode("h").alias("section", "s"))
    after = F.coalesce(F.try_element_at("h", F.col("section") + 2)["line"] - 1, F.col("n"))
    return flat.select("id", "section", "s.level", "s.title", F.col("s.line").alias("start_line"), (after - F.col("s.line") + 1).alias("lines")).filter("lines > 0")
