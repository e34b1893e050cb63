"""An inverted index kept on storage: built once, searched by reading the buckets of the query's terms."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators import retrieve

POSTING = "term string, id string, len int, tf bigint, weight double"


class SearchIndex:
    """Postings (term, id, len, tf, weight) bucketed by term, with the measures of the collection in one row beside them.

    A search reads the buckets of its terms only. The weight of a term is that of ``retrieve.bm25``, so
    both give the same scores. An index is written whole; a changed collection gets a new one.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.name = f"postings_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({POSTING}) USING parquet CLUSTERED BY (term) SORTED BY (term) INTO {buckets} BUCKETS LOCATION '{self.root}/postings'")

    def build(self, docs: DataFrame, id_col: str, body: Column) -> SearchIndex:
        """Index the words of ``body``; null texts count as empty documents, null ids are left out."""
        rows = docs.filter(F.col(id_col).isNotNull())
        terms = rows.select(F.col(id_col).cast("string").alias("id"), F.coalesce(body, F.lit("")).alias("body"))
        post = retrieve.postings(terms, "id", F.col("body"))
        n, words = terms.count(), post.agg(F.sum("tf")).head()[0] or 0
        df = post.groupBy("term").agg(F.count("*").alias("df"))
        raw = df.select("term", (F.ln(F.lit(float(n)) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
        floor = raw.agg(F.avg("raw")).head()[0] or 0.0
        weights = raw.select("term", F.when(F.col("raw") < 0, 0.25 * floor).otherwise(F.col("raw")).alias("weight"))
        full = post.join(weights, "term").select("term", "id", F.col("len").cast("int").alias("len"), "tf", "weight")
        full.repartition(self.buckets, "term").write.mode("append").format("parquet").bucketBy(self.buckets, "term").sortBy("term").option("path", f"{self.root}/postings").saveAsTable(self.name)
        self.spark.createDataFrame([(n, words / n if n else 0.0)], "docs bigint, mean double").write.parquet(f"{self.root}/measures")
        return self

    def search(self, query: list[str], top_k: int | None = None) -> DataFrame:
        """(id, score) above 0, a term as often as it is given; ids as strings."""
        told = self.spark.read.parquet(f"{self.root}/measures").head()
        times = F.element_at(F.create_map(*[x for t in sorted(set(query)) for x in (F.lit(t), F.lit(query.count(t)))]), F.col("term")) if query else F.lit(0)
        hit = self.spark.table(self.name).filter(F.col("term").isin(sorted(set(query))))
        tf, k1, b = F.col("tf"), retrieve.K1, retrieve.B
        part = times * F.col("weight") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / told["mean"])) if told["mean"] else F.lit(0.0)
        out = hit.select("id", part.alias("part")).groupBy("id").agg(F.sum("part").alias("score")).filter("score > 0")
        return out if top_k is None else out.orderBy(F.desc(F.round("score", 9)), "id").limit(top_k)

    def close(self) -> None:
        """Forget the session's name of the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
