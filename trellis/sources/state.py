"""Readers and writers of graphs, vectors and logs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis import schema
from trellis.session import create_once

VERSION = "v4.0"


def read_log(spark: SparkSession, path: str, of: T.StructType, defaults: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of a log with a JSON object a line, missing fields at their defaults, and the lines that could not be read."""
    wide = T.StructType([*of.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("v"), "value")
    good = lines.filter(F.col("v._bad").isNull()).select("v.*").drop("_bad")
    for c, d in (defaults or {}).items():
        good = good.withColumn(c, F.coalesce(c, F.lit(d)))
    return good, lines.filter(F.col("v._bad").isNotNull()).select("value")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and communities of a graph kept as one JSON document; keys beside the known ones are kept out."""
    node = T.StructType([*schema.NODE.fields, T.StructField("community_id", T.StringType())])
    com = T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("god_nodes", T.ArrayType(T.StringType())), T.StructField("member_count", T.IntegerType()), T.StructField("internal_density", T.DoubleType())])
    edge = T.StructType([T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("relation", T.StringType()), T.StructField("confidence", T.StringType()), T.StructField("confidence_score", T.DoubleType()), T.StructField("weight", T.DoubleType())])
    doc = spark.read.schema(T.StructType([T.StructField("nodes", T.ArrayType(node)), T.StructField("edges", T.ArrayType(edge)), T.StructField("communities", T.ArrayType(com))])).option("multiLine", True).json(path)
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.*")
    edges = doc.select(F.posexplode("edges").alias("write_seq", "e")).select(
        F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.relation", F.col("e.confidence").alias("tier"), F.col("e.confidence_score").alias("score"), "e.weight", F.col("write_seq").cast("long").alias("write_seq")
    )
    return nodes, edges, doc.select(F.explode("communities").alias("c")).select("c.*")


def save_graph(nodes: DataFrame, edges: DataFrame, root: str) -> int:
    """Write a new version of the graph and make it the current one; readers of the old version are not disturbed.

    The version's folders are written in full before the pointer, a file with its
    number, appears under a name of its own; the highest counts.
    """
    spark = nodes.sparkSession
    version = (current_version(spark, root) or 0) + 1
    at = f"{root}/data/{version:08d}-{uuid.uuid4().hex[:8]}"
    nodes.write.parquet(f"{at}/nodes")
    edges.write.parquet(f"{at}/edges")
    meta = {"version": version, "format": VERSION, "path": at, "nodes": spark.read.parquet(f"{at}/nodes").count(), "edges": spark.read.parquet(f"{at}/edges").count()}
    jvm, fs, path = _fs(spark, root)
    tmp = path(f"{root}/tmp-{uuid.uuid4().hex}")
    out = fs.create(tmp, False)
    out.write(bytearray(json.dumps(meta).encode()))
    out.close()
    fs.mkdirs(path(f"{root}/versions"))
    if not create_once(spark, tmp, path(f"{root}/versions/{version:08d}.json")):
        raise RuntimeError(f"version {version} was written by another process")
    return version


def _fs(spark: SparkSession, root: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return jvm, path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def current_version(spark: SparkSession, root: str) -> int | None:
    _, fs, path = _fs(spark, root)
    at = path(f"{root}/versions")
    if not fs.exists(at):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return max((int(n.split(".")[0]) for n in names if n.endswith(".json")), default=None)


def load_graph(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a saved version, the current one by default."""
    v = version or current_version(spark, root)
    if v is None:
        raise FileNotFoundError(f"no graph under {root}")
    meta = json.loads(spark.read.text(f"{root}/versions/{v:08d}.json").head()[0])
    return spark.read.parquet(f"{meta['path']}/nodes"), spark.read.parquet(f"{meta['path']}/edges")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with the given rows in place of those with their keys."""
    return table.join(rows.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def hotpot(rows: DataFrame) -> DataFrame:
    """Cases of ten paragraphs as (question, answer, title, paragraph, gold) from nested columns."""
    flat = rows.select("question", "answer", "supporting_titles", F.posexplode(F.arrays_zip("context_titles", "context_paragraphs")).alias("pos", "c"))
    return flat.select("question", "answer", "pos", F.col("c.context_titles").alias("title"), F.col("c.context_paragraphs").alias("paragraph"), F.array_contains("supporting_titles", F.col("c.context_titles")).alias("gold"))


def propositions(rows: DataFrame) -> DataFrame:
    """(title, section, content, targets) from sources of the form ``Title: .. Section: .. Content: ..`` and JSON lists."""
    p = r"(?s)^Title:\s*(.*?)\.\s*Section:\s*(.*?)\.\s*Content:\s*(.*)$"
    return rows.select(*[F.regexp_extract("source", p, i + 1).alias(n) for i, n in enumerate(("title", "section", "content"))], F.from_json("targets", "array<string>").alias("targets"))


def export_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as folders of JSON lines under the names that ``read_graph`` knows them by."""
    nodes.write.json(f"{path}/nodes")
    named = {"src": "source", "dst": "target", "tier": "confidence", "score": "confidence_score"}
    edges.select(*[F.col(c).alias(named.get(c, c)) for c in edges.columns]).write.json(f"{path}/edges")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Community reports (community_id, title, summary, rating, findings) of a JSON list; none if there is no such file."""
    kind = "community_id string, title string, summary string, rating double, findings array<string>"
    _, fs, hadoop = _fs(spark, path)
    if not fs.exists(hadoop(path)):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).option("multiLine", True).json(path).filter(F.col("community_id").isNotNull())


class VersionedTable:
    """A small state table (observed edges, the inbox) that is rewritten whole and read in its last version.

    A version's rows are written first and named last, by a file that is made once, so readers see
    the old rows or the new ones; ``compact`` drops the rows of versions before the last ``keep``.
    """

    def __init__(self, spark: SparkSession, root: str, of: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), of

    def read(self) -> DataFrame:
        v = current_version(self.spark, self.root)
        if v is None:
            return self.spark.createDataFrame([], self.schema)
        at = json.loads(self.spark.read.text(f"{self.root}/versions/{v:08d}.json").head()[0])["path"]
        return self.spark.read.schema(self.schema).parquet(at)

    def write(self, rows: DataFrame) -> int:
        version = (current_version(self.spark, self.root) or 0) + 1
        at = f"{self.root}/data/{version:08d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(at)
        _, fs, path = _fs(self.spark, self.root)
        tmp = path(f"{self.root}/tmp-{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps({"path": at}).encode()))
        out.close()
        fs.mkdirs(path(f"{self.root}/versions"))
        if not create_once(self.spark, tmp, path(f"{self.root}/versions/{version:08d}.json")):
            raise RuntimeError(f"version {version} was written by another process")
        return version

    def compact(self, keep: int = 1) -> int:
        """Delete the rows of all but the last ``keep`` versions; their names stay. Returns how many folders went."""
        v = current_version(self.spark, self.root) or 0
        _, fs, path = _fs(self.spark, self.root)
        at = path(f"{self.root}/data")
        gone = [s.getPath() for s in (fs.listStatus(at) if fs.exists(at) else []) if int(s.getPath().getName().split("-")[0]) <= v - keep]
        for p in gone:
            fs.delete(p, True)
        return len(gone)
