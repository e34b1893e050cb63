"""Deduplicating new batches against all history (problem 2): rotated block tables.

A fingerprint is a row of BLOCKS blocks of BYTES bytes, each byte taken from one minhash
value of the text's 4-character shingles. Table r keeps it rotated, so that block r leads
and the lowest bits of the bytes that come after it (the first 128 of them) follow. A
lookup is an exact match of the leading block; the bits that follow in the same rotation
must then differ in few places, and the texts must be alike.

``BlockStore`` keeps the tables and the accepted texts in the shared folder, bucketed: the
tables by (r, block), the texts by id. A batch is fingerprinted, its rows are sent to the
buckets, and the accepted ones are appended. History is neither fingerprinted nor shuffled
again, and of its texts only those of candidates enter the comparison.

Recall, from the minhash agreement: a pair of similarity s shares a block with
probability 1 - (1 - s^5)^38: 0.9991 at 0.70, 0.9999 at 0.735, 1 - 1e-7 from 0.8.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import shingles
from trellis.session import cut, shared_dir, shuffled, spread

BLOCKS, BYTES = 38, 5
SIMILARITY = 0.70
#: One-bit minhashes of a pair at similarity 0.70 differ in 15 % of 128 bits, 19.2 with a
#: deviation of 4.0; beyond 41 (5.4 deviations) a candidate is not checked further.
MAX_BITS = 41
BUCKETS = 32
_SEED = 20250101
TABLES = "block bigint, f0 bigint, f1 bigint, class_id bigint"
TEXTS = "class_id bigint, norm string"


def _rotations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pool = shingles.MinHash(BLOCKS * BYTES, _SEED)
    # for each table the bytes whose lowest bits follow the leading block, in the order of the rotation
    follow = (np.arange(1, BLOCKS)[None, :] + np.arange(BLOCKS)[:, None]) % BLOCKS
    follow = (follow[:, :, None] * BYTES + np.arange(BYTES)).reshape(BLOCKS, -1)[:, :128]
    table = shingles.mix64(np.arange(1, BLOCKS + 1).astype(np.uint64))
    for pdf in batches:
        ids, values = [], []
        for cid, norm in zip(pdf["class_id"], pdf["norm"]):
            g = shingles.grams(norm)
            if len(g):
                ids.append(cid)
                values.append(pool(g))
        if not ids:
            continue
        byte = (shingles.mix64(np.stack(values).astype(np.uint64)) >> np.uint64(8)) & np.uint64(255)
        lead = np.zeros((len(ids), BLOCKS), np.uint64)
        for j in range(BYTES):
            lead |= byte[:, j::BYTES] << np.uint64(8 * j)
        rest = np.packbits((byte & np.uint64(1)).astype(np.uint8)[:, follow], axis=2).view(np.int64)
        # the number of the table goes into the value that is matched
        block = shingles.mix64(lead ^ table).view(np.int64)
        yield pd.DataFrame({"block": block.ravel(), "f0": rest[:, :, 0].ravel(), "f1": rest[:, :, 1].ravel(), "class_id": np.repeat(np.array(ids, np.int64), BLOCKS)})


def block_tables(classes: DataFrame) -> DataFrame:
    """The rotated block tables of (class_id, norm): one row per class and table."""
    return spread(classes.select("class_id", "norm")).mapInPandas(_rotations, TABLES)


class BlockStore:
    """The accepted history of one collection: rotated block tables and texts, kept in a shared folder.

    ``BlockStore(spark, root)`` opens what lies under ``root``, empty or not. Appending a
    batch is two writes of new files; nothing that is there is written again. An append that
    fails may be repeated: a text that stands there twice is read once.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        tag = uuid.uuid4().hex
        self._names = {"tables": f"block_tables_{tag}", "texts": f"block_texts_{tag}"}
        for kind, columns, by in (("tables", TABLES, "block"), ("texts", TEXTS, "class_id")):
            spark.sql(f"CREATE TABLE {self._names[kind]} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{self.root}/{kind}'")

    def tables(self) -> DataFrame:
        return self.spark.table(self._names["tables"])

    def texts(self) -> DataFrame:
        return self.spark.table(self._names["texts"])

    def append(self, tables: DataFrame, texts: DataFrame) -> None:
        """Add the block tables (``TABLES``) and texts (``TEXTS``) of accepted records."""
        for kind, rows, by in (("tables", tables, "block"), ("texts", texts, "class_id")):
            # one file per bucket
            rows.repartition(self.buckets, by).write.mode("append").format("parquet").bucketBy(self.buckets, by).sortBy(by).option("path", f"{self.root}/{kind}").saveAsTable(self._names[kind])

    def close(self) -> None:
        """Forget the session's names of the tables; their files stay."""
        for name in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def lookup(new_tables: DataFrame, tables: DataFrame, new_text: DataFrame, text: DataFrame, similarity: float, earlier_only: bool) -> DataFrame:
    """Alike pairs (class_id, other_id) of new classes and classes in ``tables``.

    ``new_text`` and ``text`` have (class_id, norm). With ``earlier_only`` both are
    the same set, in which ids stand for the order, and only smaller ids are taken.
    """
    a = new_tables.select("block", "class_id", F.col("f0").alias("a0"), F.col("f1").alias("a1"))
    b = tables.select("block", F.col("class_id").alias("other_id"), F.col("f0").alias("b0"), F.col("f1").alias("b1"))
    apart = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    hits = shuffled(a, b, ["block"]).filter(apart <= MAX_BITS)
    if earlier_only:
        hits = hits.filter("other_id < class_id")
    pairs = hits.select("class_id", "other_id").distinct()
    told = shuffled(pairs, new_text.select("class_id", F.col("norm").alias("na")), "class_id")
    told = shuffled(told, text.select(F.col("class_id").alias("other_id"), F.col("norm").alias("nb")), "other_id")
    return told.filter(shingles.similarity_of("na", "nb") >= similarity).select("class_id", "other_id")


def settle(edges: DataFrame) -> DataFrame:
    """Which classes are accepted when they come in the order of their ids.

    ``edges`` are (class_id, other_id), other_id earlier and alike. A class is
    accepted if none of its earlier alike classes is. Each round decides all classes that
    have an accepted earlier one or none left open, and only the edges of the open ones
    go into the next; the rounds are as many as the longest chain of alternating
    decisions, not as the classes. Returns (class_id, accepted).
    """
    left = cut(edges.select("class_id", "other_id"))
    free = left.select(F.col("other_id").alias("class_id")).distinct()
    new = cut(shuffled(free, left.select("class_id").distinct(), "class_id", "left_anti").select("class_id", F.lit(True).alias("accepted")))
    done = new
    while True:
        known = new.select(F.col("class_id").alias("other_id"), "accepted")
        seen = cut(shuffled(left, known, "other_id", "left"))
        if seen.isEmpty():
            return done
        told = seen.groupBy("class_id").agg(F.max(F.coalesce("accepted", F.lit(False))).alias("hit"), F.max(F.col("accepted").isNull()).alias("waits"))
        new = cut(told.filter(F.col("hit") | ~F.col("waits")).select("class_id", (~F.col("hit")).alias("accepted")))
        done = done.unionByName(new)
        # of the edges of the open ones those to a refused one say nothing more
        left = shuffled(seen.filter("accepted IS NULL").select("class_id", "other_id"), new.select("class_id"), "class_id", "left_anti")


def _normal(records: DataFrame) -> DataFrame:
    """(chunk_id, norm, digest) of the records whose text has a shingle."""
    recs = records.filter(F.col("chunk_id").isNotNull() & F.col("text").isNotNull()).select("chunk_id", shingles.normal_form(F.col("text")).alias("norm")).filter(F.length("norm") >= shingles.GRAM)
    return recs.withColumn("digest", F.sha2(F.col("norm").cast("binary"), 256))


def begin(store: BlockStore, accepted: DataFrame) -> None:
    """The first history: every record of (chunk_id, text) counts as accepted."""
    texts = _normal(accepted).groupBy("digest").agg(F.min("chunk_id").alias("class_id"), F.first("norm").alias("norm")).select("class_id", "norm")
    texts = cut(texts)
    store.append(block_tables(texts), texts)


def dedup_batches(store: BlockStore, arrivals: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Hold arrivals against the accepted history and each other, and append what is accepted.

    ``arrivals``: (batch_no, chunk_id, text) of one or more later batches, whose order
    (batch_no, chunk_id) is that of chunk_id. Returns the cases (reused_id, chunk_id).

    A text too short for a shingle is alike to nothing: it is accepted, but not kept
    in the tables. Null texts and null ids are left out. Repeated rows are one.
    """
    recs = _normal(arrivals)
    classes = cut(recs.groupBy("digest").agg(F.min("chunk_id").alias("class_id"), F.first("norm").alias("norm")))
    members = shuffled(recs.select("chunk_id", "digest").distinct(), classes.select("digest", "class_id"), "digest").select("chunk_id", "class_id")
    text = classes.select("class_id", "norm")
    tables = cut(block_tables(text))

    old = cut(lookup(tables, store.tables(), text, store.texts(), similarity, earlier_only=False).groupBy("class_id").agg(F.min("other_id").alias("reused_id")))
    # what repeats history is settled; only the rest is held against itself
    rest = cut(shuffled(tables, old.select("class_id"), "class_id", "left_anti").select(*tables.columns))
    free = cut(lookup(rest, rest, text, text, similarity, earlier_only=True))
    taken = settle(free).filter("accepted").select(F.col("class_id").alias("other_id"))
    new = shuffled(free, taken, "other_id").groupBy("class_id").agg(F.min("other_id").alias("reused_id"))
    refused = cut(old.unionByName(new))
    # every later copy of an accepted text repeats that text
    cases = shuffled(members, refused, "class_id", "left").select(F.coalesce("reused_id", "class_id").alias("reused_id"), "chunk_id").filter("reused_id <> chunk_id")
    gone = refused.select("class_id")
    store.append(shuffled(rest, gone, "class_id", "left_anti").select(*tables.columns), shuffled(text, gone, "class_id", "left_anti").select("class_id", "norm"))
    return cases


def new_store(spark: SparkSession) -> BlockStore:
    """An empty store in the session's shared folder."""
    return BlockStore(spark, f"{shared_dir(spark)}/history-{uuid.uuid4().hex}")
