"""From documents to knowledge atoms: scan, propose, apply; decisions are logged and can be undone."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions import text, vec
from trellis.operators.levels import sections
from trellis.sources.vault import Conflict, Vault

TTL_HOURS = 24
REUSE_FROM = 0.90


def scan(docs: DataFrame, scanned_at: str) -> DataFrame:
    """Sections of the first two heading levels with the hash of their document: (scan_id, doc_path, doc_sha, section, title, start_line, lines, scanned_at).

    The id is made from path and hash, so a repeated scan of the same text is the same scan.
    """
    s = sections(docs, "path", "content", max_level=2)
    sha = F.concat(F.lit("sha256:"), F.sha2(F.col("content").cast("binary"), 256))
    d = docs.select(F.col("path").alias("id"), sha.alias("doc_sha"))
    return s.join(d, "id").select(F.sha2(F.concat_ws("|", "id", "doc_sha"), 256).alias("scan_id"), F.col("id").alias("doc_path"), "doc_sha", "section", "title", "start_line", "lines", F.to_timestamp(F.lit(scanned_at)).alias("scanned_at"))


def fresh(scans: DataFrame, now: str, hours: int = TTL_HOURS) -> DataFrame:
    """Scans that have not expired."""
    return scans.filter(F.col("scanned_at") > F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL '{hours}' HOUR"))


def stale(scans: DataFrame, docs: DataFrame) -> DataFrame:
    """Scans whose document has changed or is gone since."""
    now = docs.select(F.col("path").alias("doc_path"), F.concat(F.lit("sha256:"), F.sha2(F.col("content").cast("binary"), 256)).alias("now"))
    return scans.join(now, "doc_path", "left").filter(~F.col("doc_sha").eqNullSafe(F.col("now"))).drop("now")


def distinct_claims(claims: DataFrame) -> DataFrame:
    """The first claim per knowledge id, by section and title."""
    w = Window.partitionBy("knowledge_id").orderBy("section_id", "title")
    return claims.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def propose(claims: DataFrame, known: DataFrame, least: float = REUSE_FROM) -> DataFrame:
    """What to do with each claim (knowledge_id, title, vec): reuse the most similar known node, or create one.

    ``known`` has (id, vec). Claims of one document are few and are broadcast within
    Spark's own threshold; of equal similarities the smaller id is reused.
    """
    c = distinct_claims(claims)
    k = known.select(F.col("id").alias("reuse_id"), F.col("vec").alias("kv"))
    near = k.join(c.select("knowledge_id", F.col("vec").alias("cv")), F.col("reuse_id") != F.col("knowledge_id")).withColumn("s", vec.cosine(F.col("cv"), F.col("kv")))
    best = near.filter(F.col("s") >= least).groupBy("knowledge_id").agg(F.max(F.round("s", 9)).alias("similarity_score"), F.min_by("reuse_id", F.struct(-F.round("s", 9), "reuse_id")).alias("reuse_id"))
    out = c.drop("similarity_score", "reuse_id", "action").join(best, "knowledge_id", "left")
    return out.withColumn("action", F.when(F.col("reuse_id").isNotNull(), "reuse").otherwise("create"))


def snapshots(proposal: DataFrame, source_doc: str, at: str) -> DataFrame:
    """Log rows of a proposal's decisions; the id is made from document and claim, so applying twice logs the same."""
    state = F.to_json(F.struct(F.lit(0).alias("nodes"), F.lit(1).alias("edges")))
    return proposal.select(
        F.sha2(F.concat_ws("|", F.lit(source_doc), "knowledge_id"), 256).alias("decision_id"), F.lit(at).alias("timestamp"), "action", F.col("title").alias("claim_title"), F.lit(source_doc).alias("source_doc"),
        "similarity_score", state.alias("pre_state"), F.col("reuse_id").alias("reused_id"), F.lit(None).cast("string").alias("rollback_status"),
    )


def apply(vault: Vault, doc_path: str, doc_sha: str, proposal: list[dict]) -> list[str]:
    """Write a note for each created claim of a document; what is there already with the same text is left, so a broken run can be repeated.

    Raises Conflict if the document has changed since its scan. Returns the paths written.
    """
    if vault.read(doc_path)["hash"] != doc_sha:
        raise Conflict(f"{doc_path} has changed since it was scanned")
    written = []
    for c in proposal:
        if c.get("action") == "reuse":
            continue
        path = f"knowledge/{c['knowledge_id']}.md"
        head = {"knowledge_id": c["knowledge_id"], "title": c["title"], "ontology_type": c.get("ontology_type") or "unclassified", "atomized_from": doc_path}
        body = "---\n" + "".join(f"{k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in head.items()) + f"---\n\n{c['body']}\n"
        if (vault.root / path).exists() and (vault.root / path).read_text(encoding="utf-8") == body:
            continue
        vault.write(path, body)
        written.append(path)
    return written


class Registry:
    """Consecutive ids kept in a file, taken under a lock."""

    def __init__(self, path: str | Path, prefix: str = "KNOW"):
        self.path, self.prefix = Path(path), prefix

    def take(self, count: int = 1) -> list[str]:
        import fcntl

        if count < 1:
            raise ValueError("at least one id must be taken")
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with open(self.path.with_suffix(".lock"), "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            first = json.loads(self.path.read_text())["next"] if self.path.exists() else 1
            tmp = self.path.with_name(f"{self.path.name}.{uuid.uuid4().hex}")
            tmp.write_text(json.dumps({"next": first + count}))
            tmp.replace(self.path)
        return [f"{self.prefix}-{first + i:06d}" for i in range(count)]


def claim_vectors(claims: DataFrame) -> DataFrame:
    """Claims with a deterministic stand-in vector made of their words' hashes, for runs without an embedding service."""
    words = text.word_set(F.concat_ws(" ", "title", "body"))
    at = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))
    return claims.withColumn("vec", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.size(F.filter(at, lambda x: x == i)).cast("double")))
