"""Readers of documents, source code and media from a folder tree."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: folders that hold no documents; the last one is where this engine writes
EXCLUDED = (".git", ".obsidian", ".trash", ".DS_Store", "__pycache__", "node_modules", ".venv", "venv", ".env", "logs", ".pytest_cache", ".mypy_cache", "dist", "build", ".trellis")
MEDIA = {"image": ("png", "jpg", "jpeg", "gif", "webp", "svg"), "pdf": ("pdf",), "audio": ("mp3", "wav", "m4a", "ogg", "flac")}
PDF_LIMIT = 30_000
_FRONT = r"^---[ \t]*\r?\n([\s\S]*?)\r?\n---[ \t]*(?:\r?\n|$)"


def _relative(root: str) -> Column:
    """Path below the root."""
    base = root.rstrip("/").removeprefix("file://").lstrip("/")
    return F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), rf"^.*?\Q{base}\E/", "")


def _kept() -> Column:
    return ~F.exists(F.split("path", "/"), lambda p: p.isin(*EXCLUDED))


def read_texts(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """(path, content) of all matching files below the root, excluded folders left out. One row a file."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    return raw.select(_relative(root).alias("path"), F.col("value").alias("content")).filter(_kept())


def scalar(text: str):
    """A plain value of a front matter line."""
    t = text.strip()
    if len(t) > 1 and t[0] == t[-1] and t[0] in "'\"":
        return t[1:-1]
    if t.startswith("[") and t.endswith("]"):
        return [scalar(x) for x in t[1:-1].split(",") if x.strip()]
    low = t.lower()
    if low in ("", "null", "~"):
        return None
    if low in ("true", "false"):
        return low == "true"
    return int(t) if re.fullmatch(r"-?\d+", t) else float(t) if re.fullmatch(r"-?\d+\.\d+", t) else t


def front_matter(block: str) -> dict:
    """Keys, lists and one level of nesting of a front matter block; what cannot be read gives nothing."""
    out: dict = {}
    key = sub = None
    for line in block.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        pad, bare = len(line) - len(line.lstrip()), line.strip()
        if bare.startswith("- "):
            at = out.get(key) if sub is None else out[key].get(sub)
            if key is None or not isinstance(at, (list, type(None))):
                return {}
            at = [*(at or []), scalar(bare[2:])]
            if sub is None:
                out[key] = at
            else:
                out[key][sub] = at
            continue
        m = re.fullmatch(r"([\w .-]+?)\s*:(?:\s+(.*))?", bare)
        if not m:
            return {}
        if pad == 0:
            key, sub = m[1], None
            out[key] = scalar(m[2] or "")
        else:
            if not isinstance(out.get(key), dict):
                out[key] = {}
            sub = m[1]
            out[key][sub] = scalar(m[2] or "")
    return out


def _front_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([json.dumps(front_matter(x), ensure_ascii=False) if x else "{}" for x in s])


def documents(texts: DataFrame) -> DataFrame:
    """(path, front, body, content_hash): front matter as JSON, the body after it and the body's hash."""
    from pyspark.sql.types import StringType

    as_json = F.pandas_udf(_front_json, StringType())
    body = F.regexp_replace("content", _FRONT, "")
    return texts.select("path", as_json(F.regexp_extract("content", _FRONT, 1)).alias("front"), body.alias("body"), F.concat(F.lit("sha256:"), F.sha2(body.cast("binary"), 256)).alias("content_hash"))


def document_id(path: Column, front: Column) -> Column:
    """The knowledge id of the front matter, else the path without its extension."""
    return F.coalesce(F.get_json_object(front, "$.knowledge_id"), F.regexp_replace(path, r"\.[^./]+$", ""))


def knots(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that hold knowledge (by id or folder), and the others."""
    is_knot = F.get_json_object("front", "$.knowledge_id").isNotNull() | F.array_contains(F.split("path", "/"), "knowledge")
    return docs.filter(is_knot), docs.filter(~is_knot)


def media(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, content, content_hash) of media files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.lit(None).cast("string")
    for k, names in MEDIA.items():
        kind = F.when(ext.isin(*names), k).otherwise(kind)
    got = raw.select(_relative(root).alias("path"), "content").withColumn("kind", kind)
    return got.filter(F.col("kind").isNotNull() & _kept()).select("path", "kind", "content", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_hash"))


def pdf_texts(files: DataFrame) -> DataFrame:
    """(path, text) of PDF files, pages marked, at most PDF_LIMIT characters; needs pypdf, without which it is refused."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the package pypdf") from e

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pypdf

        for pdf in batches:
            out = []
            for c in pdf["content"]:
                pages = [f"--- Page {i} ---\n{p.extract_text() or ''}" for i, p in enumerate(pypdf.PdfReader(io.BytesIO(c)).pages, 1)]
                out.append("\n".join(pages)[:PDF_LIMIT])
            yield pd.DataFrame({"path": pdf["path"], "text": out})

    return files.filter("kind = 'pdf'").select("path", "content").mapInPandas(run, "path string, text string")


def media_nodes(texts: DataFrame, namespace: str = "nimbus") -> DataFrame:
    """A node per PDF file (path, text); its tokens are 0 if it has no text."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    tokens = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.length("text") / 4).cast("int")))
    return texts.select(F.col("path").alias("id"), name.alias("label"), F.lit("pdf").alias("kind"), F.lit(namespace).alias("namespace"), F.col("path").alias("source_file"), F.col("text").alias("content"), tokens.alias("tokens"))


class Source:
    """A kind of input: ``discover`` lists what is there, ``read`` gives it as rows."""

    glob = "*.md"

    def discover(self, spark: SparkSession, root: str) -> DataFrame:
        return read_texts(spark, root, self.glob).select("path").orderBy("path")

    def read(self, spark: SparkSession, root: str) -> DataFrame:
        return documents(read_texts(spark, root, self.glob))


class DocsSource(Source):
    """Notes that hold no knowledge of their own."""

    def read(self, spark: SparkSession, root: str) -> DataFrame:
        return knots(super().read(spark, root))[1]


class KnotSource(Source):
    """Notes that hold knowledge."""

    def read(self, spark: SparkSession, root: str) -> DataFrame:
        return knots(super().read(spark, root))[0]


class CodeSource(Source):
    """Python files."""

    glob = "*.py"

    def read(self, spark: SparkSession, root: str) -> DataFrame:
        return read_texts(spark, root, self.glob)


class AtomizeUnavailable(RuntimeError):
    """Memories must be atomized by hand first."""


class MemorySource(Source):
    """Memories can be listed, but not read as they are."""

    def read(self, spark: SparkSession, root: str) -> DataFrame:
        raise AtomizeUnavailable("memories are read through atomize: scan, propose, apply")
