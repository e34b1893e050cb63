"""Functions paired with their documentation (problem 7).

One recursive pattern of the ``regex`` library reads comment lines, decorators,
signature (balanced brackets, strings protected) and the body with its own
docstring in one go. What the documentation says is then weighed: sections on
parameters, results and examples and the words of the function's name don't
count, nor do lines that only point elsewhere, direct a tool, state rights or
announce documentation.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 5

FUNCTION = regex.compile(
    r"""(?(DEFINE)
      (?P<str>[rRuUbBfF]{0,2}(?:\"\"\"(?:[^"\\]|\\.|"(?!""))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+'''|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'))
      (?P<bal>\((?:[^()\[\]{}'"\#]|(?&str)|\#[^\n]*|(?&bal))*+\)|\[(?:[^()\[\]{}'"\#]|(?&str)|\#[^\n]*|(?&bal))*+\]|\{(?:[^()\[\]{}'"\#]|(?&str)|\#[^\n]*|(?&bal))*+\})
    )
    (?P<above>(?:^[ \t]*\#[^\n]*\n)*+)
    (?P<decorators>(?:^[ \t]*@(?:[^\n()\[\]{}'"\#]|(?&str)|(?&bal)|\#[^\n]*)*+\n(?:^[ \t]*\#[^\n]*\n)*+)*+)
    ^(?P<indent>[ \t]*)(?P<signature>(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*(?:\[[^\]\n]*\][ \t]*)?(?&bal)[ \t]*(?:->(?:[^:'"\#\n()\[\]{}]|(?&str)|(?&bal))*+)?):
    (?P<body>[ \t]*(?:\#[^\n]*)?\n?
      (?P<start>(?:^[ \t]*\n|^(?P=indent)[ \t]+\#[^\n]*(?:\n|\Z))*+)
      (?:[ \t]*(?P<doc>(?&str))[ \t]*(?:\#[^\n]*)?(?:;|\n|\Z))?
      (?:(?&str)|\#[^\n]*|[^'"\#\n]|\n(?=(?P=indent)[ \t]|[ \t]*(?:\n|\Z))|['"])*+)""",
    regex.M | regex.X,
)
_HEADER = regex.compile(r"^(?:args|arguments|parameters|params|keyword args|keyword arguments|other parameters|returns?|yields?|raises|throws|examples?|usage|parameter|rückgabe|beispiele?)\s*:?\s*$", regex.I)
_INLINE_HEADER = regex.compile(r"^(?:args|arguments|parameters|params|returns?|yields?|raises|examples?)\s*:\s+\S", regex.I)
_FIELD = regex.compile(r"^\s*[:@](?:param|parameter|arg|argument|key|keyword|type|return|returns|rtype|raises?|throws?|yields?|ytype|example)\b", regex.I)
_RULE = regex.compile(r"^\s*[-=~]{3,}\s*$")
_WORD = regex.compile(r"\p{Han}|\p{Hiragana}|\p{Katakana}|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[\p{L}\p{M}\p{N}])+(?:['’-](?![\p{Han}])[\p{L}\p{N}]+)*")
_PART = regex.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
# fixed values: openings of lines that say nothing of the function
_EMPTY = regex.compile(
    r"""^\W{0,20}(?:
      (?:to\s?do|fixme|tbd|tba|wip|xxx|hack|n/?a)\b.*
    | (?:pylint|flake8|noqa|mypy|pyright|ruff|isort|fmt|yapf|type|pragma|coding|nosec|autopep8|black|pycharm|noinspection|cython|doctest)\s*[:=].*
    | (?:noqa|nosec|nopep8)\b.*
    | -\*-.*
    | (?:copyright|©|\(c\)|spdx-license-identifier|licen[sc]ed\s+under|all\s+rights\s+reserved|this\s+file\s+is\s+part\s+of)\b.*
    | (?:please\s+)?(?:see|see\s+also|refer\s+to|cf\.?|siehe|vgl\.?)\b.*
    | (?:for\s+(?:more\s+)?(?:details?|documentation|information|docs)\s*,?\s*(?:please\s+)?(?:see|refer)\b).*
    | \{?@?inherit-?doc\}?.*
    | (?:documentation|docs?|docstring|description|beschreibung|dokumentation)\s+(?:is\s+|are\s+)?(?:inherited|copied|to\s+follow|will\s+follow|follows|folgt|to\s+come|coming|pending|missing|needed|goes\s+here|later)\b.*
    | (?:.*\b)?(?:needs?|requires?)\s+(?:a\s+|some\s+|more\s+|proper\s+)?(?:description|documentation|docs?|docstring)\b.*
    | (?:to\s+be|will\s+be|not\s+yet)\s+(?:documented|described|written|added|done|completed)\b.*
    | (?:add|write|insert)\s+(?:a\s+|some\s+|the\s+)?(?:description|documentation|docs?|docstring)\b.*
    )\W*$""",
    regex.I | regex.X,
)
_SENTENCE = regex.compile(r"(?<=[.!?。！？])\s+")


def running_text(doc: str) -> str:
    """The documentation without its sections on parameters, results and examples."""
    lines = inspect.cleandoc(doc.expandtabs()).split("\n")
    out, i = [], 0
    while i < len(lines):
        line = lines[i]
        bare = line.strip()
        pad = len(line) - len(line.lstrip())
        if _HEADER.match(bare):
            ruled = i + 1 < len(lines) and _RULE.match(lines[i + 1])
            if ruled or bare.endswith(":"):
                i += 2 if ruled else 1
                while i < len(lines):
                    at = lines[i]
                    if not at.strip():
                        j = i
                        while j < len(lines) and not lines[j].strip():
                            j += 1
                        if j == len(lines) or len(lines[j]) - len(lines[j].lstrip()) <= pad:
                            i = j
                            break
                    elif not ruled and len(at) - len(at.lstrip()) <= pad:
                        break
                    i += 1
                continue
        if _INLINE_HEADER.match(bare) or _FIELD.match(line):
            i += 1
            while i < len(lines) and lines[i].strip() and len(lines[i]) - len(lines[i].lstrip()) > pad:
                i += 1
            continue
        if bare.startswith(">>>"):
            while i < len(lines) and lines[i].strip():
                i += 1
            continue
        if not _RULE.match(line):
            out.append(line)
        i += 1
    return "\n".join(out)


def says_something(doc: str | None, *names: str | None) -> bool:
    """Whether at least MIN_WORDS words are left besides those of the name and of lines that say nothing."""
    if not doc or not doc.strip():
        return False
    own = {p.lower() for n in names if n for p in _PART.findall(n)} | {n.strip().lower() for n in names if n}
    kept = []
    for part in regex.split(r"\n\s*\n", running_text(doc)):
        for sentence in _SENTENCE.split(" ".join(part.split())):
            if not _EMPTY.match(sentence):
                kept.append(sentence)
    words = [w for s in kept for w in _WORD.findall(s.replace("_", " ")) if w.lower() not in own]
    return len(words) >= MIN_WORDS


def _unquote(literal: str) -> str | None:
    """The value of a docstring literal; null if it is none (bytes and format strings are not)."""
    m = regex.match(r"([A-Za-z]*)(\"\"\"|'''|\"|')", literal)
    if set(m[1].lower()) & {"b", "f"}:
        return None
    return literal[m.end() : -len(m[2])]


def _comments(block: str) -> str:
    lines = [x.strip() for x in block.split("\n") if x.strip()]
    return "\n".join(x.lstrip("#").removeprefix(" ") if not x.startswith("#!") else "" for x in lines)


def read_function(content: str, metadata: str | None) -> dict[str, str | None]:
    """Name, signature, body and documentation of the first function in the content."""
    m = FUNCTION.search(content)
    try:
        meta = json.loads(metadata) if metadata else None
    except ValueError:
        meta = None
    doc = meta.get("docstring") if isinstance(meta, dict) else None
    doc = doc if isinstance(doc, str) and doc.strip() else None
    if m is None:
        return {"name": None, "signature": None, "code": content, "doc": doc}
    if doc is None and m["doc"]:
        text = _unquote(m["doc"])
        doc = text if text and text.strip() else None
    if doc is None:
        between = "\n".join(x for x in m["decorators"].split("\n") if x.lstrip().startswith("#"))
        doc = "\n\n".join(x for x in (_comments(m["above"]), _comments(between), _comments(m["start"])) if x.strip()) or None
    return {"name": m["name"], "signature": m["signature"], "code": m[0], "doc": doc}


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for seq, label, content, metadata in zip(pdf["node_seq"], pdf["label"], pdf["content"], pdf["metadata"]):
            f = read_function(content, metadata)
            if says_something(f["doc"], f["name"], label):
                rows.append((seq, f["name"] or (label or "").strip(), f["signature"], f["code"], inspect.cleandoc(f["doc"])))
        yield pd.DataFrame(rows, columns=["node_seq", "name", "signature", "code", "doc"])


def function_docs(tree_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Code-description pairs: (node_seq, name, signature, code, doc).

    Rows without content are left out, and so are those of another kind than function
    or method. Where the kind is null, that of the last row of the same id in
    ``nodes`` that has one counts. A broken metadata is as good as none. Repeated rows are one.
    """
    rows = tree_nodes.filter(F.col("content").isNotNull() & F.col("node_seq").isNotNull()).select("node_seq", "id", "kind", "label", "content", "metadata")
    wanted = ("function", "method")
    known = rows.filter(F.col("kind").isin(*wanted)).drop("id", "kind")
    open_ = rows.filter(F.col("kind").isNull() & F.col("id").isNotNull())
    kinds = nodes.filter(F.col("kind").isNotNull()).join(open_.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.max(F.struct("seq", "kind")).alias("k"))
    told = open_.join(kinds.filter(F.col("k.kind").isin(*wanted)).select("id"), "id", "left_semi").drop("id", "kind")
    pairs = known.unionByName(told).mapInPandas(_run, "node_seq bigint, name string, signature string, code string, doc string")
    return pairs.dropDuplicates(["node_seq"])
