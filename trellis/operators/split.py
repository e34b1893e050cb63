"""Text splitters: one text to numbered atoms, as array expressions under a registry of names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions import text

_SPLITTERS: dict[str, Callable[..., Column]] = {}


def register(name: str, f: Callable[..., Column]) -> None:
    if name in _SPLITTERS:
        raise ValueError(f"splitter {name!r} is registered already")
    _SPLITTERS[name] = f


def get(name: str) -> Callable[..., Column]:
    if name not in _SPLITTERS:
        raise ValueError(f"no splitter {name!r}; there are {', '.join(sorted(_SPLITTERS))}")
    return _SPLITTERS[name]


def names() -> list[str]:
    return sorted(_SPLITTERS)


def _passthrough(t: Column) -> Column:
    return F.when(F.trim(t) != "", F.array(t)).otherwise(F.array().cast("array<string>"))


def _sentences(t: Column) -> Column:
    """Fenced code stays whole; prose ends at line breaks and after full stops, marks of question and exclamation."""
    parts = text.all_matches(t, r"```[\s\S]*?```|" + text.SENTENCE)
    neat = F.transform(parts, lambda s: F.when(s.startswith("```"), s).otherwise(F.trim(F.regexp_replace(s, r"[ \t\r]+", " "))))
    return F.filter(neat, lambda s: s != "")


def _paragraphs(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, r"\n[ \t\r]*\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def _window(t: Column, size: int = 400, overlap: int = 50) -> Column:
    """Windows of ``size`` characters, neighbours sharing ``overlap``; the last starts before the end of the text."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window")
    starts = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda p: F.trim(F.substring(t, p + 1, F.lit(size)))), lambda s: s != "")


register("passthrough", _passthrough)
register("sentence", _sentences)
register("paragraph", _paragraphs)
register("fixed_window", _window)


def atoms(docs: DataFrame, id_col: str, body: str, splitter: str, **options) -> DataFrame:
    """(id, idx, atom); a null text has none."""
    parts = get(splitter)(F.col(body), **options)
    return docs.filter(F.col(body).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(parts).alias("idx", "atom"))


def llm_atoms(docs: DataFrame, id_col: str, body: str, ask: Callable[[str], list[dict]], rounds: int = 0) -> DataFrame:
    """Atoms from an injected function text -> [{"text", "type"}], asked again up to ``rounds`` times while it finds new ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["id"], pdf["body"]):
                seen: dict[str, tuple] = {}
                for n in range(rounds + 1):
                    found = {a["text"].strip(): (a.get("type") or "fact", n) for a in (ask(t) or []) if a.get("text", "").strip()}
                    new = {k: v for k, v in found.items() if k not in seen}
                    if not new:
                        break
                    seen |= new
                rows += [(i, k, a, *v) for k, (a, v) in enumerate(seen.items())]
            yield pd.DataFrame(rows, columns=["id", "idx", "atom", "ontology_type", "round"])

    picked = docs.filter(F.trim(body) != "").select(F.col(id_col).cast("string").alias("id"), F.col(body).alias("body"))
    return picked.mapInPandas(run, "id string, idx int, atom string, ontology_type string, round int")
