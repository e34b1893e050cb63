"""Words of a text apart from its outer form, and the longest common run of two texts with few edits."""

from __future__ import annotations

import re
import unicodedata
from html import unescape

import regex

MIN_WORDS, PER_EDIT = 16, 8
#: Longest gap between two matching words that is still bridged.
GAP = 6

_INVISIBLE = regex.compile(r"[\p{Cf}\p{Cc}--[\n\t\r\x0b\x0c\x85]]|\N{COMBINING GRAPHEME JOINER}|[︀-️]", regex.V1)
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,300}>|<!--[\s\S]{0,2000}?-->")
_BREAK = regex.compile(r"(?<=\p{L})[-‐‑][ \t]*(?:\r\n|[\n\r\v\f\u0085  ])[\s>#*|/]*(?=\p{L})")
_LINK = re.compile(r"\]\([^()\s]{0,300}\)")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case words; case, punctuation, markup, quoting, breaks, hyphens at them, invisible characters and width don't matter."""
    if not text:
        return []
    t = _INVISIBLE.sub("", text)
    if "&" in t:
        t = _INVISIBLE.sub("", unescape(t))
    if "<" in t:
        t = _TAG.sub(lambda m: " " if m[0][:3].lower() in ("<br", "<p>", "</p", "<li", "<di", "</d", "<td", "<tr", "<!-") else "", t)
    if "](" in t:
        t = _LINK.sub("]", t)
    t = _BREAK.sub("", t)
    t = t.translate(_SIGNS)
    return _WORD.findall(unicodedata.normalize("NFKC", t).lower())


#: Signs of emphasis and code within a word go; an apostrophe joins its parts.
_SIGNS = str.maketrans({"*": "", "`": "", "~": "", "_": "", "'": "", "’": "", "‘": ""})


def places(words: list[str]) -> dict[str, list[int]]:
    """Where each word stands."""
    at: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        at.setdefault(w, []).append(i)
    return at


def longest_passage(source_at: dict[str, list[int]], n_source: int, doc: list[str], least: int = MIN_WORDS, per_edit: int = PER_EDIT) -> tuple[int, int] | None:
    """(words, edits) of a passage of the source that the document holds with at most one edit in ``per_edit`` words.

    A common subsequence is built from matching words whose gaps are bridged by
    edits: a word replaced, dropped or added is one. For every end of it the earliest
    start for each number of edits is kept. Words of the source at its ends that are
    missing may count as edits as well. Null if no passage has ``least`` words.
    """
    rows: dict[int, dict[int, list[int]]] = {}
    top = n_source // per_edit
    best: tuple[int, int] | None = None
    for j, w in enumerate(doc):
        hits = source_at.get(w)
        if not hits:
            continue
        row: dict[int, list[int]] = {}
        for i in hits:
            start = [i] + [n_source] * top
            for b in range(j - 1, max(-1, j - GAP - 2), -1):
                before = rows.get(b)
                if before is None:
                    continue
                for a in range(i - 1, max(-1, i - GAP - 2), -1):
                    old = before.get(a)
                    if old is None:
                        continue
                    cost = max(i - a, j - b) - 1
                    for e in range(cost, top + 1):
                        s = old[e - cost]
                        if s < start[e]:
                            start[e] = s
            row[i] = start
            for e, s in enumerate(start):
                length = i - s + 1
                if length < least - 2 * top or length + (n_source - length) < least:
                    continue
                spare = n_source - length
                k = max(0, least - length)
                if k <= spare and per_edit * (e + k) <= length + k and (best is None or length + k - per_edit * (e + k) > best[0] - per_edit * best[1]):
                    best = (length + k, e + k)
        rows[j] = row
        rows.pop(j - GAP - 2, None)
    return best
