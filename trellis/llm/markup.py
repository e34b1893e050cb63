"""Markup residue in text documents (problem 6).

``strip_markup`` takes one text apart: code (fences, HTML pre blocks, code spans)
is set aside first, so that nothing in it counts as markup; then HTML, LaTeX,
wiki and Markdown are read in this order, each leaving plain text for the next.
Headings, list items, code blocks and formulas stay as lines of their own.

``line_blocks`` then keeps the text proper: the lengths of running text (without
link texts) are summed over a sliding window of lines; a surge of that sum opens a
stretch of content, a dive to nothing closes it, and what lies outside, such as
bars of links, goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("html", "latex", "markdown", "wiki")
WINDOW, SURGE = 3, 30

# fixed values: the element names of HTML that count as tags
TAGS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center cite code col colgroup "
    "data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html "
    "i iframe img input ins kbd label legend li link main map mark meta meter nav noscript object ol optgroup option output p param picture pre progress q rp rt ruby "
    "s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul "
    "var video wbr".split()
)
# fixed values: LaTeX commands that stand without an argument
BARE = (
    "item alpha beta gamma delta epsilon varepsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi varphi chi psi omega "
    "Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega le leq ge geq neq approx times cdot ldots cdots dots infty sum prod int in to rightarrow leftarrow "
    "LaTeX TeX maketitle tableofcontents newpage clearpage noindent bigskip medskip smallskip centering hline par quad qquad textbackslash"
)

_CODE = re.compile(
    r"(?P<fence>^ {0,3}(?P<f>`{3,}(?=[^`\n]*$)|~{3,})(?P<info>[^\n]*)\n(?P<fbody>(?:.*\n)*?)(?:^ {0,3}(?P=f)[`~]*[ \t]*$|\Z))"
    r"|(?P<pre><pre\b[^>]*>(?P<pbody>[\s\S]*?)</pre\s*>)"
    r"|(?P<span>(?<![`\\])(?P<t>`+)(?!`)(?P<sbody>(?:[^`\n]|`(?!(?P=t))|\n(?!\s*\n))+?)(?<!`)(?P=t)(?!`))",
    re.M | re.I,
)
_COMMENT = re.compile(r"<!--[\s\S]*?(?:-->|\Z)")
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")
_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+|[\w.+-]+@[\w-]+\.[\w.-]+)>")
_FORMULA = re.compile(
    r"\\begin\{(?P<env>(?:equation|align|gather|multline|displaymath|math|eqnarray)\*?)\}[\s\S]*?\\end\{(?P=env)\}"
    r"|(?<!\\)\$\$(?=\S|\n)[\s\S]+?\$\$|\\\((?:[^\n]|\n(?!\s*\n))+?\\\)|\\\[(?:[^\n]|\n(?!\s*\n))+?\\\]"
)
_INLINE = re.compile(r"(?<![\\$\w])\$(?=[^\s$])((?:[^$\n\\]|\\.)+?)(?<=[^\s\\])\$(?![\d$])")
_MATHS = re.compile(r"[\\^_=<>+]")
_WORD3 = re.compile(r"(?<![\\A-Za-z])[A-Za-z]{3,}")
_ENV = re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?")
_SECTION = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}")
_ITEM = re.compile(r"^[ \t]*\\item\b(?:\[[^\]\n]*\])?[ \t]*", re.M)
_COMMAND = re.compile(r"(?<!\\)\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}")
_BARE = re.compile(r"(?<![\w:\\/.])\\(?:" + "|".join(BARE.split()) + r")(?![A-Za-z])")
_DROPPED = frozenset("cite citep citet ref eqref pageref label bibliography bibliographystyle usepackage documentclass includegraphics input include".split())
_LEVEL = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
_WIKILINK = re.compile(r"!?\[\[(?=[^\s\[\]])(?![\d\s,.;-]+\]\])([^\[\]]+?)\]\]")
_TEMPLATE = re.compile(r"(?<![\\{])\{\{(?=[^\s{}])[^{}]*\}\}(?!\})")
_WIKIHEAD = re.compile(r"^(={1,6})[ \t]*(?=[^\s=])([^\n]*?[^\s=])[ \t]*\1[ \t]*$", re.M)
_APOSTROPHE = re.compile(r"(?<![\w'.,;:!?])('{5}|'{2,3})(?=[^\s'])((?:[^'\n]|'(?!')|\n(?!\s*\n))+?)(?<=[^\s'])\1(?!')")
_ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(?=[^\s#])([^\n]*?)[ \t#]*$", re.M)
_SETEXT = re.compile(r"^(?! {0,3}(?:[|>#=-]|[*+][ \t]|\d+[.)][ \t]))(?=[ \t]*\S)([^\n]+)\n {0,3}(={2,}|-{2,})[ \t]*$", re.M)
_TABLE = re.compile(r"^[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?|:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?)[ \t]*$\n?", re.M)
_ROW = re.compile(r"^[ \t]*\|(.*?)\|?[ \t]*$", re.M)
_QUOTE = re.compile(r"^ {0,3}(?:>[ \t]?)+(?=\S)(?:\[![A-Za-z]+\][+-]?[ \t]*)?", re.M)
_LIST = re.compile(r"^([ \t]*)(?:[-*+]|\d{1,9}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?(?=\S)", re.M)
_IMAGE = re.compile(r"!\[([^\[\]]*)\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:\s+[\"'][^\"'\n]*[\"'])?\)")
_LINK = re.compile(r"(?<![\\\[])\[((?:[^\[\]]|\n(?!\s*\n))+)\]\(<?[^()\s<>]*(?:\([^()\s]*\)[^()\s]*)*>?(?:\s+[\"'][^\"'\n]*[\"'])?\)")
_REFDEF = re.compile(r"^ {0,3}\[[^\]\n]+\]:[ \t]+\S[^\n]*$\n?", re.M)
_EMPHASIS = re.compile(
    r"(?<![\w*\\])(\*{1,3})(?=[^\s*])((?:[^*\n]|\n(?!\s*\n))+?)(?<=[^\s*\\])\1(?![\w*])"
    r"|(?<![\w\\_])(_{1,3})(?=[^\s_])((?:[^_\n]|(?<=\w)_(?=\w)|\n(?!\s*\n))+?)(?<=[^\s_\\])\3(?![\w_])"
    r"|(?<![~\w\\])(~~)(?=[^\s~])((?:[^~\n]|\n(?!\s*\n))+?)(?<=[^\s~])~~(?![~\w])"
)
_SLOT = re.compile("\x0e(\\d+)\x0f")
#: Characters that mark places while a text is taken apart; in a text they count as blanks.
_MARKS = str.maketrans("\x02\x03\x04\x0e\x0f", "     ")


def _formula(body: str) -> bool:
    """Whether what stands between two dollar signs is mathematics: prices and prose are not."""
    return bool(_MATHS.search(body)) or (bool(re.search("[A-Za-z]", body)) and not _WORD3.search(body) and len(body) < 40)


def strip_markup(text: str) -> tuple[str, list[str]]:
    """The text without markup, and which of KINDS occur in it.

    Headings become lines of ``#``, list items lines of ``-``, code blocks fences,
    formulas stay between their delimiters.
    """
    found: set[str] = set()
    kept: list[str] = []
    t = text.replace("\r\n", "\n").replace("\r", "\n").translate(_MARKS)

    def keep(s: str) -> str:
        kept.append(s)
        return f"\x0e{len(kept) - 1}\x0f"

    def code(m: re.Match) -> str:
        if m["fence"] is not None:
            found.add("markdown")
            return keep("```\n" + m["fbody"].rstrip("\n") + "\n```")
        if m["pre"] is not None:
            found.add("html")
            return "\n" + keep("```\n" + unescape(_TAG.sub("", m["pbody"])).strip("\n") + "\n```") + "\n"
        found.add("markdown")
        return keep(m["sbody"])

    def tag(m: re.Match) -> str:
        name = m[1].lower()
        if name not in TAGS:
            return m[0]
        found.add("html")
        if m[0][1] != "/":
            if name == "li":
                return "\n- "
            if len(name) == 2 and name[0] == "h" and name[1].isdigit():
                return "\n" + "#" * int(name[1]) + "\x02 "
        return " " if name in ("td", "th") else "\n" if name in ("br", "p", "div", "tr", "ul", "ol", "table", "li", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote") else ""

    def entity(m: re.Match) -> str:
        if m[1] and m[1] + ";" not in html5:
            return m[0]
        found.add("html")
        got = unescape(m[0])
        return keep(got) if got in "*_`<>[]{}$#=\\'|~" else got

    def formula(m: re.Match) -> str:
        found.add("latex")
        return keep(m[0])

    def inline(m: re.Match) -> str:
        return formula(m) if _formula(m[1]) else m[0]

    def command(m: re.Match) -> str:
        found.add("latex")
        return "" if m[1] in _DROPPED else m[2]

    def drop(kind: str, by: str = ""):
        def run(m: re.Match) -> str:
            found.add(kind)
            return by

        return run

    def wikilink(m: re.Match) -> str:
        found.add("wiki")
        if m[1].lower().startswith(("category:", "kategorie:", "file:", "image:", "datei:")):
            return ""
        target, bar, shown = m[1].rpartition("|")
        return "\x03" + (shown if bar else re.split(r"[#^]", shown, maxsplit=1)[0] or shown.lstrip("#^")) + "\x04"

    def heading(kind: str, level, body: int):
        def run(m: re.Match) -> str:
            found.add(kind)
            return "#" * level(m) + "\x02 " + m[body].strip()

        return run

    def link(m: re.Match) -> str:
        found.add("markdown")
        return "\x03" + m[1] + "\x04"

    def emphasis(m: re.Match) -> str:
        found.add("markdown")
        return m[2] or m[4] or m[6] or ""

    if "`" in t or "~~~" in t or "<pre" in t.lower():
        t = _CODE.sub(code, t)
    if "<" in t:
        t = _COMMENT.sub(drop("html"), t)
        t = _AUTOLINK.sub(link, t)
        t = _TAG.sub(tag, t)
    if "&" in t:
        t = _ENTITY.sub(entity, t)
    if "\\" in t or "$" in t:
        t = _FORMULA.sub(formula, t)
        if "$" in t:
            t = _INLINE.sub(inline, t)
        if "\\" in t:
            t = _SECTION.sub(heading("latex", lambda m: _LEVEL[m[1]], 2), t)
            t = _ENV.sub(drop("latex"), t)
            t = _ITEM.sub(drop("latex", "- "), t)
            while (n := _COMMAND.sub(command, t)) != t:
                t = n
            t = _BARE.sub(drop("latex"), t)
    if "[[" in t:
        t = _WIKILINK.sub(wikilink, t)
    if "{{" in t:
        while (n := _TEMPLATE.sub(drop("wiki"), t)) != t:
            t = n
    if "=" in t:
        t = _WIKIHEAD.sub(heading("wiki", lambda m: len(m[1]), 2), t)
    if "''" in t:
        while (n := _APOSTROPHE.sub(lambda m: (found.add("wiki"), m[2])[1], t)) != t:
            t = n
    if "#" in t:
        t = _ATX.sub(heading("markdown", lambda m: len(m[1]), 2), t)
    if "--" in t or "==" in t:
        t = _SETEXT.sub(heading("markdown", lambda m: 1 if m[2][0] == "=" else 2, 1), t)
        if _TABLE.search(t):
            found.add("markdown")
            t = _ROW.sub(lambda m: " ".join(x.strip() for x in m[1].split("|")), _TABLE.sub("", t))
    if ">" in t:
        t = _QUOTE.sub(drop("markdown"), t)
    if "[" in t:
        t = _REFDEF.sub(drop("markdown"), t)
        t = _LINK.sub(link, _IMAGE.sub(link, t))
    html_list = "html" in found or "latex" in found
    for m in _LIST.finditer(t):
        # items that HTML or LaTeX left behind start with '- ' right away
        if not (html_list and m[0] == "- "):
            found.add("markdown")
            break
    else:
        if html_list and "- " in t and _LIST.search(_own_lists(text)):
            found.add("markdown")
    t = _LIST.sub(r"\1- ", t)
    if "*" in t or "_" in t or "~~" in t:
        # level by level; every pass takes marks away
        while (n := _EMPHASIS.sub(emphasis, t)) != t:
            t = n
    return line_blocks(t, kept), sorted(found)


def _own_lists(text: str) -> str:
    """The text without code and tags, to tell Markdown items from those of HTML and LaTeX."""
    t = _CODE.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
    return _TAG.sub("", _COMMENT.sub("", t))


def line_blocks(stripped: str, kept: list[str]) -> str:
    """Line-block distribution over the stripped lines; structure stays with the text around it.

    Link texts (between the marks 3 and 4) don't count as running text. A stretch of
    content opens where the window's sum reaches SURGE and closes where it dives to
    0. Headings, items, code and formulas are content by themselves, and a text
    that never surges stays whole.
    """
    lines = [re.sub(r"[ \t]+", " ", x).rstrip() for x in stripped.split("\n")]
    full = [x for x in lines if x.strip(" \x02\x03\x04")]
    sizes = [len(re.sub("\x03[^\x04]*\x04|\\d+|\\W", "", x)) for x in full]
    sums = [sum(sizes[i : i + WINDOW]) for i in range(len(sizes))]
    inside, keep = False, []
    for i, x in enumerate(full):
        if not inside and sums[i] >= SURGE and sizes[i]:
            inside = True
        elif inside and sums[i] == 0:
            inside = False
        keep.append(inside or "\x02" in x or "\x0e" in x or x.lstrip().startswith("- "))
    if not any(s >= SURGE for s in sums):
        keep = [True] * len(full)
    out = "\n".join(re.sub("[\x02\x03\x04]", "", x).strip() if "\x0e" not in x else re.sub("[\x02\x03\x04]", "", x) for x, k in zip(full, keep) if k)
    while "\x0e" in out:
        out = _SLOT.sub(lambda m: kept[int(m[1])], out)
    return out


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = [strip_markup(c) for c in pdf["content"]]
        yield pd.DataFrame({"rec_table": pdf["rec_table"], "rec_seq": pdf["rec_seq"], "clean": [g[0] for g in got], "markups": [g[1] for g in got]})


def clean_documents(rows: DataFrame) -> DataFrame:
    """(rec_table, rec_seq, clean, markups) of (rec_table, rec_seq, content).

    Null contents are left out; an empty one gives an empty text and no markup.
    Repeated rows come out once each, as they went in; further columns are ignored.
    """
    picked = rows.filter(F.col("content").isNotNull()).select("rec_table", "rec_seq", "content")
    return picked.mapInPandas(_run, "rec_table string, rec_seq bigint, clean string, markups array<string>")


def vault_rows(files: DataFrame, tree_nodes: DataFrame) -> DataFrame:
    """The rows of the vault: Markdown files, and tree nodes of the vault's namespace."""

    def pick(df: DataFrame, name: str, seq: str, which: Column) -> DataFrame:
        return df.filter(which & F.col("content").isNotNull()).select(F.lit(name).alias("rec_table"), F.col(seq).alias("rec_seq"), "content")

    return pick(files, "files", "file_seq", F.col("path").endswith(".md")).unionByName(pick(tree_nodes, "tree_nodes", "node_seq", F.col("namespace") == "nimbus"))
