"""Template residue, filler, error pages and notices on scripts (problem 10).

All lines of all documents are masked (numbers, paths, ids) and put into a prefix
tree of fixed depth: by the number of their tokens and the first DEPTH of them. In a leaf
lines that agree in most places are one template. A template is classified once: what its
lines say is told by seeds, patterns of known messages, and the template is a message if at
least half of its lines are. The verdict goes to every line of the template, so a line that
no pattern knows is a message if it stands among messages of its make, and a line that
looks like one is none if it stands among many that don't.

A second round goes by company: a line that no seed and no template knows, but which stands
in at least COMPANY documents, nearly always in ones that hold little else than messages, is
one as well.

Slots left unfilled in running text are found in the records themselves, and filler by
its words: pseudo-Latin, keyboard runs and repeated sentences have no function words
or no variety. A document is a case if it has an unfilled slot outside code and quotes, or if
messages and filler make up at least half of it, menu lines not counted.

Scale: a text is read once. Distinct masked lines are put in order by leaf, and a task goes
through them with the templates of one leaf in memory; lines of leaves without a seed end
there. What is joined back to the documents are the hashes of message lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from re import _parser

import ahocorasick
import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.session import cut, scratch_table, shuffled, spread_few

DEPTH, MERGE = 3, 0.6
#: Lines of a leaf that are kept until it is known whether it has a seed; those of longer leaves are all passed on.
HELD = 20_000
COMPANY, NEARLY = 3, 0.9
MOSTLY = 0.5
SALT = 8

_CODE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*\n(?:.*\n)*?(?: {0,3}\1[`~]*[ \t]*$|\Z)|<pre\b[\s\S]*?</pre\s*>|(?<!<error>)<code\b[\s\S]*?</code\s*>|(?<!`)(`+)(?!`)(?:[^`\n]|(?<!`)`(?!`)|\n(?!\s*\n))+?(?<!`)\2(?!`)", re.M | re.I)
# fixed values: the forms of an unfilled slot
SLOT = re.compile(
    r"""\{\{\s*[A-Za-z_][\w .-]{0,60}\}\}
    | \{%[^%\n{}]{1,80}%\} | <%=?[^%\n]{1,80}%> | \[\[?%=?[^%\n]{1,80}%\]\]?
    | \$\{\s*[A-Za-z_][\w.-]{0,60}\s*\} | \$\[\s*[A-Za-z_][\w .-]{0,60}\] | \#\{\s*[A-Za-z_][\w.]{0,60}\s*\}
    | %\([A-Za-z_]\w{0,60}\)[sdrif] | (?<![\w%])%[A-Z][A-Z_]{2,60}%(?!\w) | (?<![\w%])%[sd](?!\w)
    | @@[A-Z][A-Z_]{1,60}@@ | \#\#[A-Z][A-Z_]{1,60}\#\# | (?<!\w)__[A-Z][A-Z_]{1,60}__(?!\w)
    | <<\s*[A-Za-z_][\w -]{1,60}>>(?!>)
    | (?<![\w\\$}{\]])\{(?:\d{1,2}|[a-z][a-z_]{2,40})\}(?!\})
    | \[(?:your|my|insert|enter|add|fill\ in|tbd|todo|placeholder)\b[^\[\]\n]{0,60}\](?!\() | \[(?:tbd|todo|placeholder)\]
    | \[[^\[\]\n]{1,60}\b(?:here|à\ compléter|à\ remplir|einfügen|ausfüllen|eintragen|ergänzen|por\ completar|a\ completar|completar|rellenar|insertar)\](?!\()
    | [\[【][^\[\]【】\n]{0,30}(?:待填写|请填写|待补充|待定|填写)[^\[\]【】\n]{0,30}[\]】]
    | <(?:your|insert|enter|my)[- _][\w -]{1,60}> | <[a-z_-]{2,40}[-_ ]here>
    | …\s*[\w -]{1,60}\s(?:goes|comes|belongs)\shere\s*… | \.\.\.\s*[\w -]{1,60}\sgoes\shere\s*\.\.\.
    | (?<![\w/])XX[/.-]XX[/.-](?:XX|XXXX)(?![\w/])""",
    re.X | re.I,
)
_TRIGGER = re.compile(
    r"\{\{|\{%|<%|\[%|\$[\[{]|#\{|%\(|@@|<<|…|【|XX|xx/|##[A-Z]|__[A-Z]|%[A-Z]{3}|%[sd]\b|\{\w|\.\.\. ?\w|<(?:your|insert|enter|my)|[_-]here>"
    r"|\[(?:your|my|insert|enter|add|fill in|tbd|todo|placeholder)\b|(?:here|compléter|remplir|fügen|füllen|tragen|gänzen|completar|rellenar|insertar|填写|补充|待定)\]",
    re.I,
)
#: Every trigger has one of these.
_SIGN = re.compile(r"[{<%$@#_…【\[\]]|XX|xx|Xx|xX|\.\.\.")
_QUOTED = re.compile("[\"'“”„«»‘’「」`]")

_CODES = r"(?:4\d\d|5\d\d|<\*>)"
# fixed values: what messages say, from the start of a line
MESSAGES = [
    (
        "error",
        regex.compile(
            rf"""^\W{{0,20}}(?:
            (?:http\s*)?(?:error|erreur|fehler|código|error\s+code|status)\s*(?:code|status|http)?\s*[:#]?\s*{_CODES}(?!\w).*
          | http(?:/\S+)?\s*(?:status|error)?\s*[–:-]?\s*{_CODES}(?!\w).*
          | {_CODES}\s*[:–-]?\s*(?:bad\s+request|unauthori[sz]ed|forbidden|not\s+found|gone|internal\s+server\s+error|bad\s+gateway|service\s+(?:temporarily\s+)?unavailable|gateway\s+time-?out|method\s+not\s+allowed|too\s+many\s+requests|request\s+time-?out|payment\s+required)\b.*
          | (?:bad\s+request|unauthori[sz]ed|forbidden|(?:page|file|document|note)?\s*not\s+found|internal\s+server\s+error|bad\s+gateway|service\s+(?:temporarily\s+)?unavailable|gateway\s+time-?out)\W*
          | service\s+(?:is\s+)?(?:temporarily\s+|currently\s+)?unavailable\b.* | retry\s+(?:in|after)\s+\S+\s+\w+\W* | .{{0,60}}\bis\s+(?:currently\s+|temporarily\s+)?down\s+for\s+(?:scheduled\s+)?maintenance\b.*
          | \{{?"?error"?\s*:.* | <error>.* | <\?xml.*<error>.*
          | the\s+(?:page|note|document|url|site|resource)\s+(?:you|that\s+you|requested)\b.*\b(?:could\s+not|was\s+not|cannot|does\s+not|no\s+longer|not\s+be|been\s+(?:moved|removed|deleted))\b.*
          | (?:this|the)\s+(?:page|site|service|note|document)\s+(?:is|was|has|cannot|could|does|isn.t)\s+(?:currently\s+|temporarily\s+|not\s+|no\s+longer\s+|been\s+)*(?:unavailable|available|found|exist|removed|deleted|moved|down|be\s+(?:found|displayed|reached|loaded))\b.*
          | page\s+(?:not\s+found|does\s+not\s+exist).* | seite\s+(?:wurde\s+)?nicht\s+gefunden.* | die\s+(?:angeforderte|gewünschte|gesuchte)\s+seite\b.* | página\s+no\s+encontrada.* | (?:la\s+)?página\s+(?:solicitada|que\s+busca)\b.*
          | (?:la\s+)?page\s+(?:demandée|que\s+vous|introuvable|non\s+trouvée).* | 页面(?:不存在|未找到|无法).* | (?:您|你)?(?:访问|请求)的?页面.* | 服务器(?:内部)?错误.* | 访问被拒绝.*
          | (?:oops|sorry|whoops|hoppla|ups)\b[!,. ].{{0,12}}\b(?:something|the\s+page|this\s+page|an?\s+error|we\s+(?:could|can)|etwas|algo|page\s+not|das).* | something\s+went\s+wrong.* | an?\s+(?:unexpected\s+|internal\s+|unknown\s+)*error\s+(?:has\s+)?occurr?ed.* | etwas\s+ist\s+schief.* | algo\s+(?:ha\s+)?sali.*mal.* | une\s+erreur\s+est\s+survenue.*
          | access\s+(?:to\s+this\s+\w+\s+)?(?:is\s+|was\s+|has\s+been\s+)?denied\W.* | access\s+denied | permission\s+denied\b.* | zugriff\s+(?:wurde\s+)?(?:verweigert|abgelehnt).* | acceso\s+denegado.* | accès\s+(?:refusé|interdit).*
          | your\s+(?:request|connection|ip)\b.*\b(?:blocked|denied|rejected|failed|refused)\b.* | contact\s+the\s+(?:site\s+)?(?:owner|administrator|webmaster|support)\W*.{{0,30}}
          | too\s+many\s+(?:requests|attempts|connections)\b.* | limit\s+of\s+\S+\s+reached\b.* | rate\s+limit\s+exceeded.* | zu\s+viele\s+anfragen.* | demasiadas\s+solicitudes.* | trop\s+de\s+requêtes.*
          | your\s+session\s+(?:has\s+)?(?:expired|timed|ended).* | (?:diese|ihre)\s+sitzung\s+ist\s+abgelaufen.* | (?:su|la)\s+sesión\s+ha\s+(?:expirado|caducado).* | (?:votre|la)\s+session\s+a\s+expiré.* | 会话已过期.* | please\s+(?:sign|log)\s+in\b.* | bitte\s+melden\s+sie\s+sich\b.* | (?:you\s+must|you\s+need\s+to)\s+(?:be\s+logged|log|sign)\s+in\b.*
          | go\s+back\s+to\s+the\s+(?:start|home|main|front)\s*page\b.* | return\s+to\s+(?:the\s+)?(?:home|start)\s*page\b.* | volver\s+al\s+inicio\W* | zurück\s+zur\s+startseite\W* | retour\s+à\s+l.accueil\W* | (?:please\s+)?try\s+again\s+later\W* | código\s+{_CODES}\W*
          | upstream\s+(?:connect|request|server)\b.* | reset\s+reason\s*:.* | no\s+healthy\s+upstream\W* | connection\s+(?:refused|reset|timed\s+out|failed|closed)\b.* | request\s+(?:timed\s+out|failed|blocked)\b.* | (?:gateway|request|connection)\s+time-?out\W*
          | traceback\s+\(most\s+recent\s+call\s+last\)\W* | file\s+(?:"[^"]*"|<\*>),?\s+line\s+\S+.* | [A-Za-z_.]*(?:Error|Exception)\s*:.* | (?:fatal|parse|syntax|runtime)\s*(?:error)?\s*:.* | (?:warning|notice|fatal\s+error)\s*:\s.*\bon\s+line\b.* | uncaught\s+\w*(?:error|exception)\b.* | exception\s+in\s+thread\b.* | segmentation\s+fault.*
          | type\s*:\s*(?:status|exception)\s+report\W* | server\s*:\s*\S+\W* | (?:request|ray|trace|incident|reference)\s*(?:id|no|number)?\s*[:#]\s*\S+\W*
          | (?:we\s+are|site|system|currently)\s+(?:currently\s+)?(?:down\s+for|under|undergoing)\s+(?:scheduled\s+)?(?:maintenance|construction)\b.* | under\s+construction\W* | coming\s+soon\W*
        )$""",
            regex.I | regex.X,
        ),
    ),
    (
        "notice",
        regex.compile(
            r"""^\W{0,20}(?:<noscript>\W*)?(?:
            (?:please\s+|you\s+(?:need|have)\s+to\s+|you\s+must\s+|to\s+\w+(?:\s\w+){0,6},?\s+(?:please\s+)?)(?:enable|activate|allow|turn\s+on|switch\s+on)\b.*(?:java\s?script|scripts|cookies|browser).*
          | (?:enable|activate|allow|turn\s+on)\s+(?:java\s?script|scripts|cookies)\b.*
          | (?:java\s?script|scripts?|cookies)(?:\s+and\s+(?:java\s?script|scripts|cookies))?\s+(?:is|are|must|has|have|seems?|appears?|needs?)\s+(?:currently\s+|to\s+be\s+|be\s+|not\s+)*(?:disabled|required|needed|enabled|turned\s+off|switched\s+off|off|unavailable|blocked|supported|necessary)\b.* | java\s?script\s+(?:required|disabled|needed)\W*
          | turn\s+it\s+on\s+and\s+reload\W* | (?:then\s+)?reload\s+(?:the|this)\s+page\W*
          | (?:this|the|our)\s+[\w ]{1,40}\b(?:works?|runs?|functions?)\s+(?:only|best)\s+with\s+(?:java\s?script|scripts).* | (?:this|the|our)\s+[\w ]{1,40}\s(?:requires?|needs?)\s+(?:java\s?script|scripts|cookies)\b.* | (?:this|the)\s+(?:\w+\s+){1,3}cannot\s+be\s+(?:shown|displayed|loaded|viewed)\s+without\b.*
          | your\s+browser\s+(?:has\s+it|has\s+java|does\s+not|doesn.t|is\s+(?:not|out|too)|must|appears|seems)\b.* | checking\s+your\s+browser\b.* | (?:java\s?script|scripts)\s+and\s+cookies\s+are\s+required\b.* | loading\W+if\s+nothing\s+happens\b.* | (?:please\s+)?wait\s+while\s+(?:we|your\s+browser)\b.* | loading(?:\s+content)?\W*
          | bitte\s+(?:aktivieren|erlauben|schalten)\b.*(?:java\s?script|skripte?|cookies).* | (?:unser|dieser|diese|unsere|die)\s+[\wäöüß ]{1,40}\b(?:läuft|funktioniert|benötigt|braucht)\b.*(?:java\s?script|skript).* | java\s?script\s+ist\s+(?:deaktiviert|erforderlich|ausgeschaltet|nicht)\b.*
          | (?:es\s+necesario|por\s+favor,?|debe|necesita)\s+(?:habilit|activ|permit)\w*\s+(?:java\s?script|los\s+scripts|las?\s+cookies).* | (?:habilite|active|active?)\s+java\s?script\b.* | java\s?script\s+está\s+des\w+.*
          | (?:veuillez\s+)?(?:activez|activer|autorisez|autoriser)\s+(?:java\s?script|les\s+scripts|les\s+cookies)\b.* | java\s?script\s+(?:est|doit)\b.*(?:désactivé|activé|requis|nécessaire).* | (?:ce|cette|notre)\s+[\w ]{1,40}\s(?:nécessite|fonctionne)\b.*(?:java\s?script|scripts).*
          | 请(?:启用|开启|打开|允许).*(?:脚本|JavaScript).* | .{0,12}需要(?:启用|开启).*(?:脚本|JavaScript).* | (?:此|本)(?:页面|网站|查看器).*(?:脚本|JavaScript).*
        )$""",
            regex.I | regex.X,
        ),
    ),
    (
        "filler",
        regex.compile(
            r"""^\W{0,20}(?:
            lorem\s+ipsum\b.* | (?:dies|das|hier)\s+ist\s+(?:ein\s+|nur\s+(?:ein\s+)?)?(?:blindtext|platzhalter|fülltext|beispieltext)\w*\W* | blindtext\W* | texto\s+de\s+(?:relleno|ejemplo|prueba|muestra)\W* | (?:contenu|texte)\s+(?:fictif|factice|de\s+remplissage|provisoire)\W* | faux\s+texte\W*
          | (?:your|insert|add|enter)\s+(?:\w+\s+){0,2}(?:content|text|copy|title|description)\s+(?:goes\s+)?here\W* | (?:placeholder|dummy|sample|filler|example|test)\s+(?:text|content|copy|paragraph)\W* | (?:this|here)\s+is\s+(?:a\s+|some\s+|just\s+)*(?:placeholder|dummy|sample|filler)\s*(?:text|content|copy|paragraph)?\W* | the\s+quick\s+brown\s+fox\b.*
          | (?:此处|这里|这)?(?:为|是)?(?:一段)?(?:占位|示例|测试|填充)(?:文本|文字|内容|符)\W* | (?:在)?(?:此处|这里)(?:填写|输入|添加)(?:您的|你的)?(?:内容|文本|文字)\W*
        )$""",
            regex.I | regex.X,
        ),
    ),
]


def _rarity(strings: set[str]) -> tuple:
    return not strings & _FUNCTION, min(map(len, strings)), -len(strings)


def _needed(parsed) -> list[set[str]]:
    """Sets of strings, the rarest first: every match of a parsed pattern holds a string of each."""
    sets: list[set[str]] = []
    run = ""
    for op, arg in [*parsed, (None, None)]:
        # digits and masks differ between a line and its masked form, so what is needed must not hold them
        if op is _parser.LITERAL and not chr(arg).isdigit() and chr(arg) not in "<*> ":
            run += chr(arg)
            continue
        if run:
            sets.append({run.lower()})
            run = ""
        got: list[set[str]] = []
        if op is _parser.SUBPATTERN:
            got = _needed(arg[-1])
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and arg[0] > 0:
            got = _needed(arg[2])
        elif op is _parser.BRANCH:
            each = [_needed(x) for x in arg[1]]
            got = [set().union(*(x[0] for x in each))] if all(each) else []
        sets += got
    return sorted(sets, key=_rarity, reverse=True)


@cache
def alternatives() -> list[list[set[str]]]:
    """For each alternative of MESSAGES the sets of strings of each of which a line must hold one to match it."""
    out = []
    for _, pattern in MESSAGES:
        # the alternatives are the pattern's last branch of its own
        branch = [arg for op, arg in _parser.parse(pattern.pattern, re.I | re.X) if op is _parser.BRANCH][-1]
        for each in branch[1]:
            need = _needed(each)
            if not need:
                raise ValueError(f"an alternative of MESSAGES without a string that all of its lines hold: {each}")
            out.append(need)
    return out


@cache
def _marks() -> ahocorasick.Automaton:
    by: dict[str, list[list[set[str]]]] = {}
    for first, *rest in alternatives():
        for m in first:
            by.setdefault(m, []).append(rest)
    a = ahocorasick.Automaton()
    for m, rests in by.items():
        a.add_word(m, rests)
    a.make_automaton()
    return a


#: Letters that the patterns take for i and s where case doesn't matter.
_FOLD = str.maketrans({"İ": "i", "ı": "i", "ſ": "s"})


def may_be_message(line: str) -> bool:
    """Whether a line holds what some alternative of MESSAGES needs: no other line can match one, nor can a template it is merged into."""
    low = line.translate(_FOLD).lower()
    return any(all(any(w in low for w in x) for x in rest) for _, rests in _marks().iter(low) for rest in rests)


# fixed values: lines of a page's frame, which are neither content nor message
_FRAME = regex.compile(
    r"^\W{0,20}(?:skip\s+to\s+(?:main\s+)?content|menu|sign\s+in|log\s*in|sign\s+up|register|home|search|help|about|contact|imprint|impressum|privacy(?:\s+policy)?|terms(?:\s+of\s+(?:use|service))?|(?:home|notes|search|help|about|contact|start|blog|faq|login|menu)(?:\s*[|·>/–-]\s*\w+)+|(?:©|\(c\)|copyright)\s.{0,60})\W*$",
    regex.I,
)
# fixed values: frequent function words of the languages in Latin script
_FUNCTION = frozenset(
    "the of and to a is that it for on with as was by be at or from this are not but an have has had when which into who its one than then they there "
    "der die das und den dem des ein eine einen einer ist nicht mit für auf von zu sich im am wird werden bei nach vor aus ohne als "
    "le la les des du un une est pour que qui dans pas sur par avec ce cette aux ses sans chaque toutes à au avant "
    "el los las del una por con para su se al lo cada todas sin como antes".split()
)
# fixed values: words typed by habit where text is missing
_MASH = frozenset("asdf qwer qwerty jkl jklö hjkl zxcv yxcv foo bar baz qux blah bla xxx xyz test testing lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua".split())
_LATIN = regex.compile(r"[\p{Latin}]+(?:['’-][\p{Latin}]+)*")
_HAN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_PIECE = re.compile(r"(?<=[.!?])\s+(?=\S)|(?<=[。！？])|\n+")
_NUMBER = re.compile(r"\d+")


_LETTERS = re.compile(r"[^\W_]+")


def _size(piece: str) -> int:
    """Words, with two Han characters for one."""
    if piece.isascii():
        return len(_LETTERS.findall(piece))
    han = len(_HAN.findall(piece))
    return len(_LETTERS.findall(_HAN.sub(" ", piece) if han else piece)) + (han + 1) // 2


def has_slot(text: str) -> bool:
    """Whether an unfilled slot stands in running text: outside code, and not quoted as such."""
    if not _SIGN.search(text) or not _TRIGGER.search(text):
        return False
    for m in SLOT.finditer(text):
        s = m[0]
        if s[0] in "@#%_" and s[1] in "@#_" and not s.strip("@#%_").isupper():
            continue
        if s[0] == "%" and s[-1] == "%" and not s.strip("%").isupper():
            continue
        if s[0] in "xX" and s != s.upper():
            continue
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if _QUOTED.match(before or " ") and _QUOTED.match(after or " "):
            continue
        return True
    return False


def mask(line: str) -> str:
    """The line with what varies replaced: digits within words, numbers, paths."""
    words = line.split()
    if "/" in line:
        words = ["<*>" if "/" in w and len(w) > 3 and not w.startswith("<") else w for w in words]
    return _NUMBER.sub("<*>", " ".join(words))


def read_document(text: str) -> dict:
    """Word counts of a document: all, frame lines, filler; whether it has a slot; and its other lines, masked."""
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    prose = _CODE.sub(" \x01 ", t) if "`" in t or "~~~" in t or "<" in t else t
    pieces = [p.strip() for p in _PIECE.split(prose)]
    whole = _size(t)
    code = whole - _size(prose)
    frame = filler = 0
    lines: dict[str, list[int]] = {}
    repeats = Counter(p for p in pieces if p)
    many = sum(1 for p in pieces if p)
    for p in pieces:
        if not p:
            continue
        n = _size(p)
        if not n:
            continue
        if len(p) < 90 and _FRAME.match(p):
            frame += n
            continue
        words = [w.lower() for w in _LATIN.findall(p)]
        if many >= 4 and repeats[p] >= 4 and repeats[p] * 2 >= many:
            filler += n
        elif len(words) >= 4 and sum(w in _MASH for w in words) * 5 >= 4 * len(words):
            filler += n
        else:
            odd = n if len(words) >= 3 and len(words) * 2 >= n and not any(w in _FUNCTION for w in words) else 0
            got = lines.setdefault(mask(p), [0, 0])
            got[0] += n
            got[1] += odd
    return {"words": whole, "frame": frame, "filler": filler, "odd": 0, "code": code, "slot": has_slot(prose), "lines": [(k, v[0]) for k, v in lines.items()], "odds": [v[1] for v in lines.values()]}


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def leaf_of(masked: str) -> int:
    """The leaf of a masked line: the number of its tokens and the first DEPTH of them."""
    tokens = tokens_of(masked)
    return _hash(f"{len(tokens)} {' '.join(tokens[:DEPTH])}")


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = [read_document(t) for t in pdf["text"]]
        for g in got:
            g["odd"] = sum(g["odds"])  # those of lines that turn out to be messages are taken off again
        yield pd.DataFrame(
            {
                "doc_id": pdf["doc_id"],
                **{k: [g[k] for g in got] for k in ("words", "frame", "filler", "odd", "code", "slot")},
                "lines": [[{"h": _hash(a), "leaf": leaf_of(a), "masked": a, "size": b, "odd": c} for (a, b), c in zip(g["lines"], g["odds"])] for g in got],
            }
        )


SCAN = "doc_id bigint, words int, frame int, filler int, odd int, code int, slot boolean, lines array<struct<h:bigint,leaf:bigint,masked:string,size:int,odd:int>>"


def tokens_of(masked: str) -> list[str]:
    """The tokens by which a line goes into the tree: its words, Han characters one by one."""
    return masked.split(" ") if masked.isascii() else _HAN.sub(r" \g<0> ", masked).split()


class Leaf:
    """Templates of lines with equally many tokens and the same first ones."""

    def __init__(self, n: int, share: float = MERGE):
        self.n, self.share = n, share
        self.known: dict[str, int] = {"<*>": -1}
        self.rows = np.zeros((4, n), np.int32)
        self.count = 0

    def add(self, tokens: list[str]) -> int:
        """The template of a line: the one that agrees in most places, the first of equals, if that is a share of MERGE; else a new one."""
        ids = np.array([self.known.setdefault(t, len(self.known)) for t in tokens], np.int32)
        if self.count:
            same = (self.rows[: self.count] == ids).sum(axis=1)
            best = int(same.argmax())
            if same[best] >= self.share * self.n:
                self.rows[best][self.rows[best] != ids] = -1
                return best
        if self.count == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.count] = ids
        self.count += 1
        return self.count - 1


def verdict(line: str) -> str | None:
    """What the seeds say of a masked line: error, notice or filler; null for any other."""
    if not may_be_message(line):
        return None
    return next((kind for kind, pattern in MESSAGES if pattern.match(line)), None)


PLACED = "leaf bigint, template int, h bigint, kind string"


def _mine(held_most: int = HELD):
    """Lines (leaf, h, masked), ordered by leaf and line, with the template of each and what the seeds say of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tree, held, seeded = None, None, [], False
        for pdf in batches:
            out: list[tuple] = []
            for leaf, h, masked in zip(pdf["leaf"], pdf["h"], pdf["masked"]):
                tokens = tokens_of(masked)
                if leaf != at or len(tokens) != tree.n:
                    if seeded:
                        out += held
                    at, tree, held, seeded = leaf, Leaf(len(tokens)), [], False
                kind = verdict(masked)
                held.append((leaf, tree.add(tokens), h, kind))
                seeded = seeded or kind is not None
                if len(held) > held_most:
                    out += held
                    held, seeded = [], True
            yield pd.DataFrame(out, columns=["leaf", "template", "h", "kind"])
        yield pd.DataFrame(held if seeded else [], columns=["leaf", "template", "h", "kind"])

    return run


def template_verdicts(lines: DataFrame) -> DataFrame:
    """(h, kind) of the masked lines whose template is a message; ``lines`` has (h, leaf, masked), repeated or not."""
    one = lines.groupBy("leaf", "h").agg(F.first("masked").alias("masked"))
    # leaves are small in bytes but not in work, so they are spread by hand and not put together by AQE
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(one.repartition(tasks, "leaf").sortWithinPartitions("leaf", "masked").mapInPandas(_mine(), PLACED))
    votes = placed.groupBy("leaf", "template").agg(F.count("*").alias("n"), F.count("kind").alias("seeds"), F.mode("kind", True).alias("says"))
    told = votes.filter((F.col("seeds") > 0) & (F.col("seeds") * 2 >= F.col("n"))).select("leaf", "template", "says")
    return shuffled(placed.select("leaf", "template", "h"), told, ["leaf", "template"]).groupBy("h").agg(F.min("says").alias("kind"))


def _sums(scanned: DataFrame, lines: DataFrame, kinds: DataFrame) -> DataFrame:
    """Sizes of each document in words by kind: its own words, messages, filler, and what is neither."""
    many = kinds.select("h", "kind", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    hit = shuffled(lines.withColumn("salt", F.pmod("doc_id", F.lit(SALT)).cast("int")), many, ["h", "salt"])
    sums = hit.groupBy("doc_id").agg(*[F.sum(F.when(F.col("kind") == k, F.col("size")).otherwise(0)).alias(k) for k in ("error", "notice", "filler")], F.sum("told").alias("told"))
    all_ = shuffled(scanned.drop("lines").withColumnRenamed("filler", "mash"), sums, "doc_id", "left").fillna(0, ["error", "notice", "filler", "told"]).withColumn("odd", F.col("odd") - F.col("told"))
    own = F.col("words") - F.col("frame")
    odd = F.when(F.col("odd") * 10 >= (own - F.col("code")) * 9, F.col("odd")).when((F.col("filler") + F.col("mash") > 0), F.col("odd")).otherwise(0)
    wide = all_.withColumn("filler", F.col("filler") + F.col("mash") + F.when(F.col("odd") >= 8, odd).otherwise(0))
    return wide.withColumn("own", own).withColumn("bad", F.col("error") + F.col("notice") + F.col("filler"))


def by_company(lines: DataFrame, kinds: DataFrame, sums: DataFrame, mostly: float = MOSTLY) -> DataFrame:
    """(h, kind) of unknown lines that stand in at least COMPANY documents of messages, whose kind they take, and hardly ever in ordinary text.

    ``sums`` as from ``_sums``. A document that consists mostly of the line itself says nothing.
    """
    known = F.col("error") + F.col("notice")
    main = F.when((known > 0) & (known >= F.col("own") * mostly), F.when(F.col("error") >= F.col("notice"), "error").otherwise("notice"))
    docs = sums.select("doc_id", "own", main.alias("main"))
    there = shuffled(lines.select("doc_id", "h", "size"), docs.filter("main IS NOT NULL"), "doc_id")
    new = shuffled(there, kinds.select("h"), "h", "left_anti").groupBy("h").agg(F.count("*").alias("c"), F.mode("main", True).alias("kind")).filter(F.col("c") >= COMPANY)
    again = shuffled(lines.select("doc_id", "h", "size"), new.select("h"), "h", "left_semi")
    against = shuffled(again, docs.filter("main IS NULL"), "doc_id").filter(F.col("size") < F.col("own") * mostly).groupBy("h").agg(F.count("*").alias("n"))
    both = shuffled(new, against, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.filter(F.col("c") >= (F.col("c") + F.col("n")) * NEARLY).select("h", "kind")


def residue(documents: DataFrame, mostly: float = MOSTLY) -> DataFrame:
    """Documents to be excluded: (doc_id, slot, error, notice, filler, words), sizes in words.

    Null, empty and blank texts are no cases, nor are texts of frame lines only. Repeated
    rows count once; of an id with several texts the first in order counts. Further columns
    are ignored.
    """
    docs = documents.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    # texts are read where they lie; only what was read of them is shuffled
    read = spread_few(docs).mapInPandas(_scan, SCAN)
    scanned = scratch_table(read.groupBy("doc_id").agg(F.min(F.struct("words", "frame", "filler", "odd", "code", "slot", "lines")).alias("v")).select("doc_id", "v.*"), "residue")
    lines = scanned.select("doc_id", F.explode("lines").alias("l")).select("doc_id", "l.h", "l.leaf", "l.masked", "l.size", F.col("l.odd").alias("told"))
    sized = lines.select("doc_id", "h", "size", "told")
    kinds = cut(template_verdicts(lines.select("h", "leaf", "masked")))
    kinds = cut(kinds.unionByName(by_company(sized, kinds, _sums(scanned, sized, kinds), mostly)))
    told = _sums(scanned, sized, kinds)
    return told.filter(F.col("slot") | ((F.col("bad") > 0) & (F.col("bad") >= F.col("own") * mostly))).select("doc_id", "slot", *[F.col(c).cast("bigint").alias(c) for c in ("error", "notice", "filler", "words")])
