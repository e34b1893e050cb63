import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.llm import align, bpe, funcdoc, leak, markup, residue


def _tiktoken():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Encoder(path, public_tokenizers.PATTERN)


def test_bpe_equals_public_encoder(spark):
    other, mine = _tiktoken()
    rnd = random.Random(2)
    texts = ["", "Hello world", "  two  spaces\n\n\tx", "aaaaaaaaaaaaaaaaaaaaaaaaaaab" * 40, "über Größe 漢字 नोट 👩‍👩‍👧", "<|endoftext|> it's", "\x00\u200b\ufeff"]
    texts += ["".join(rnd.choice("ab \n'é漢1.") for _ in range(rnd.randint(0, 200))) for _ in range(200)]
    for t in texts:
        assert mine.encode(t) == other.encode_ordinary(t)
        assert other.decode(mine.encode(t)) == t
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in df.select("doc_id", bpe.token_ids(F.col("text")).alias("ids")).collect()}
    assert got == {1: other.encode_ordinary("Hello world"), 2: [], 3: []}


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("Plain $5 to $9, a < b and c > d, 3 * 4 * 5, snake_case_name, C# and F#, a[0][1], R&D; x <- y => z", []),
        ("The path D:\\vault\\new is obsolete. (auto) or [off]", []),
        ("# Title\n\ntext", ["markdown"]), ("Title\n-----\n\ntext", ["markdown"]), ("a **bold** word", ["markdown"]), ("a _soft_ word", ["markdown"]), ("[x](y.md)", ["markdown"]), ("- one\n- two", ["markdown"]), ("> quoted", ["markdown"]), ("| a |\n|---|\n| b |", ["markdown"]),
        ("use `[[x]] <br> \\item` here", ["markdown"]), ("```\n== no == [[x]] <b>\n```", ["markdown"]),
        ("see [[Page|shown]]", ["wiki"]), ("== Head ==", ["wiki"]), ("{{Infobox|a=1}}", ["wiki"]), ("''soft'' word", ["wiki"]), ("It's Bo's note, not the others'.", []),
        ("<p>x</p>", ["html"]), ("a &nbsp;b", ["html"]), ("<!-- c -->", ["html"]), ("<pre><code># [[x]] **b**</code></pre>", ["html"]), ("<ul>\n  <li>one</li>\n</ul>", ["html"]),
        ("\\section{X}", ["latex"]), ("a $x_i = 2$ b", ["latex"]), ("\\begin{itemize}\n\\item one\n\\end{itemize}", ["latex"]), ("tier~\\cite{a}.", ["latex"]), ("\\(x \\geq 2\\)", ["latex"]),
        ("<b>x</b> and [[y]]", ["html", "wiki"]), ("<ul><li>a</li></ul>\n\n- own item", ["html", "markdown"]), ("", []),
    ],
)
def test_markup(text, kinds):
    assert markup.strip_markup(text)[1] == kinds


def test_clean_text_keeps_structure(spark):
    t = "<div>[a](1) [b](2) [c](3)</div>\n\n== Head ==\n\nThis is a **long** enough line of running text about <b>nodes</b>.\n\n\\begin{equation}\nx^2\n\\end{equation}\n\n* item one\n\n```\ncode  # [[x]]\n```\n"
    clean = markup.strip_markup(t)[0]
    assert "## Head" in clean and "running text about nodes" in clean and "code  # [[x]]" in clean and "x^2" in clean and "- item one" in clean and "**" not in clean
    df = spark.createDataFrame([("f", 1, t), ("f", 2, None), ("f", 3, ""), ("f", 1, t)], "rec_table string, rec_seq bigint, content string").withColumn("clean", F.lit(1))
    assert sorted((r["rec_seq"], len(r["markups"])) for r in markup.clean_documents(df).collect()) == [(1, 4), (1, 4), (3, 0)]


DOC = "Return the kept links of every note in order."


@pytest.mark.parametrize(
    "content, metadata, says",
    [
        (f'def f(a):\n    """{DOC}"""\n    return 1', "{}", True),
        ("def f(a):\n    return 1", f'{{"docstring": "{DOC}"}}', True),
        ("def f(a):\n    return 1", '{"docstring": "broken', False),
        (f'def f(a):\n    """{DOC}"""', '{"docstring": "TODO"}', False),
        (f"# {DOC}\n@deco(1)\nasync def f(a: dict = {{'x': ')'}}):\n    pass", None, True),
        (f"def f(a):\n    # {DOC}\n    pass", "{}", True),
        (f"# {DOC}\n\ndef f(a):\n    pass", "{}", False),
        (f'def f(a):\n    x = """{DOC}"""', "{}", False),
        (f'def f(a):\n    def inner():\n        """{DOC}"""\n    return inner', "{}", False),
        (f'def f(a):\n    f"""{DOC}"""', "{}", False),
        ('def load_all_new_note_links(a):\n    """Load all the new note links."""', "{}", False),
        ('def f(a):\n    """Args:\n        a: the value to look at in every case.\n\n    Returns:\n        the kept one of all these values."""', "{}", False),
        ('def f(a):\n    """Parameters\n    ----------\n    a : int\n        the upper bound of all values"""', "{}", False),
        (f'def f(a):\n    """{DOC}\n\n    :param a: x\n    """', "{}", True),
        ('def f(a):\n    """See the base class for all of the details."""', "{}", False),
        ("# pylint: disable=all\ndef f(a):\n    pass", "{}", False),
        ('def f(a):\n    """Documentation of this function is to follow in the next version."""', "{}", True),
        ('def f(a):\n    """TODO: write documentation for this function some day."""', "{}", False),
        ('def f(a):\n    """>>> f(1)\n    2 3 4 5 6 7"""', "{}", False),
        ("not code at all", "{}", False),
    ],
)
def test_documentation(content, metadata, says):
    f = funcdoc.read_function(content, metadata)
    assert funcdoc.says_something(f["doc"], f["name"]) is says


def test_function_pairs(spark):
    t = "node_seq bigint, id string, kind string, label string, content string, metadata string"
    code = f'def f(a):\n    """{DOC}"""'
    rows = [(1, "a", "function", "f", code, None), (1, "a", "function", "f", code, None), (2, "b", None, "f", code, None), (3, "c", None, "f", code, None), (4, "d", "class", "f", code, None), (5, "e", "method", "f", None, None), (6, None, None, "f", code, None)]
    n = spark.createDataFrame([("b", "method", 1), ("c", "method", 1), ("c", "class", 2)], "id string, kind string, seq bigint")
    got = funcdoc.function_docs(spark.createDataFrame(rows, t), n).collect()
    assert sorted((r["node_seq"], r["name"], r["signature"], r["doc"]) for r in got) == [(1, "f", "def f(a)", DOC), (2, "f", "def f(a)", DOC)]
    assert funcdoc.function_docs(spark.createDataFrame([], t), n).count() == 0


SOURCE = "Neither the ontology sheet at Zevu nor the minor context packer at Lapu survived 53 audits opposite the intake lane whereas Zevu settled on a ceiling of 934 for the whole year"


def _edit(rnd, words, edits):
    w = list(words)
    for _ in range(edits):
        i = rnd.randrange(1, len(w) - 1)
        w[i : i + 1] = rnd.choice([[], ["changed"], [w[i], "added"]])
    return w


def test_passages():
    src = align.words_of(SOURCE)
    at, n = align.places(src), len(src)
    assert align.longest_passage(at, n, src) == (n, 0)
    assert align.longest_passage(at, n, ["x"] * 9 + src[5:21] + ["y"] * 9) == (16, 0)
    assert align.longest_passage(at, n, ["x"] * 9 + src[5:17] + ["y"] * 9) is None
    wild = "<b>Neither</b> the&nbsp;ONTOLOGY sh\u00adeet at Ze\u200bvu, nor the mi-\nnor *context* `packer` at [Lapu](x.md) survived 53 audits ｏpposite"
    assert align.longest_passage(at, n, align.words_of(wild))[1] == 0
    rnd = random.Random(1)
    for _ in range(60):
        got = align.longest_passage(at, n, _edit(rnd, src, 2))
        assert got and got[1] <= got[0] // 8


def test_leaks(spark):
    rnd = random.Random(3)
    filler = lambda: " ".join(rnd.choice("alpha beta gamma delta the of and graph node edge cache note".split()) for _ in range(60))
    docs = [(i, filler()) for i in range(40)] + [(100, filler() + " " + SOURCE + " " + filler()), (101, " ".join(_edit(rnd, SOURCE.split(), 3))), (102, " ".join(SOURCE.split()[:10])), (103, None), (104, ""), (100, None)]
    qa = spark.createDataFrame([(1, "Who settled on a ceiling?", "Zevu", SOURCE), (2, None, None, SOURCE), (3, "short", "x", "short too"), (4, None, None, None)], "qa_id int, question string, answer string, source_text string")
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["qa_id"], r["answer"]) for r in leak.leaks(d, qa).collect())
    assert got == [(100, 1, True), (100, 2, False), (101, 1, True), (101, 2, False)]
    assert leak.leaks(d.limit(0), qa).count() == 0 and leak.leaks(d, qa.limit(0)).count() == 0


def test_leaks_under_the_gate(spark):
    """Passages of 16 words with two edits in long documents, where the latent gate finds nothing at all."""
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = [[rnd.choice(words) for _ in range(60)] for _ in range(30)]
    docs, want = [], set()
    for k, t in enumerate(texts):
        part = t[k : k + 16]
        part[5], part[11] = "unseen", "other"
        filler = [rnd.choice(words) for _ in range(40)]
        docs.append((k, " ".join(filler + part + filler[::-1])))
        want.add((k, k))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    qa = spark.createDataFrame([(k, None, None, " ".join(t)) for k, t in enumerate(texts)], "qa_id int, question string, answer string, source_text string")
    assert {(r["doc_id"], r["qa_id"]) for r in leak.leaks(d, qa, cosine=2.0).collect()} == want
    assert {(r["doc_id"], r["qa_id"]) for r in leak.leaks(d, qa).collect()} == want
    # more evaluation rows than are broadcast together go in blocks
    assert {(r["doc_id"], r["qa_id"]) for r in leak.leaks(d, qa, at_once=11).collect()} == want


def test_every_passage_has_a_run():
    rnd = random.Random(5)
    for n in (16, 17, 23, 24, 31, 40):
        for _ in range(200):
            source = [str(i) for i in range(n)]
            doc = source[:]
            for i in rnd.sample(range(n), n // align.PER_EDIT):
                doc[i] = rnd.choice(["x", "", f"{i} x"])
            doc = " ".join(doc).split()
            if align.longest_passage(align.places(source), n, doc):
                hashes = leak.word_hashes(" ".join(source)), leak.word_hashes(" ".join(doc))
                assert leak.Runs([hashes[0]]).texts(hashes[1]) == {0} and leak.may_hold(np.unique(hashes[0]), hashes[1])


GOOD = "The crawler logs a 404 Not Found for the page and goes on. Filler such as lorem ipsum must never enter the vault of the team."


@pytest.mark.parametrize(
    "text, case",
    [
        (GOOD, False), ("Template notes write `{{ name }}` for a field that is filled in later.", False), ("```\nhello {{ name }} and {x}\n```\nThe rest of the text is about the notes.", False), ('They write "{{ name }}" in the form of the team.', False),
        ("Dear {{ name }}, the notes of the team are ready for you.", True), ("The team of [INSERT NAME HERE] moved the notes.", True), ("The notes of ${TEAM} are in the vault.", True), ("The date is XX/XX/XXXX for the team.", True), ("The fee %(owner)s pays is low.", True),
        ("Set it to (auto) or [off], as before, with [a link](x.md) to the [x] list of 100% of the cases.", False),
        ("Please enable JavaScript to view this page.", True), ("Menu\nSign in\nError 404: Not Found", True), ("HTTP Status 503 – Service Unavailable\nType: status report\nServer: x", True), ('{"error": {"code": 404, "message": "Not Found"}}', True), ("页面不存在（404），请返回首页。", True),
        ('Traceback (most recent call last):\n  File "/srv/x/render.py", line 400, in render\nKeyError: \'body\'', True), ("```\nTraceback (most recent call last):\nKeyError: 1\n```\nThis is what the log of the server says when the body is missing.", False),
        ("asdf qwer jkl foo bar xxx blah test asdf", True), ("Texto de relleno. " * 5, True), ("Quareth opteros et habeta umbrae. Num silvae verumis quareth opteros num astere dolens. Lintus tundo ferum opteros.", True), ("Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor", True),
        ("", False), ("  \n", False), ("Menu\nSign in", False),
    ],
)
def test_residue(spark, text, case):
    g = residue.read_document(text)
    kinds = {a: residue.verdict(a) for a, _ in g["lines"]}
    bad = g["filler"] + sum(n for a, n in g["lines"] if kinds[a])
    own = g["words"] - g["frame"]
    odd = sum(o for (a, _), o in zip(g["lines"], g["odds"]) if not kinds[a])
    odd = odd if odd >= 8 and odd * 10 >= 9 * (own - g["code"]) else 0
    assert (g["slot"] or (bad + odd > 0 and bad + odd >= own * 0.5)) is case


def test_residue_over_tables(spark):
    rows = [(1, "Please enable JavaScript to view this page."), (1, "Please enable JavaScript to view this page."), (2, GOOD), (3, None), (4, ""), (5, "Dear {{ name }}, this is it."), (None, "Error 404"), (6, "Error 500: Internal Server Error"), (7, "Error 502: Bad Gateway")]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id bigint, text string, words string")
    assert sorted(r["doc_id"] for r in residue.residue(df).collect()) == [1, 5, 6, 7]
    assert residue.residue(df.limit(0)).count() == 0


MESSAGE_LINES = (
    "Zugriff verweigert|Acceso denegado|Accès refusé|HTTP 500|405 Method Not Allowed|402 Payment Required|This page is not available.|This page has been deleted.|The page you are looking for has been moved.|"
    "The site is currently down.|Das ist ein Beispieltext|Texto de ejemplo|Faux texte|Example text|示例文本"
).split("|")


def test_every_message_may_be_one(spark):
    assert all(a for a in residue.alternatives())
    assert all(residue.verdict(residue.mask(m)) and residue.may_be_message(m) for m in MESSAGE_LINES)
    d = spark.createDataFrame(list(enumerate(MESSAGE_LINES)), "doc_id bigint, text string")
    assert {r["doc_id"] for r in residue.residue(d).collect()} == set(range(len(MESSAGE_LINES)))


def test_templates_merge():
    tree = residue.Leaf(5)
    assert [tree.add(x.split()) for x in ("error <*> in node a", "error <*> in node b", "error <*> in edge c", "error <*> at all times")] == [0, 0, 0, 1]


def _found(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"] for r in residue.residue(d).collect()}


def test_the_tree_decides(spark):
    """A wording that no seed knows is a message among messages of its make; among ordinary lines what looks like one is none."""
    unknown = "Error 404: page was misplaced today"
    assert residue.verdict(residue.mask("Error 404: page was misplaced")) and not residue.verdict("Fault 12: the unit was misplaced today")
    kin = [f"The page you requested in vault {k} could not be {w} today" for k, w in enumerate(("found", "found yet", "loaded", "shown"))]
    new = "The page you requested in vault 9 might well be away today"
    assert residue.verdict(residue.mask(new)) is None
    got = _found(spark, [*kin, new, unknown, GOOD])
    assert got == {0, 1, 2, 3, 4, 5}
    looks = "Your request for the vault was denied today"
    others = [f"Your request for the {a} was {b} today" for a in ("map", "graph") for b in ("read", "kept", "filed")]
    assert _found(spark, [looks]) == {0} and _found(spark, [looks, *others]) == set()


def test_by_company(spark):
    """A line in a language without seeds, found only beside messages, is one; the same beside ordinary text is none."""
    odd = "Sivua ei valitettavasti voitu näyttää juuri nyt"
    pages = [f"Error {k}: Not Found. The page you requested could not be found on this server.\n{odd}" for k in (404, 410, 403)]
    assert _found(spark, [*pages, odd, GOOD]) == {0, 1, 2, 3}
    assert _found(spark, [*pages, odd, GOOD, *[f"{odd}\n{GOOD}"] * 3]) == {0, 1, 2}
