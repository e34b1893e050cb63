"""Python source to graph: definitions, imports, inheritance, calls, and flows through them.

Each file is parsed once in its own task with the standard ``ast`` module; everything
that needs more than one file is a join. A file that does not parse gives a module only.
"""

from __future__ import annotations

import ast
import posixpath
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.session import cut

# fixed values: names of functions that look like entry points
ENTRY_NAMES = ("main", "run", "start", "serve", "execute", "dispatch", "handle", "process", "boot", "launch", "init", "setup")
ENTRY_PREFIXES = ("on_", "handle_", "process_", "run_", "dispatch_")

DEF = "path string, id string, parent string, kind string, label string, signature string, parameters array<string>, returns string, is_async boolean, docstring string, bases array<string>, line_start int, line_end int"
FACT = "path string, fact string, owner string, name string, target string, symbol string, pos int"
PARSED = f"what string, d struct<{', '.join(':'.join(x.split(' ', 1)) for x in DEF.split(', '))}>, f struct<{', '.join(':'.join(x.split(' ', 1)) for x in FACT.split(', '))}>"


def dotted(path: str) -> str:
    """Module name of a path: ``a/b.py`` is a.b, ``a/__init__.py`` is a."""
    return path.removesuffix(".py").removesuffix("/__init__").replace("/", ".")


def _absolute(path: str, level: int, module: str | None) -> str:
    """What a relative import names; level 1 is the file's own package."""
    if not level:
        return module or ""
    at = posixpath.dirname(path)
    for _ in range(level - 1):
        at = posixpath.dirname(at)
    base = at.replace("/", ".")
    return ".".join(x for x in (base, module or "") if x)


class _Reader:
    def __init__(self, path: str):
        self.path, self.module = path, f"code::{path}"
        self.defs: list[dict] = []
        self.facts: list[dict] = []

    def fact(self, kind: str, owner: str | None = None, name: str | None = None, target: str | None = None, symbol: str | None = None) -> None:
        self.facts.append({"path": self.path, "fact": kind, "owner": owner, "name": name, "target": target, "symbol": symbol, "pos": len(self.facts)})

    def define(self, node, id_: str, parent: str | None, kind: str, label: str, **more) -> None:
        self.defs.append(
            {"path": self.path, "id": id_, "parent": parent, "kind": kind, "label": label, "signature": None, "parameters": [], "returns": None, "is_async": False, "docstring": ast.get_docstring(node) if node is not None else None, "bases": [],
             "line_start": getattr(node, "lineno", 1), "line_end": getattr(node, "end_lineno", None)} | more
        )

    def read(self, source: str) -> None:
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError):
            self.define(None, self.module, None, "module", posixpath.basename(self.path).removesuffix(".py"), line_end=source.count("\n") + 1)
            return
        self.define(tree, self.module, None, "module", posixpath.basename(self.path).removesuffix(".py"), line_start=1, line_end=source.count("\n") + 1)
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                for a in node.names:
                    self.fact("import", self.module, a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0])
                    if not a.asname and "." in a.name:
                        self.fact("import", self.module, a.name, a.name)
            elif isinstance(node, ast.ImportFrom):
                base = _absolute(self.path, node.level, node.module)
                for a in node.names:
                    self.fact("import", self.module, a.asname or a.name, base, a.name)
        for node in tree.body:
            if isinstance(node, ast.ClassDef):
                self.read_class(node)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.read_function(node, self.module, None)

    def read_class(self, node: ast.ClassDef) -> None:
        id_ = f"{self.module}::{node.name}"
        bases = [ast.unparse(b).split(".")[-1] for b in node.bases]
        self.define(node, id_, self.module, "class", node.name, bases=bases)
        for i, b in enumerate(bases):
            self.fact("base", id_, b, None, str(i))
        for sub in node.body:
            if isinstance(sub, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.read_function(sub, id_, node.name)

    def read_function(self, node, parent: str, cls: str | None) -> None:
        id_ = f"{parent}::{node.name}"
        args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
        types = {a.arg: ast.unparse(a.annotation).strip("'\"").split(".")[-1] for a in args if a.annotation is not None}
        kind = "test" if node.name.startswith("test_") else "method" if cls else "function"
        self.define(
            node, id_, parent, kind, node.name, is_async=isinstance(node, ast.AsyncFunctionDef), parameters=[a.arg for a in args],
            returns=ast.unparse(node.returns) if node.returns else None, signature=f"{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}({ast.unparse(node.args)})",
        )
        # in the order of the text, of calls that begin together the outer one first
        for call in sorted((x for x in ast.walk(node) if isinstance(x, ast.Call)), key=lambda x: (x.lineno, x.col_offset)):
            if isinstance(call.func, ast.Name):
                self.fact("call", id_, call.func.id)
            elif isinstance(call.func, ast.Attribute) and isinstance(call.func.value, ast.Name):
                on = call.func.value.id
                if on in ("self", "cls") and cls:
                    self.fact("self_call", id_, call.func.attr, parent)
                elif on in types:
                    self.fact("typed_call", id_, call.func.attr, types[on])
                else:
                    self.fact("attr_call", id_, call.func.attr, on)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            r = _Reader(path)
            r.read(content)
            rows += [("def", d, None) for d in r.defs] + [("fact", None, f) for f in r.facts]
        yield pd.DataFrame(rows, columns=["what", "d", "f"])


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions and facts (imports, bases, calls) of (path, content); other files than .py and null contents are left out."""
    py = files.filter(F.col("path").endswith(".py") & F.col("content").isNotNull()).select("path", "content")
    got = cut(py.mapInPandas(_parse, PARSED))
    return got.filter("what = 'def'").select("d.*"), got.filter("what = 'fact'").select("f.*")


def import_table(defs: DataFrame, facts: DataFrame) -> DataFrame:
    """(path, name, module_id, symbol) of imports whose module is among the files; an imported submodule counts as module."""
    mods = defs.filter("kind = 'module'").select(F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/__init__$", ""), "/", ".").alias("target"), F.col("id").alias("module_id"))
    imp = facts.filter("fact = 'import'").select("path", "name", "target", "symbol")
    sub = imp.filter("symbol IS NOT NULL").select("path", "name", F.concat_ws(".", "target", "symbol").alias("target")).join(mods, "target").select("path", "name", "module_id", F.lit(None).cast("string").alias("symbol"), F.lit(0).alias("p"))
    whole = imp.join(mods, "target").select("path", "name", "module_id", "symbol", F.lit(1).alias("p"))
    best = sub.unionByName(whole).groupBy("path", "name").agg(F.min(F.struct("p", "module_id", "symbol")).alias("b"))
    return best.select("path", "name", "b.module_id", "b.symbol")


def import_edges(defs: DataFrame, facts: DataFrame) -> DataFrame:
    """(src, dst): a module imports a module, or what is in it; unknown modules by their dotted name."""
    imp = facts.filter("fact = 'import'").select("path", "owner", "name", "target").join(import_table(defs, facts), ["path", "name"], "left")
    own = F.when(F.col("module_id").isNotNull(), F.col("module_id")).otherwise(F.concat(F.lit("code::"), F.replace("target", F.lit("."), F.lit("/"))))
    return imp.select(F.col("owner").alias("src"), own.alias("dst")).filter("src <> dst").distinct()


def inherit_edges(defs: DataFrame, facts: DataFrame) -> DataFrame:
    """(src, dst, pos) from a class to those bases whose short name is that of one class only."""
    one = defs.filter("kind = 'class'").groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n"), F.min("id").alias("dst")).filter("n = 1")
    return facts.filter("fact = 'base'").select(F.col("owner").alias("src"), "name", F.col("symbol").cast("int").alias("pos")).join(one, "name").filter("src <> dst").select("src", "dst", "pos")


def ancestors(classes: DataFrame, inherits: DataFrame) -> DataFrame:
    """(cls, ancestor, depth, path): each class itself and its bases breadth first.

    path are the positions of the bases on the way, so (depth, path) is the order in which a
    search that takes bases as they are written comes by; of several ways the first counts,
    and a line of bases that comes back to itself ends there.
    """
    seen = front = cut(classes.select(F.col("id").alias("cls"), F.col("id").alias("ancestor"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("path")))
    up = inherits.select(F.col("src").alias("ancestor"), F.col("dst").alias("base"), "pos")
    depth = 0
    while not front.isEmpty():
        depth += 1
        nxt = front.join(up, "ancestor").groupBy("cls", "base").agg(F.min(F.array_append("path", F.col("pos"))).alias("path"))
        front = cut(nxt.select("cls", F.col("base").alias("ancestor"), F.lit(depth).alias("depth"), "path").join(seen.select("cls", "ancestor"), ["cls", "ancestor"], "left_anti"))
        seen = seen.unionByName(front)
    return seen


def call_edges(defs: DataFrame, facts: DataFrame) -> DataFrame:
    """Resolved calls (src, dst, tier, score, pos), the first resolution of each pair and where it stands.

    A free call goes to what its name was imported as, else to its own module; a call
    on self to the nearest class of the line of bases that has the method; one on an imported module to
    its function (EXTRACTED 1.0); one on an imported object or a parameter of a known class to
    the method (INFERRED 0.8). The target must exist and be another function.
    """
    imports = cut(import_table(defs, facts))
    known = defs.filter("kind <> 'module'").select(F.col("id").alias("dst"), "label", F.col("parent").alias("owner_id"))
    classes = defs.filter("kind = 'class'").select("id", "label")
    line = cut(ancestors(classes, inherit_edges(defs, facts)))
    methods = known.filter("owner_id IS NOT NULL").select(F.col("owner_id").alias("ancestor"), F.col("label").alias("name"), "dst")
    one = classes.groupBy(F.col("label").alias("type")).agg(F.count("*").alias("n"), F.min("id").alias("cls")).filter("n = 1").select("type", "cls")

    def member(calls: DataFrame) -> DataFrame:
        """Calls with (cls, name) to the nearest ancestor's method."""
        hit = calls.join(line, "cls").join(methods, ["ancestor", "name"])
        return hit.groupBy("owner", "pos").agg(F.min_by("dst", F.struct("depth", "path", "dst")).alias("dst"))

    ext = (F.lit("EXTRACTED").alias("tier"), F.lit(1.0).alias("score"))
    inf = (F.lit("INFERRED").alias("tier"), F.lit(0.8).alias("score"))
    free = facts.filter("fact = 'call'").select("path", "owner", "name", "pos").join(imports, ["path", "name"], "left")
    target = F.when(F.col("module_id").isNotNull() & F.col("symbol").isNotNull(), F.concat_ws("::", "module_id", "symbol")).otherwise(F.concat(F.lit("code::"), "path", F.lit("::"), "name"))
    a = free.select("owner", "pos", target.alias("dst"), *ext)
    b = member(facts.filter("fact = 'self_call'").withColumnRenamed("target", "cls").select("owner", "pos", "cls", "name")).select("owner", "pos", "dst", *ext)
    attr = facts.filter("fact = 'attr_call'").select("path", "owner", "pos", F.col("name").alias("fn"), F.col("target").alias("name")).join(imports, ["path", "name"])
    c = attr.filter("symbol IS NULL").select("owner", "pos", F.concat_ws("::", "module_id", "fn").alias("dst"), *ext)
    d = member(attr.filter("symbol IS NOT NULL").select("owner", "pos", F.concat_ws("::", "module_id", "symbol").alias("cls"), F.col("fn").alias("name"))).select("owner", "pos", "dst", *inf)
    e = member(facts.filter("fact = 'typed_call'").withColumnRenamed("target", "type").join(one, "type").select("owner", "pos", "cls", "name")).select("owner", "pos", "dst", *inf)
    all_ = a.unionByName(b).unionByName(c).unionByName(d).unionByName(e).join(known.select("dst"), "dst", "left_semi").filter("owner <> dst")
    first = all_.groupBy(F.col("owner").alias("src"), "dst").agg(F.min_by(F.struct("tier", "score", "pos"), "pos").alias("v"))
    return first.select("src", "dst", "v.tier", "v.score", "v.pos")


def entry_scores(defs: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, score): how much a function looks like an entry point."""
    fn = defs.filter(F.col("kind").isin("function", "method")).select("id", "label")
    callers = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    callees = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callees"))
    name = F.lower("label")
    prefix = F.lit(False)
    for p in ENTRY_PREFIXES:
        prefix = prefix | name.startswith(p)
    j = fn.join(callers, "id", "left").join(callees, "id", "left")
    s = (
        F.when(~F.col("label").startswith("_"), 0.2).otherwise(0.0)
        + F.when(F.col("callers").isNull(), 0.4).otherwise(0.0)
        + F.when(F.coalesce("callees", F.lit(0)) >= 2, 0.2).otherwise(0.0)
        + F.when(name.isin(*ENTRY_NAMES), 0.3).when(prefix, 0.25).otherwise(0.0)
    )
    return j.select("id", F.round(F.least(F.lit(1.0), s), 6).alias("score"))


def flows(defs: DataFrame, calls: DataFrame, least: float = 0.5, top: int = 30, max_depth: int = 8, branches: int = 5, min_steps: int = 3) -> DataFrame:
    """(flow, step, depth) from the best entry points; flows whose steps are a strict subset of another's are dropped.

    ``calls`` are (src, dst, pos); of a function with many the first ``branches`` in its text are followed.
    """
    w = Window.partitionBy("src").orderBy("pos", "dst")
    steps = cut(calls.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= branches).select("src", "dst"))
    entry = entry_scores(defs, calls).filter(F.col("score") >= least).orderBy(F.desc("score"), F.desc("id")).limit(top)
    front = cut(entry.select(F.col("id").alias("flow"), F.col("id").alias("step"), F.lit(0).alias("depth")))
    seen = front
    for i in range(1, max_depth + 1):
        nxt = front.join(steps, F.col("step") == F.col("src")).select("flow", F.col("dst").alias("step")).distinct()
        front = cut(nxt.join(seen.select("flow", "step"), ["flow", "step"], "left_anti").withColumn("depth", F.lit(i)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    sets = seen.groupBy("flow").agg(F.collect_set("step").alias("s")).filter(F.size("s") >= min_steps)  # a flow has at most branches ** max_depth steps, there are ``top`` of them
    a, b = sets.select("flow", "s"), sets.select(F.col("flow").alias("other"), F.col("s").alias("t"))
    # the entry points are at most ``top``, so this compares top * top sets
    under = a.join(b, (F.size("s") < F.size("t")) & (F.size(F.array_except("s", "t")) == 0), "left_semi")
    return seen.join(sets.select("flow").join(under.select("flow"), "flow", "left_anti"), "flow", "left_semi")


def graph_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a Python repository; pos is where a call stands, null for other edges."""
    defs, facts = parse_files(files)
    ext = (F.lit("EXTRACTED").alias("tier"), F.lit(1.0).alias("score"))
    none = F.lit(None).cast("int").alias("pos")
    contains = defs.filter("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("relation"), *ext, none)
    edges = (
        contains.unionByName(import_edges(defs, facts).select("src", "dst", F.lit("imports").alias("relation"), *ext, none))
        .unionByName(inherit_edges(defs, facts).select("src", "dst", F.lit("inherits").alias("relation"), *ext, none))
        .unionByName(call_edges(defs, facts).select("src", "dst", F.lit("calls").alias("relation"), "tier", "score", "pos"))
    )
    return defs, edges
