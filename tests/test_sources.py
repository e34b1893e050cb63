import json

import pytest

from trellis import schema
from trellis.operators import code
from trellis.sources import files, state


@pytest.fixture()
def vault(tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "knowledge").mkdir()
    (tmp_path / "notes/a.md").write_text("---\ntitle: A note\ntags: [x, 'y z']\nrelations:\n  refines:\n    - b\n---\nBody [[b]]\n")
    (tmp_path / "notes/b c.md").write_text("plain")
    (tmp_path / ".git/no.md").write_text("no")
    (tmp_path / "knowledge/k.md").write_text("---\nknowledge_id: KNOW-000007\n---\nk")
    (tmp_path / "notes/p.png").write_bytes(b"\x89PNG")
    return tmp_path


def test_vault(spark, vault):
    t = files.read_texts(spark, str(vault))
    docs = files.documents(t)
    got = {r["path"]: r for r in docs.collect()}
    assert set(got) == {"notes/a.md", "notes/b c.md", "knowledge/k.md"}
    assert json.loads(got["notes/a.md"]["front"]) == {"title": "A note", "tags": ["x", "y z"], "relations": {"refines": ["b"]}}
    assert got["notes/a.md"]["body"] == "Body [[b]]\n"
    ids = {r[0] for r in docs.select(files.document_id(docs["path"], docs["front"])).collect()}
    assert ids == {"notes/a", "notes/b c", "KNOW-000007"}
    k, d = files.knots(docs)
    assert (k.count(), d.count()) == (1, 2)
    assert [(r["path"], r["kind"]) for r in files.media(spark, str(vault)).collect()] == [("notes/p.png", "image")]
    assert files.front_matter("a: [") == {"a": "["} and files.front_matter("??") == {}


def test_logs_and_graph(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"edge_id": "e", "confidence": 0.5}\n{broken\n')
    good, bad = state.read_log(spark, str(p), schema.PROBE, {"consecutive_seen": 0})
    assert [(r["edge_id"], r["consecutive_seen"]) for r in good.collect()] == [("e", 0)]
    assert bad.count() == 1
    g = tmp_path / "graph.json"
    g.write_text(json.dumps({"nodes": [{"id": "a", "label": "A", "extra": 1}], "edges": [{"source": "a", "target": "b", "relation": "r"}], "communities": []}))
    n, e, c = state.read_graph(spark, str(g))
    assert (n.count(), e.head()["dst"], c.count()) == (1, "b", 0)
    root = f"file://{tmp_path}/store"
    assert state.save_graph(n, e, root) == 1 and state.save_graph(n.limit(0), e, root) == 2
    assert state.load_graph(spark, root)[0].count() == 0 and state.load_graph(spark, root, 1)[0].count() == 1
    v = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, state.upsert(v, spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), "k").collect())) == [("a", 1), ("b", 3), ("c", 4)]


UTIL = "def helper():\n    pass\n\ndef other():\n    helper()\n"
CORE = '''import pkg.util
from .util import helper as h
from pkg.util import other

class Base:
    def run(self):
        self.step()
    def step(self):
        """Steps."""

class Derived(Base):
    async def go(self, x: Base):
        self.step()
        x.run()
        h()

def main():
    other()
    top()
    h()

def top(d: Derived):
    d.go(d)
    unknown()
'''


def test_code_graph(spark):
    df = spark.createDataFrame([("pkg/util.py", UTIL), ("pkg/core.py", CORE), ("pkg/bad.py", "def ("), ("x.md", "no"), ("n.py", None)], "path string, content string")
    defs, edges = code.graph_of(df)
    kinds = {r["id"]: r["kind"] for r in defs.collect()}
    assert kinds["code::pkg/core.py::Derived::go"] == "method" and kinds["code::pkg/bad.py"] == "module"
    e = {(r["src"].split("::", 1)[1], r["dst"].split("::", 1)[1]): (r["tier"], r["score"]) for r in edges.filter("relation = 'calls'").collect()}
    c = "pkg/core.py::"
    assert e == {
        ("pkg/util.py::other", "pkg/util.py::helper"): ("EXTRACTED", 1.0), (c + "Base::run", c + "Base::step"): ("EXTRACTED", 1.0), (c + "Derived::go", c + "Base::step"): ("EXTRACTED", 1.0), (c + "Derived::go", c + "Base::run"): ("INFERRED", 0.8),
        (c + "Derived::go", "pkg/util.py::helper"): ("EXTRACTED", 1.0), (c + "main", "pkg/util.py::other"): ("EXTRACTED", 1.0), (c + "main", c + "top"): ("EXTRACTED", 1.0), (c + "main", "pkg/util.py::helper"): ("EXTRACTED", 1.0), (c + "top", c + "Derived::go"): ("INFERRED", 0.8),
    }
    inh = {(r["src"], r["dst"]) for r in edges.filter("relation = 'inherits'").collect()}
    assert inh == {("code::pkg/core.py::Derived", "code::pkg/core.py::Base")}
    f = {r["flow"] for r in code.flows(defs, edges.filter("relation = 'calls'").select("src", "dst", "pos")).collect()}
    assert f == {"code::pkg/core.py::main"}
