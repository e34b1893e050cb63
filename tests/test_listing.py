import pytest
from pyspark.sql import functions as F

from trellis.operators import code, federation, graph, inbox, link, listing, metrics, probe, records, validate  # noqa: F401

NODE = "id string, namespace string, kind string, tags array<string>, label string, tokens int, community_id string, ontology_type string, aliases array<string>, content string, metadata string"


def _nodes(spark, rows):
    cols = [c.split(" ")[0] for c in NODE.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], NODE)


EDGE = "src string, dst string, relation string, tier string, score double, weight double, source_pass string, lifecycle string, write_seq bigint"


def _edges(spark, rows):
    cols = [c.split(" ")[0] for c in EDGE.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], EDGE)


def test_unified_view_and_scope(spark):
    n = _nodes(spark, [{"id": "a", "namespace": "nimbus", "tags": ["t"], "tokens": 1}, {"id": "code::x/b", "namespace": "code", "tags": ["t", None], "tokens": 1}, {"id": "code::y/c", "namespace": "code", "tokens": 1}])
    e = _edges(spark, [{"src": "a", "dst": "code::x/b", "relation": "m"}, {"src": "code::x/b", "dst": "code::y/c", "relation": "c"}, {"src": "a", "dst": "gone", "relation": "m"}])
    u = federation.unified_edges(n, e, federation.tag_bridges(n), ["code", "nimbus"])
    assert {(r["src"], r["dst"]) for r in u.collect()} == {("nimbus::a", "code::x/b"), ("code::x/b", "code::y/c"), ("nimbus::a", "nimbus::gone"), ("code::tag:t", "nimbus::tag:t"), ("nimbus::tag:t", "code::tag:t")}
    q = federation.unified_nodes(n, ["code", "nimbus"])
    walk = lambda **kw: [r["id"] for r in federation.walk(q, u, "nimbus::a", 100, 5, **kw).orderBy("rank").collect()]
    assert set(walk()) >= {"nimbus::a", "code::x/b", "code::y/c"}
    assert walk(scope="x/") == ["nimbus::a", "code::x/b"] and walk(scope="x/", order="dfs") == ["nimbus::a", "code::x/b"]


def _routed(spark):
    state = spark.createDataFrame(
        [("e1", "code::f", "nimbus::d", "sim", "INFERRED", 0.9, "t0", None, 3), ("e2", "code::f", "nimbus::d ", "tag", "INFERRED", None, "t0", "t1", 7), ("e3", "code::g", "nimbus::d", "sim", "INFERRED", 0.95, "t0", "t1", 2)],
        "edge_id string, source_node string, target_node string, edge_kind string, confidence_tier string, confidence double, first_seen_at string, last_seen_at string, consecutive_seen int",
    ).withColumn("model_id", F.lit("m")).withColumn("lifecycle_class", F.lit("probabilistic"))
    routed = state.select("edge_id", "source_node", "target_node", F.lit(1).alias("rank"), F.lit(2).alias("tier"), F.when(F.col("edge_id") == "e3", "auto_promoted").otherwise("queued").alias("action"))
    return routed, state


def test_inbox_life(spark):
    routed, state = _routed(spark)
    box = inbox.entries(routed, state, "2026").cache()
    r = box.collect()
    assert len(r) == 1 and r[0]["source"] == "nimbus::d" and r[0]["confidence"] == 0.9 and len(r[0]["probe_signals"]) == 2
    assert inbox.pending(box, 5, "consecutive_seen").select(inbox.longest_seen()).head()[0] == 7
    assert inbox.pending(box, 5, "created_at").count() == 1 and inbox.listed(box, "approved").count() == 0
    with pytest.raises(ValueError):
        inbox.pending(box, 5, "colour")
    up = inbox.promoted_edges(routed, state).collect()
    assert [(x["src"], x["dst"], x["score"], x["lifecycle"]) for x in up] == [("d", "code::g", 0.95, "anchored")]
    assert {x["edge_id"]: x["lifecycle_class"] for x in inbox.anchor(state, routed).collect()} == {"e1": "probabilistic", "e2": "probabilistic", "e3": "anchored"}
    said = spark.createDataFrame([(r[0]["id"], "approved", "t", "me"), ("nobody", "approved", "t", "me"), (r[0]["id"] + "x", "maybe", "t", "me")], "id string, status string, decided_at string, decided_by string")
    after, edges = inbox.approve(box, said)
    assert [(x["status"], x["decided_by"]) for x in after.collect()] == [("approved", "me")] and [(x["src"], x["dst"]) for x in edges.collect()] == [("d", "code::f")]
    # what is decided is not decided again, and does not roll back
    assert inbox.approve(after, said)[1].count() == 0
    fell = routed.withColumn("action", F.lit("discarded"))
    assert [x["status"] for x in inbox.roll_back(after, fell, "t").collect()] == ["approved"] and [x["status"] for x in inbox.roll_back(box, fell, "t").collect()] == ["discarded"]
    assert inbox.counters(fell, box).head().asDict() == {"promoted": 0, "queued": 0, "rolled_back": 2, "discarded": 1}
    assert inbox.counters(routed, box).head().asDict() == {"promoted": 1, "queued": 0, "rolled_back": 0, "discarded": 0}
    old = _edges(spark, [{"src": "d", "dst": "code::g", "relation": "links_to"}, {"src": "d", "dst": "z", "relation": "links_to"}])
    assert {(x["dst"], x["relation"]) for x in inbox.write_edges(old, inbox.promoted_edges(routed, state)).collect()} == {("code::g", "mentions_symbol"), ("z", "links_to")}


def test_probe_branches(spark):
    cols = "edge_id string, source_node string, target_node string, edge_kind string, confidence_tier string, confidence double, first_seen_at string, last_seen_at string, last_seen_parsed_at string, source_file string, consecutive_seen int, model_id string, lifecycle_class string, evidence array<string>"
    row = lambda i, parsed, n, model, life: (f"a::{i}→b::x", f"a::{i}", "b::x", "k", "INFERRED", 0.5, "t0", "t0", parsed, "f", n, model, life, None)
    state = spark.createDataFrame([row("frozen", "s1", 3, "m", "anchored"), row("waits", probe.PENDING, 1, "old", "probabilistic"), row("model", "s1", 5, "old", "probabilistic"), row("next", "s1", 2, "m", "probabilistic"), row("same", "s2", 2, "m", "probabilistic"), row("unseen", "s1", 2, "m", "probabilistic")], cols)
    seen = spark.createDataFrame([("a", x, "b", "x", "k", "EXTRACTED", w, "f") for x, w in [("frozen", 0.9), ("waits", 0.9), ("model", 0.9), ("next", 0.9), ("same", 0.9), ("new", 0.6), ("new", 0.8)]] + [("a", "inside", "a", "x", "k", "odd", 0.9, "f"), ("a", "odd", "b", "x", None, "odd", None, None)], "src_ns string, src string, dst_ns string, dst string, relation string, tier string, weight double, source_file string")
    got = {r["source_node"][3:]: (r["consecutive_seen"], r["confidence"], r["last_seen_parsed_at"], r["model_id"], r["last_seen_at"], r["confidence_tier"]) for r in probe.record(state, seen, "s2", "m", "now").collect()}
    assert got == {
        "frozen": (3, 0.5, "s1", "m", "now", "INFERRED"), "waits": (1, 0.9, "s2", "m", "now", "INFERRED"), "model": (1, 0.9, "s2", "m", "now", "INFERRED"), "next": (3, 0.5, "s2", "m", "now", "INFERRED"),
        "same": (2, 0.5, "s2", "m", "t0", "INFERRED"), "unseen": (2, 0.5, "s1", "m", "t0", "INFERRED"), "new": (1, 0.8, "s2", "m", "now", "EXTRACTED"), "odd": (1, 0.7, "s2", "m", "now", "INFERRED"),
    }


def test_symbol_links(spark):
    n = _nodes(spark, [{"id": "c1", "namespace": "code", "kind": "function", "label": "build_graph"}, {"id": "c2", "namespace": "code", "kind": "class", "label": "Twice"}, {"id": "c3", "namespace": "code", "kind": "class", "label": " Twice"}, {"id": "c4", "namespace": "code", "kind": "function", "label": "config"}, {"id": "c5", "namespace": "code", "kind": "method", "label": "a_method"}])
    notes = spark.createDataFrame([("n1", "See [[build_graph|it]] and build_graph, config and a_method."), ("n2", "build_graph build_graph Twice"), ("n3", None)], "id string, content string")
    got = sorted((r["src"], r["dst"], r["tier"], r["score"], r["weight"]) for r in link.symbol_links(notes, n).collect())
    assert got == [("n1", "c1", "EXTRACTED", 1.0, 1.0), ("n2", "c1", "INFERRED", 0.9, 0.7), ("n2", "c2", "AMBIGUOUS", 0.2, 0.6), ("n2", "c3", "AMBIGUOUS", 0.2, 0.6)]
    old = _edges(spark, [{"src": "n1", "dst": "gone", "relation": "mentions_symbol", "lifecycle": "deterministic"}, {"src": "n2", "dst": "c1", "relation": "mentions_symbol", "lifecycle": "anchored", "score": 0.5}, {"src": "n9", "dst": "x", "relation": "links_to"}])
    after = {(r["src"], r["dst"]): r["score"] for r in link.relink_symbols(old, link.symbol_links(notes, n)).collect()}
    assert after == {("n1", "c1"): 1.0, ("n2", "c1"): 0.5, ("n2", "c2"): 0.2, ("n2", "c3"): 0.2, ("n9", "x"): None}


def test_names_by_tier(spark):
    rows = [("a", "Same", None, "x/a.md", False), ("b", "same", None, "x/b.md", True), ("c", "SAME", None, "knowledge/c.md", False), ("d", "other", "K1", "x", False), ("e", "other", None, "x", True)]
    n = spark.createDataFrame([(*r, None) for r in rows], "id string, label string, knowledge_id string, source_file string, canonical boolean, aliases array<string>")
    assert {r["key"]: r["id"] for r in link.name_index(n).collect()} == {"same": "b", "other": "d", "k1": "d"}
    assert {r["key"]: r["id"] for r in link.name_index(n.drop("canonical")).collect()} == {"same": "c", "other": "d", "k1": "d"}


SOURCE = '''
class Left:
    def run(self):
        return other()

class Right:
    def run(self):
        return 1

class Deep(Left):
    pass

class Both(Right, Deep):
    def go(self):
        return self.run()

class Loop(Loop):
    def stay(self):
        return self.gone()

def other():
    return 1

def main():
    other(len(last()))
    first()

def first():
    return last()

def last():
    return 2
'''
CHAIN = "\n\n".join(f"class C{i}(C{i + 1}):\n    pass" for i in range(12)) + "\n\nclass C12:\n    def found(self):\n        return 1\n\nclass User(C0):\n    def use(self):\n        return self.found()\n"


def test_bases_in_order_and_without_limit(spark):
    files = spark.createDataFrame([("a.py", SOURCE), ("b.py", CHAIN)], "path string, content string")
    defs, edges = code.graph_of(files)
    calls = {(r["src"].split("::", 1)[1], r["dst"].split("::", 1)[1]) for r in edges.filter("relation = 'calls'").collect()}
    assert ("a.py::Both::go", "a.py::Right::run") in calls and ("a.py::Both::go", "a.py::Left::run") not in calls
    assert ("b.py::User::use", "b.py::C12::found") in calls
    order = [r["dst"].rsplit("::", 1)[1] for r in edges.filter("relation = 'calls' AND src LIKE '%::main'").orderBy("pos").collect()]
    assert order == ["other", "last", "first"]
    flow = code.flows(defs, edges.filter("relation = 'calls'").select("src", "dst", "pos"), branches=2)
    assert {(r["step"].rsplit("::", 1)[1], r["depth"]) for r in flow.filter("flow LIKE '%::main'").collect()} == {("main", 0), ("other", 1), ("last", 1)}
    score = {r["id"].rsplit("::", 1)[1]: r["score"] for r in code.entry_scores(defs, edges.filter("relation = 'calls'")).collect()}
    assert score["main"] == 1.0 and score["last"] == 0.2


def test_small_parts(spark):
    assert listing.without_extension("report.md") == "report" and listing.without_extension("a.py::Foo") == "a.py::Foo" and listing.without_extension("v1.2 notes") == "v1.2 notes"
    p = spark.createDataFrame([("a b/ü*~.md",), (None,)], "p string").select(listing.quoted(F.col("p")).alias("q")).collect()
    assert [r["q"] for r in p] == ["a%20b/%C3%BC%2A~.md", None]
    a, b = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, None)], "g int, t string"), spark.createDataFrame([("x",), (None,)], "t string")
    assert sorted(tuple(r) for r in listing.covered(a, b, "g", "t").collect()) == [(1, 2, 1, False), (2, 1, 0, True)]
    hits = spark.createDataFrame([(1, 2, "blue sky", "the sky is blue"), (1, 1, "the", "the sky is blue"), (2, 1, "x", "")], "query_id int, rank int, chunk string, answer string")
    assert sorted(tuple(r) for r in metrics.context_sufficiency(hits).collect()) == [(1, 0.75, True), (2, 0.0, False)]
    assert metrics.context_sufficiency(hits, judge=lambda c, a: 1.0 if c == "the\nblue sky" else 0.0).filter("sufficient").count() == 1
    e = _edges(spark, [{"src": "a", "dst": "b", "source_pass": "ast", "lifecycle": "x"}, {"src": "a", "dst": "c", "source_pass": "conv", "lifecycle": "x"}])
    assert sorted(r["lifecycle"] for r in graph.migrate_all(e).collect()) == ["anchored", "deterministic"]
    blocked = e.unionByName(_edges(spark, [{"src": "a", "dst": "d", "source_pass": None, "lifecycle": "y"}]))
    assert sorted(r["lifecycle"] for r in graph.migrate_all(blocked).collect()) == ["x", "x", "y"]
    n = _nodes(spark, [{"id": "a", "kind": "note", "content": "x", "metadata": '{"embed": false}'}, {"id": "b", "kind": "note", "content": " "}, {"id": "c", "kind": "method", "content": "x"}, {"id": "d", "kind": "class", "content": "x", "metadata": "broken"}])
    assert [r["id"] for r in records.embeddable(n).collect()] == ["d"]


def test_entries_over_namespaces(spark):
    n = _nodes(spark, [{"id": "code::Report", "namespace": "code", "label": "report"}, {"id": "KNOW-1", "namespace": "nimbus", "label": "The report"}, {"id": "report.md", "namespace": "conv", "label": "x"}])
    ids = lambda q, **kw: sorted(r["id"] for r in listing.entries(n, q, known=["code", "nimbus", "conv"], **kw).collect())
    assert ids("report.md") == ["KNOW-1", "code::Report", "report.md"] and ids("nimbus::report") == ["KNOW-1"] and ids("code::Report") == ["code::Report"] and ids("nimbus::KNOW-1") == ["KNOW-1"]
    assert ids("report", scope="KNOW") == ["KNOW-1"] and ids("nothing") == []
