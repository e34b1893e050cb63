import json
import math

import pytest
from pyspark.sql import functions as F

from trellis import protocols
from trellis.operators import embed, granularity, retrieve, traverse
from trellis.operators.search_index import SearchIndex
from trellis.sources import state

WORDS = "graph node edge vault claim".split()


def _embedder():
    """Counts of a few words: close texts have close vectors. A function made here goes to the workers by value."""
    return lambda texts: [[float(t.lower().count(w)) + 0.01 for w in WORDS] for t in texts]


def test_stored_postings_score_like_a_scan(spark, tmp_path):
    docs = spark.createDataFrame([("a", "graph node node edge"), ("b", "edge edge ledger"), ("c", None), ("d", "vault"), ("e", "graph graph graph of nodes"), (None, "graph")], "id string, text string")
    index = SearchIndex(spark, f"file://{tmp_path}/index", 4).build(docs, "id", F.col("text"))
    for query in (["graph", "edge"], ["edge", "edge", "none"], ["none"], []):
        want = {r["id"]: round(r["score"], 9) for r in retrieve.bm25(docs.filter("id IS NOT NULL"), "id", F.col("text"), query).collect()} if query else {}
        assert {r["id"]: round(r["score"], 9) for r in index.search(query).collect()} == want
    assert "EqualTo(term,graph)" in index.search(["graph"])._jdf.queryExecution().executedPlan().toString()
    index.close()


def test_levels(spark):
    _embed = _embedder()
    text = lambda w: ". ".join(f"The {w} {i} of the {w}" for i in range(4)) + "."
    docs = spark.createDataFrame([(i, text(WORDS[i % 5])) for i in range(10)] + [(99, None)], "id int, text string")
    index = granularity.build(docs, "id", "text", _embed, size=2, tag=lambda t: " ".join(sorted(set(t.lower().split()) & set(WORDS))))
    assert index["l0"].count() == 40 and index["l1"].count() == 20
    by = {}
    for r in index["l1"].collect():
        by.setdefault(r["cluster"], set()).add(int(r["id"].split("#")[0]) % 5)
    assert len(by) == 5 and all(len(v) == 1 for v in by.values())
    assert sorted(r["tag"] for r in index["l2"].collect()) == sorted(WORDS)
    for how in ("flat", "parents", "layers"):
        got = [int(r["id"].split("#")[0]) % 5 for r in granularity.search(index, "the claim", _embed, 3, how).collect()]
        assert got == [4, 4, 4]
    few = granularity.build(docs.limit(2), "id", "text", _embed)
    assert few["l2"].count() == 1


def test_question_pairs(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id int, text string")

    def ask(t, n):
        if t == "bad":
            raise ValueError
        return [("q?", "yes"), (" ", "x"), ("r?", "no"), ("s?", "never")]

    assert [tuple(r) for r in granularity.question_pairs(docs, ask, 3).collect()] == [(1, "q?", "yes"), (1, "r?", "no")]


def test_embedders():
    e = protocols.Embedders({"hash": lambda s: lambda t: [embed.hash_vector(x, s.get("dim", 4)) for x in t], "slow": lambda s: lambda t: []}, "hash", frozenset({"slow"}))
    settings = {"dim": 3, "namespaces": {"code": {"dim": 5}, "conv": {"backend": "slow"}, "x": {"backend": "none"}}}
    assert len(e.get(settings)(["a"])[0]) == 3 and len(e.get(settings, "code")(["a"])[0]) == 5 and e.get(settings, "conv")(["a"]) == []
    for ns, q in (("conv", True), ("x", False)):
        with pytest.raises(ValueError):
            e.get(settings, ns, q)


def test_state_tables(spark, tmp_path):
    t = state.VersionedTable(spark, f"file://{tmp_path}/t", "id string, n int")
    assert t.read().count() == 0
    for n in (1, 2, 3):
        assert t.write(t.read().filter("n > 1").unionByName(spark.createDataFrame([("a", n)], "id string, n int"))) == n
    assert sorted(r["n"] for r in t.read().collect()) == [2, 3]
    assert t.compact() == 2 and t.compact() == 0 and t.read().count() == 2
    nodes, edges = spark.createDataFrame([("a", "x")], "id string, label string"), spark.createDataFrame([("a", "b", "EXTRACTED", 1.0)], "src string, dst string, tier string, score double")
    state.export_json(nodes, edges, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json/edges").head().asDict() == {"source": "a", "target": "b", "confidence": "EXTRACTED", "confidence_score": 1.0}
    assert state.read_reports(spark, f"file://{tmp_path}/none.json").count() == 0
    (tmp_path / "r.json").write_text(json.dumps([{"community_id": "c1", "title": "t", "findings": ["x"]}, {"title": "no id"}]))
    assert [r["community_id"] for r in state.read_reports(spark, f"file://{tmp_path}/r.json").collect()] == ["c1"]


def test_path_scores_of_ones_own(spark):
    e = spark.createDataFrame([("a", "b", "x", "EXTRACTED", 0.9), ("b", "c", "x", "EXTRACTED", 0.8)], "src string, dst string, relation string, tier string, score double")
    start = spark.createDataFrame([("a",)], "root string")
    got = {r["id"]: r["path_score"] for r in traverse.impact(e, start, "downstream", 3, 0.0, how=F.col("path_score") * F.col("score")).collect()}
    assert got["b"] == 0.9 and math.isclose(got["c"], 0.72)
