import pytest
from pyspark.sql import functions as F

from trellis import cli
from trellis.operators import entities, graph, metrics, validate
from trellis.sources import files


def test_entity_walks(spark):
    a = spark.createDataFrame([(1, ["redis", "cache"]), (2, ["redis"]), (3, ["kafka", None]), (4, ["kafka", "queue"])], "id int, entities array<string>")
    links = entities.atom_entity_graph(a)
    got = [r["id"] for r in entities.walk_retrieve(links, ["Redis"], top_k=4).collect()]
    assert set(got[:2]) == {"1", "2"} and len(got) == 4
    assert entities.walk_retrieve(links, ["unknown"], top_k=2).count() == 2
    v = spark.createDataFrame([("cache", [1.0, 0.0, 0.0]), ("queue", [0.99, 0.05, 0.0]), ("kafka", [0.0, 1.0, 0.0])], "id string, vec array<double>")
    syn = entities.atom_entity_graph(a, v).filter("a = 'entity:cache' AND b = 'entity:queue'")
    assert syn.count() == 1
    q = spark.range(1).select(entities.names_in(F.lit("Why did Team Redis and Öl leave?")).alias("n")).head()["n"]
    assert q == ["why", "team redis", "öl"]
    ranked = spark.createDataFrame([("1", 1), ("2", 2), ("3", 3)], "id string, rank int")
    members = spark.createDataFrame([("1", "g1"), ("2", "g0"), ("3", "g1")], "id string, parent string")
    assert [r["id"] for r in entities.to_groups(ranked, members, 2).collect()] == ["g1", "g0"]


def test_validation(spark):
    rows = [("a", "b", "EXTRACTED", 1.0, ["x"]), ("a", "c", "EXTRACTED", 0.9, None), ("a", "d", None, 1.0, None), ("conv::1", "b", "EXTRACTED", 1.0, None), ("a", "e", "EXTRACTED", 1.0, ["conv::2"]), ("a", "f", "INFERRED", None, [])]
    e = spark.createDataFrame(rows, "src string, dst string, tier string, score double, evidence array<string>")
    good, bad = validate.check_edges(e, "evidence")
    assert {r["dst"] for r in good.collect()} == {"b", "f"} and good.filter("src = 'conv::1'").count() == 0
    assert {(r["src"], r["dst"]): r["problem"] for r in bad.collect()} == {("a", "c"): "score", ("a", "d"): "tier", ("conv::1", "b"): "conversation", ("a", "e"): "conversation"}
    talk = validate.conversation_tier(e).filter("src = 'conv::1'").head()
    assert (talk["tier"], talk["score"]) == ("INFERRED", 0.8)
    m = spark.createDataFrame([("n", "code::m::f", "mentions_symbol"), ("n", "code::m::g", "mentions_symbol")], "src string, dst string, relation string")
    assert [r["symbol"] for r in validate.mark_stale(m, spark.createDataFrame([("code::m::f",), ("code::m::f",)], "id string"), "t").collect()] == ["f"]
    n = spark.createDataFrame([("a", "x.md", "nimbus", "h"), ("b", "y.md", "nimbus", "h")], "id string, source_file string, namespace string, content_hash string")
    left, kept = validate.delete_by_source(n, e, "x.md", "nimbus")
    assert [r["id"] for r in left.collect()] == ["b"] and kept.count() == 1
    assert not validate.has_changed(n, "x.md", "nimbus", "h") and validate.has_changed(n, "x.md", "nimbus", "i") and validate.has_changed(n, "z", "nimbus", "h")


def test_retrieval_measures(spark):
    c = spark.createDataFrame([(1, "one two three"), (2, "four five"), (3, "one nine")], "chunk_id int, text string")
    h = spark.createDataFrame([(7, 1, "one two"), (7, 2, "one two")], "query_id int, chunk_id int, source string")
    assert metrics.retrieval_iou(h, c, "chunk_id", "text").head()["iou"] == round(1 / 3, 6)
    k = spark.createDataFrame([(1, 1, "nothing here"), (1, 2, "the capital is rome"), (1, 3, "rome lies in italy")], "case_id int, rank int, chunk string")
    g = spark.createDataFrame([(1, "rome italy", ["capital is rome", "rome in italy"])], "case_id int, answer string, paragraphs array<string>")
    assert tuple(metrics.multi_hop(k, g).head()) == (1, True, 1.0, 0.5)
    o = spark.range(1).select(metrics.weighted_overall(F.lit(1.0), F.lit(0.9), F.lit(1.0), F.lit(1.0), F.lit(0.5)).alias("a"), metrics.weighted_overall(F.lit(1.0), F.lit(0.8), F.lit(1.0), F.lit(1.0)).alias("b")).head()
    assert tuple(o) == (0.835, 0.95)


def test_gold_alignment_and_clarity(spark):
    p = spark.createDataFrame([(1, "a b"), (1, "c d")], "case_id int, text string")
    g = spark.createDataFrame([(1, "a b")], "case_id int, text string")
    r = metrics.gold_alignment(p, g).head()
    assert (r["precision"], r["recall"], round(r["f1"], 6)) == (0.5, 1.0, 0.666667)
    v = spark.createDataFrame([("s", 1, [1.0, 0.0]), ("s", 2, [0.0, 1.0]), ("t", 1, [1.0, 0.0])], "s string, i int, vec array<double>")
    assert {r["s"]: r["clarity"] for r in metrics.boundary_clarity(v, "s", "i").collect()} == {"s": 1.0, "t": 1.0}


def test_sources_and_media(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "n.md").write_text("---\nknowledge_id: KNOW-000001\n---\nk")
    assert [r["path"] for r in files.CodeSource().discover(spark, str(tmp_path)).collect()] == ["a.py"]
    assert files.KnotSource().read(spark, str(tmp_path)).count() == 1 and files.DocsSource().read(spark, str(tmp_path)).count() == 0
    with pytest.raises(files.AtomizeUnavailable):
        files.MemorySource().read(spark, str(tmp_path))
    m = files.media_nodes(spark.createDataFrame([("d/x.pdf", ""), ("y.pdf", "text " * 4)], "path string, text string"))
    assert {r["label"]: r["tokens"] for r in m.collect()} == {"x": 0, "y": 5}


def test_command_line(capsys):
    assert cli.main(["version"]) == 0
    assert capsys.readouterr().out.strip()
    with pytest.raises(SystemExit):
        cli.main([])


def test_empty_graph(spark):
    n = spark.createDataFrame([], "id string, seq bigint, removed_at timestamp_ntz, community_id string, label string")
    e = spark.createDataFrame([], "src string, dst string, relation string, tier string, score double, weight double, source_pass string, lifecycle string, write_seq bigint")
    vn, ve = graph.valid_nodes(n), graph.valid_edges(e)
    for df in (graph.degree(ve), graph.stub_nodes(vn, ve), graph.community_stats(vn, ve), graph.god_nodes(vn, ve), graph.cross_community(vn, ve)):
        assert df.count() == 0
