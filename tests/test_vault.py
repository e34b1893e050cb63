import json

import pytest
from pyspark.sql import functions as F

from trellis.engine import Engine
from trellis.operators import atomize, embed, records, report
from trellis.plans import ingest
from trellis.sources.vault import Conflict, Vault, digest


@pytest.fixture()
def vault(tmp_path):
    (tmp_path / "v").mkdir()
    return Vault(tmp_path / "v", tmp_path / "audit.jsonl")


def test_guarded_writes(vault):
    h = vault.write("a/n.md", "---\ntags: [x]\n---\n# One\n\nold\n\n# Two\n\nkeep\n")
    with pytest.raises(FileExistsError):
        vault.write("a/n.md", "new")
    with pytest.raises(Conflict):
        vault.write("a/n.md", "new", "sha256:0")
    with pytest.raises(PermissionError):
        vault.read("../x")
    h = vault.patch("a/n.md", "One", "fresh", h)
    assert "fresh" in vault.read("a/n.md")["content"] and "keep" in vault.read("a/n.md")["content"] and "old" not in vault.read("a/n.md")["content"]
    with pytest.raises(KeyError):
        vault.patch("a/n.md", "None", "x", h)
    assert vault.tags("a/n.md", ("#y", "x"), ("x",)) == ["y"]
    vault.update_front("a/n.md", {"title": "T: x"})
    assert vault.read("a/n.md")["front"] == {"tags": ["y"], "title": "T: x"}
    vault.write("b.md", "see [[n]] and [[n|again]]")
    assert vault.links("a/n.md")["incoming"] == ["b.md"] and vault.links("b.md")["outgoing"] == ["n", "n"]
    vault.move("b.md", "c.md")
    assert vault.delete("c.md").startswith(".trash/") and vault.list() == ["a/n.md"]
    assert len(vault.audit.read_text().splitlines()) > 5


def test_atomize(spark, vault, tmp_path):
    text = "intro\n\n# A\n\nx\n\n## B\n\ny\n\n### deeper\n"
    vault.write("d.md", text)
    docs = spark.createDataFrame([("d.md", text)], "path string, content string")
    scans = atomize.scan(docs, "2025-01-01 00:00:00")
    assert [r["title"] for r in scans.orderBy("section").collect()] == ["", "A", "B"]
    assert atomize.fresh(scans, "2025-01-01 23:00:00").count() == 3 and atomize.fresh(scans, "2025-01-02 00:00:00").count() == 0
    assert atomize.stale(scans, docs).count() == 0 and atomize.stale(scans, docs.withColumn("content", F.lit("z"))).count() == 3
    claims = spark.createDataFrame([("s1", "KNOW-000001", "one", [1.0, 0.0]), ("s2", "KNOW-000002", "two", [0.0, 1.0]), ("s3", "KNOW-000001", "again", [1.0, 0.0])], "section_id string, knowledge_id string, title string, vec array<double>")
    known = spark.createDataFrame([("KNOW-000009", [0.99, 0.01]), ("KNOW-000008", [0.5, 0.5])], "id string, vec array<double>")
    p = atomize.propose(claims, known)
    assert {r["knowledge_id"]: (r["action"], r["reuse_id"]) for r in p.collect()} == {"KNOW-000001": ("reuse", "KNOW-000009"), "KNOW-000002": ("create", None)}
    log = atomize.snapshots(p, "d.md", "2025-01-01T00:00:00Z")
    edges = spark.createDataFrame([("d.md", "KNOW-000009", "dedup"), ("d.md", "x", "ast")], "src string, dst string, source_pass string")
    done = log.filter("action = 'reuse'").head()["decision_id"]
    marked, left = records.roll_back(log, edges, done)
    assert left.count() == 1 and marked.filter("rollback_status = 'rolled_back'").count() == 1
    todo = [{"knowledge_id": "KNOW-000002", "title": "two", "body": "text", "action": "create"}, {"knowledge_id": "KNOW-000001", "title": "one", "body": "t", "action": "reuse"}]
    assert atomize.apply(vault, "d.md", digest(text), todo) == ["knowledge/KNOW-000002.md"]
    assert atomize.apply(vault, "d.md", digest(text), todo) == []
    with pytest.raises(Conflict):
        atomize.apply(vault, "d.md", "sha256:0", todo)
    r = atomize.Registry(tmp_path / "ids.json")
    assert r.take(2) == ["KNOW-000001", "KNOW-000002"] and r.take() == ["KNOW-000003"]
    with pytest.raises(ValueError):
        r.take(0)


def test_ingest_and_engine(spark, vault, tmp_path):
    vault.write("auth.md", "---\ntags: [sec, api]\ncategory: core\naliases: [login]\nrelations:\n  depends_on: [Cache]\n---\nUses [[Cache]] and [[Missing]] #inline\n")
    vault.write("Cache.md", "---\ntags: [sec]\n---\nKeeps [[login]].\n")
    store = f"file://{tmp_path}/store"
    assert ingest.ingest(spark, str(vault.root), store) == 1
    e = Engine.open(spark, store)
    got = {(r["src"], r["dst"]): r["relation"] for r in e.edges.collect()}
    assert got[("auth", "Cache")] == "depends_on" and got[("Cache", "auth")] == "links_to" and got[("auth", "tag:inline")] == "tagged_as" and got[("tag:api", "tag:sec")] == "tag_co" and got[("auth", "category:core")] == "categorized_as"
    assert e.trace("Cache", "category:core") == ["Cache", "auth", "category:core"]
    assert e.entries("login").head()["id"] == "auth"
    assert "auth" in {r["id"] for r in e.search("login").collect()}
    assert "# Graph report" in Engine(e.nodes.withColumn("community_id", F.lit("c")), e.edges).report()
    assert ingest.ingest_changes(spark, str(vault.root), store) == (1, 0)
    h = vault.read("Cache.md")["hash"]
    vault.write("Cache.md", "No links now.", h)
    assert ingest.ingest_changes(spark, str(vault.root), store) == (2, 1)
    now = {(r["src"], r["dst"]) for r in Engine.open(spark, store).edges.collect()}
    assert ("Cache", "auth") not in now and ("auth", "Cache") in now
    both = e.federated(Engine(e.nodes, e.edges))
    assert both.nodes.filter("id = 'code::auth'").count() == 1


def test_reports(spark, tmp_path):
    n = spark.createDataFrame([(f"n{i}", "c1" if i < 4 else "c2", "text " * 50) for i in range(5)], "id string, community_id string, content string")
    p = report.community_prompts(n, 3, 600).collect()
    assert [(r["community_id"], r["members"]) for r in p] == [("c1", 4)] and p[0]["prompt"].endswith("more")
    r = report.community_reports(n, lambda _: 'Here: {"title": "T", "rating": 7, "key_findings": ["a"]} done')
    assert [(x["title"], x["rating"], x["findings"]) for x in r.collect()] == [("T", 7, ["a"])]
    assert report.community_reports(n, lambda _: "nothing").count() == 0
    report.save_reports(r, tmp_path / "r")
    assert json.loads((tmp_path / "r/communities.json").read_text())[0]["title"] == "T"
    assert report.global_answer("q", r, lambda t: "NOT RELEVANT" if "Report:" in t else "x").startswith("No community")
    assert report.global_answer("q", r, lambda t: "part" if "Report:" in t else "all") == "all"
    nodes = spark.createDataFrame([("m", "m", "module", "f.py"), ("m::g", "g", "function", "f.py")], "id string, label string, kind string, source_file string")
    edges = spark.createDataFrame([("m", "m::g", "calls", 1.0), ("m", "m::g", "imports", 1.0)], "src string, dst string, relation string, weight double")
    c = report.canvas(nodes, edges)
    assert len(c["nodes"]) == 2 and [x["label"] for x in c["edges"]] == ["calls"]
    report.html(nodes.withColumn("community_id", F.lit("c")), edges, tmp_path / "g.html")
    assert "<canvas>" in (tmp_path / "g.html").read_text()


def test_embedding_cache(spark):
    n = spark.createDataFrame([("a", "note", "text a", "h1"), ("b", "note", "text b", "h2"), ("t", "tag", "x", "h3"), ("e", "note", " ", "h4")], "id string, kind string, content string, content_hash string")
    cache = spark.createDataFrame([("a", "h1", [1.0], 1), ("b", "old", [1.0], 1)], "node_id string, sha string, vec array<float>, append_seq bigint")
    new = embed.extend_cache(n, cache, lambda ts: [embed.hash_vector(t, 8) for t in ts], 2).collect()
    assert [(r["node_id"], r["sha"], len(r["vec"])) for r in new] == [("b", "h2", 8)]

    def moody(ts):
        if len(ts) > 1 or "a" in ts[0]:
            raise RuntimeError
        return [[1.0]]

    assert [r["node_id"] for r in embed.compute(n.filter("kind = 'note' AND content <> ' '"), moody).collect()] == ["b"]
    with pytest.warns(UserWarning):
        assert embed.check_consistency({"dim": 8}, {"dim": 9}) == ["dim"]
