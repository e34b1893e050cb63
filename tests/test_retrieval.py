from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from trellis.operators import levels, link, metrics, probe, retrieve, split
from trellis.streaming import probe as stream


def test_rrf(spark):
    rows = [("a", 1, "x"), ("b", 2, "x"), ("b", 1, "y"), ("c", 2, "y")]
    s = retrieve.rrf(spark.createDataFrame(rows, "id string, rank int, signal string")).orderBy(F.desc("score"), "id")
    assert [r["id"] for r in s.collect()] == ["b", "a", "c"]
    assert retrieve.rrf(spark.createDataFrame([], "id string, rank int, signal string")).count() == 0


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([(1, "graph graph index"), (2, "graph cache"), (3, "graph tag"), (4, None), (5, "")], "i int, body string")
    got = retrieve.bm25(docs, "i", F.col("body"), ["cache", "graph"]).orderBy(F.desc("score")).collect()
    assert got[0]["id"] == 2 and all(r["score"] > 0 for r in got)
    assert retrieve.bm25(docs, "i", F.col("body"), ["absent"]).count() == 0


def test_entry_points(spark):
    n = spark.createDataFrame([("x1", "Long report name", [], "a"), ("x2", "report", None, "b"), ("report", "other", [], "a"), ("x4", "zz", ["Report"], "a")], "id string, label string, aliases array<string>, namespace string")
    assert retrieve.entry_points(n, "Report").head()["id"] == "x2"
    assert {r["namespace"]: r["id"] for r in retrieve.entry_points(n, "report", True).collect()} == {"a": "report", "b": "x2"}


def test_wikilinks(spark):
    docs = spark.createDataFrame([("d", "see [[One]], ![[Two#Part]], [[Three^b1|shown]] and [[x]")], "id string, content string")
    got = [(r["target"], r["section"], r["block"], r["display"], r["relation"]) for r in link.wikilinks(docs).orderBy("pos").collect()]
    assert got == [("One", "", "", "", "links_to"), ("Two", "Part", "", "", "embeds"), ("Three", "", "b1", "shown", "links_to_block")]


def test_name_collisions(spark):
    rows = [("a", "Same", None, None, "x/Same.md"), ("b", "same", None, None, "knowledge/same.md"), ("c", "Tie", None, None, "x"), ("d", "tie", None, None, "y"), ("e", "k", ["Al"], "KNOW-1", "z")]
    n = spark.createDataFrame(rows, "id string, label string, aliases array<string>, knowledge_id string, source_file string")
    assert dict(map(tuple, link.name_index(n).collect())) == {"same": "b", "k": "e", "al": "e", "know-1": "e"}


def test_similar_pairs_recall(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 64))
    v = np.concatenate([base, base + 0.4 * rng.standard_normal((60, 64))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"v{i:03d}", x.tolist()) for i, x in enumerate(v)], "id string, vec array<double>")
    want = {(f"v{i:03d}", f"v{j:03d}") for i in range(120) for j in range(i + 1, 120) if v[i] @ v[j] >= 0.8}
    got = {(r["a"], r["b"]) for r in link.similar_pairs(df, 0.8).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 0


def test_similar_pairs_at_the_threshold(spark):
    """All pairs are found where cosines lie about the threshold, and in as many blocks as there may be."""
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 64))
    v = np.concatenate([base, base + rng.standard_normal((150, 64)), np.zeros((1, 64))])
    df = spark.createDataFrame([(f"v{i:03d}", x.tolist()) for i, x in enumerate(v)], "id string, vec array<double>")
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    want = {(f"v{i:03d}", f"v{j:03d}") for i in range(300) for j in range(i + 1, 300) if u[i] @ u[j] >= 0.65}
    assert len(want) > 100
    assert {(r["a"], r["b"]) for r in link.similar_pairs(df, 0.65).collect()} == want
    assert {(r["a"], r["b"]) for r in link.similar_pairs(df, 0.65, block=40).collect()} == want


def test_probe_fold_equals_stream(spark, tmp_path):
    import random

    random.seed(5)
    rows = [(f"e{e}", s, f"m{s // 7}" if e % 2 else "m", round(random.random(), 3)) for e in range(12) for s in range(20) if random.random() < 0.7]
    one = {}
    for r in rows:
        one.setdefault((r[0], r[1]), r)
    schema = "edge_id string, scan int, model_id string, confidence double"
    obs = spark.createDataFrame(list(one.values()), schema)
    last = max(r[1] for r in rows)
    batch = {r["edge_id"]: (r["model_id"], r["confidence"], r["first_scan"], r["last_scan"], r["consecutive_seen"]) for r in probe.fold_observations(obs).collect()}
    expected = {}
    for (e, s), r in sorted(one.items()):
        expected[e] = stream.step(expected.get(e), s, r[2], r[3])
    assert batch == {e: (*x[:4], x[4] if x[3] == last else 0) for e, x in expected.items()}
    src = str(tmp_path / "in")
    for lo, hi in pairwise([0, 7, 14, 21]):
        obs.filter(f"scan >= {lo} AND scan < {hi}").coalesce(1).write.mode("append").parquet(src)
        stream.run_to_table(spark.readStream.schema(schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["edge_id"]: tuple(r)[1:] for r in stream.current(spark, str(tmp_path / "out")).collect()}
    assert got == expected


def test_tiers_and_margin(spark):
    rows = [(f"e{i}", "s", "t", c, n, life, at) for i, (c, n, life, at) in enumerate([(0.80, 2, "probabilistic", "x"), (0.74, 0, "probabilistic", "x"), (0.72, 2, "probabilistic", "x"), (0.55, 2, "probabilistic", "x"), (None, None, None, None), (0.79, 9, "anchored", "x")])]
    s = spark.createDataFrame(rows, "edge_id string, source_node string, target_node string, confidence double, consecutive_seen int, lifecycle_class string, last_seen_parsed_at string")
    got = {r["edge_id"]: (r["tier"], r["action"]) for r in probe.route(s, (0.75, 1, 0.70, 0.25, 5, 2)).collect()}
    assert got == {"e0": (1, "auto_promoted"), "e1": (3, "discarded"), "e2": (2, "queued"), "e3": (3, "discarded"), "e4": (3, "discarded"), "e5": (3, "discarded")}


def test_inbox(spark):
    cols = "id string, status string, decided_at string, decided_by string"
    box = spark.createDataFrame([("a", "pending", None, None), ("b", "rejected", "t0", "me")], cols)
    d = spark.createDataFrame([("a", "approved", "t1", "you"), ("b", "approved", "t1", "you")], cols)
    assert sorted(map(tuple, probe.decide(box, d).collect())) == [("a", "approved", "t1", "you"), ("b", "rejected", "t0", "me")]
    assert probe.insert_inbox(box, d).count() == 2


def test_splitters(spark):
    d = spark.createDataFrame([(1, "One. Two!\nThree\n\n```\na. b.\n```\nEnd?"), (2, None), (3, " ")], "i int, t string")
    assert [r["atom"] for r in split.atoms(d, "i", "t", "sentence").orderBy("idx").collect()] == ["One.", "Two!", "Three", "```\na. b.\n```", "End?"]
    w = spark.createDataFrame([(1, "A" * 100 + "B" * 100 + "C" * 100)], "i int, t string")
    got = [r["atom"] for r in split.atoms(w, "i", "t", "fixed_window", size=120, overlap=30).orderBy("idx").collect()]
    assert got[0][-30:] == got[1][:30] and max(map(len, got)) <= 120
    with pytest.raises(ValueError):
        split.get("fixed_window")(F.lit("x"), size=10, overlap=10)
    with pytest.raises(ValueError):
        split.register("sentence", lambda t: t)
    with pytest.raises(ValueError):
        split.get("none")


def test_metrics(spark):
    row = spark.range(1).select(
        metrics.atomicity(F.lit("One thing.")).alias("a"), metrics.atomicity(F.lit("One. Two. Three.")).alias("b"), metrics.self_contained(F.lit("It fails")).alias("c"), metrics.self_contained(F.lit("Items fail")).alias("d"),
        metrics.faithfulness(F.lit("a b"), F.lit("a c")).alias("e"), metrics.word_f1(F.lit("a b"), F.lit("b c")).alias("f"), metrics.faithfulness(F.lit(""), F.lit("x")).alias("g"),
    ).head()
    assert tuple(round(x, 6) for x in row) == (1.0, 0.4, 0.0, 1.0, 0.5, 0.5, 1.0)


def test_levels(spark):
    a = spark.createDataFrame([(s, i, f"{s}{i}") for s, n in ((1, 4), (2, 2)) for i in range(n)], "s int, idx int, text string")
    got = sorted((r["source"], r["grp"], r["text"]) for r in levels.windows(a, "s", ["idx"], "idx", "text", 3).collect())
    assert got == [(1, 0, "10 11 12"), (1, 1, "13"), (2, 0, "20 21")]
    e = spark.createDataFrame([(0, 0, ["a", "b"]), (0, 1, ["b", "c"]), (0, 2, ["d"]), (0, 3, ["d", "e"])], "source_idx int, idx int, entities array<string>")
    assert sorted((r["idx"], r["grp"]) for r in levels.entity_groups(e).collect()) == [(0, 0), (1, 0), (2, 1), (3, 1)]
    l0 = spark.createDataFrame([(f"k{i}", v) for i, v in enumerate([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]])], "id string, vec array<double>")
    l1 = spark.createDataFrame([("g0", [1.0, 1.0, 0.0])], "id string, vec array<double>")
    assert [r["id"] for r in levels.collapsed(l0, l1, [1.0, 0, 0], 2).orderBy("rank").collect()] == ["l0:k0", "l1:g0"]
    m = spark.createDataFrame([("k0", "g0"), ("k1", "g0"), ("k2", "g1")], "id string, parent string")
    assert [r["id"] for r in levels.parents(l0, m, [0.0, 0, 1], 1).collect()] == ["g1"]
    docs = spark.createDataFrame([("d", "intro\n# One\ntext\n```\n# no\n```\n## Two\nx"), ("e", None)], "id string, body string")
    assert [(r["section"], r["level"], r["title"], r["lines"]) for r in levels.sections(docs, "id", "body").orderBy("section").collect()] == [(0, 0, "", 1), (1, 1, "One", 5), (2, 2, "Two", 2)]
