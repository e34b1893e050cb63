import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis import session
from trellis.operators import entities, metrics, rank, records, retrieve


def test_numbers_within_groups(spark):
    rows = [(g, int(i), None) for g in ("a", "b", None) for i in np.random.default_rng(1).permutation(60)] + [("hot", i, "x") for i in range(400)]
    got = records.numbered(spark.createDataFrame(rows, "g string, i int, x string").repartition(7), ["g"], ["i"])
    assert sorted((str(r["g"]), r["i"] + 1) for r in got.collect()) == sorted((str(r["g"]), r["n"]) for r in got.collect())
    assert records.numbered(spark.createDataFrame([], "g string, i int"), ["g"], ["i"]).count() == 0
    assert [r["n"] for r in records.numbered(spark.range(5).toDF("i"), [], ["i"]).orderBy("i").collect()] == [1, 2, 3, 4, 5]


def test_neighbours_in_blocks(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((90, 8)).round(1)
    v[7], v[8], v[9] = v[6], v[6], 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(100, None), (101, [1.0, 2.0]), (None, [1.0] * 8)], "i bigint, v array<double>")
    x = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -2)
    s[:, 9] = -2
    want = {(i, int(j), r + 1) for i in range(0, 90, 2) for r, j in enumerate(sorted(range(90), key=lambda j: (-s[i, j], j))[:4]) if i != 9}
    for block in (1000, 10):
        got = {(r["id"], r["other"], r["rank"]) for r in retrieve.knn(df, df.filter("i % 2 = 0 AND i < 90"), "i", "v", 4, block=block).collect()}
        assert got == want
    assert retrieve.knn(df, df.limit(0), "i", "v").count() == 0


def test_clarity_by_neighbours(spark):
    df = spark.createDataFrame([("a", i, [1.0, float(i % 2)]) for i in range(50)] + [("b", 1, [1.0, 0.0])], "g string, i int, vec array<double>")
    got = {r["g"]: (r["n"], r["clarity"]) for r in metrics.boundary_clarity(df, "g", "i").collect()}
    assert got["b"] == (1, 1.0) and got["a"][0] == 50 and abs(got["a"][1] - (1 - 2**-0.5)) < 1e-3


def test_walks_of_many_queries(spark):
    atoms = spark.createDataFrame([(1, ["x", "y"]), (2, ["y"]), (3, ["z"]), (4, [])], "id int, entities array<string>")
    links = entities.atom_entity_graph(atoms)
    seeds = spark.createDataFrame([(1, "entity:x", 1.0), (2, "entity:z", 1.0), (3, "entity:none", 1.0)], "grp int, id string, mass double")
    got = [(r["grp"], r["id"], r["rank"]) for r in entities.walk_many(links, seeds, 2).orderBy("grp", "rank").collect()]
    assert got == [(1, "1", 1), (1, "2", 2), (2, "3", 1)]
    mass = rank.personal_ranks(links, seeds, rounds=5).groupBy("grp").agg(F.sum("rank").alias("s")).collect()
    assert {r["grp"] for r in mass} == {1, 2} and all(abs(r["s"] - 1) < 1e-9 for r in mass)


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_a_name_is_given_once(spark, tmp_path):
    path = spark._jvm.org.apache.hadoop.fs.Path
    for text, done in (("one", True), ("two", False)):
        (tmp_path / "tmp").write_text(text)
        assert session.create_once(spark, path(f"file://{tmp_path}/tmp"), path(f"file://{tmp_path}/name")) is done
    assert (tmp_path / "name").read_text() == "one" and not (tmp_path / "tmp").exists()
