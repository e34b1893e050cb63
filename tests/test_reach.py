import os
from pathlib import Path
from urllib.parse import urlparse

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from trellis.operators import reach
from trellis.plans import graph_queries
from trellis.session import shared_dir

E = "src string, dst string, score double"


def _brute(pairs, roots, max_length):
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = set()
    for r in roots:
        seen, front = {r}, {r}
        out.add((r, r, 0))
        for n in range(1, max_length + 1):
            front = {b for a in front for b in near.get(a, ())} - seen
            seen |= front
            out |= {(r, i, n) for i in front}
    return out


@pytest.mark.parametrize("max_length", [0, 1, 3, 6])
def test_lengths_equal_walks_from_each_root(spark, max_length):
    rng = np.random.default_rng(max_length)
    pairs = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 260, (220, 2))] + [("hub", f"n{i}") for i in range(0, 260, 4)] + [("n1", "n1"), ("n2", "n1"), ("n1", "n2")]
    roots = ["hub", "alone", *[f"n{i}" for i in range(0, 260, 3)]]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [("n3", "weak", 0.1), ("n3", "missing", None)], E)
    got = [tuple(r) for r in reach.lengths(e, spark.createDataFrame([(r,) for r in [*roots, "hub"]], "root string"), max_length, 0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute([*pairs, ("n3", "missing")], roots, max_length)


def test_blocks_of_more_than_a_word_and_of_none(spark, monkeypatch):
    monkeypatch.setattr(reach, "UNFOLDED", 500)  # runs of few nodes
    e = spark.createDataFrame([(f"n{i}", "hub", 1.0) for i in range(1000)], E)
    got = reach.lengths(e, spark.createDataFrame([(f"n{i}",) for i in range(800)], "root string"), 2)
    assert {tuple(r) for r in got.groupBy("length").count().collect()} == {(0, 800), (1, 800), (2, 800 * 999)}
    assert got.select("root", "id").distinct().count() == 800 * 1001
    none = spark.createDataFrame([], "root string")
    assert reach.lengths(e, none, 2).count() == 0
    assert [tuple(r) for r in reach.lengths(e.limit(0), spark.createDataFrame([("a",)], "root string"), 2).collect()] == [("a", "a", 0)]


def _bytes(folder: str) -> int:
    return sum(os.path.getsize(p) for p in Path(urlparse(folder).path).rglob("*") if p.is_file())


def test_pairs_of_a_hub_are_not_kept_on_the_way(spark, tmp_path):
    n = 900
    ids = [f"n{i:04d}" for i in range(n)]
    pq.write_table(pa.table({"id": ids, "seq": pa.array([20 * i for i in range(n)], pa.int64()), "removed_at": pa.nulls(n, pa.timestamp("us"))}), tmp_path / "nodes.parquet")
    texts = {"relation": "x", "tier": "EXTRACTED", "source_pass": "ast", "lifecycle": "deterministic"}
    pq.write_table(pa.table({"src": ids, "dst": ["hub"] * n, **{k: [v] * n for k, v in texts.items()}, "score": [1.0] * n, "weight": [1.0] * n, "write_seq": pa.array(range(n), pa.int64())}), tmp_path / "edges.parquet")
    shared = shared_dir(spark)
    before = _bytes(shared)
    got = sorted(map(tuple, graph_queries.shortest_paths(spark, str(tmp_path)).collect()))
    written = _bytes(shared) - before
    con = duckdb.connect()
    for t in ("nodes", "edges"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert got == sorted(con.sql(graph_queries.SQL["shortest_paths"]).fetchall()) and len(got) == n * (n + 1)
    # a link's share of what is kept, not a pair's: the pairs alone would be some 40 MB
    assert written < 2000 * n
