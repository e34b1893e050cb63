import numpy as np

from trellis.llm import neighbours


def _data(n, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, 64))
    v = np.repeat(base, 4, axis=0) + 0.45 * rng.standard_normal((n // 4 * 4, 64))
    return v * rng.uniform(0.2, 5, (len(v), 1))


def _brute(ids, v, k, least):
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(v)):
        order = sorted(range(len(v)), key=lambda j: (-round(s[i, j], 12), ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order if s[i, j] >= least}
    return out


def _found(spark, ids, v, **kw):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "node_id string, vec array<double>")
    got = neighbours.nearest(df, 5, 0.7, **kw)
    return {(min(r["node_id"], r["other"]), max(r["node_id"], r["other"])) for r in got.collect()}


def test_recall_and_hot_lists(spark):
    v = _data(1200)
    ids = [f"n{i:05d}" for i in range(len(v))]
    want = _brute(ids, v, 5, 0.7)
    got = _found(spark, ids, v)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    # files that are longer than allowed are cut into blocks and lose nothing
    split = _found(spark, ids, v, list_limit=20)
    assert len(split & want) >= len(got & want)
    # the footrule decides what is reranked
    few = _found(spark, ids, v, kept=2)
    assert len(few & want) < len(got & want)


def test_footrule():
    a, b = np.array([[3, 1, 2], [5, 6, 7]]), np.array([[3, 2, 9], [7, 5, 6], [0, 4, 8]])
    assert neighbours.shared_weight(a, b).tolist() == [[3 + 1, 0, 0], [0, 1 + 2 + 1, 0]]


def test_equal_vectors(spark):
    v = np.vstack([np.repeat(_data(4)[:1], 9, axis=0), _data(8, 2)])
    ids = [f"n{i:02d}" for i in range(len(v))]
    got = _found(spark, ids, v)
    assert got >= {("n00", f"n{i:02d}") for i in range(1, 6)} and ("n01", "n08") in got


def test_valid_lines(spark):
    nan = float("nan")
    rows = [("a", [1.0] * 64, 1), ("a", None, 2), ("b", [0.0] * 64, 1), ("c", [1.0] * 63, 1), ("d", [nan] + [1.0] * 63, 1), ("e", None, 1), ("e", [2.0] * 64, 2), ("e", [2.0] * 64, 2), (None, [1.0] * 64, 3), ("f", [1.0] * 63 + [None], 1)]
    df = spark.createDataFrame(rows, "node_id string, vec array<float>, append_seq bigint")
    assert [r["node_id"] for r in neighbours.valid_vectors(df).collect()] == ["e"]
    assert neighbours.nearest(neighbours.valid_vectors(df), 5, 0.8).count() == 0
    assert neighbours.nearest(neighbours.valid_vectors(df.limit(0)), 5, 0.8).count() == 0
