from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from trellis import schema
from trellis.operators import graph, rank, traverse

E = "src string, dst string, relation string, tier string, score double, weight double, source_pass string, lifecycle string, write_seq bigint"
N = "id string, label string, kind string, namespace string, tokens int, community_id string, seq bigint, removed_at timestamp_ntz"


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, rel, tier, score, w, "ast", "deterministic", i) for i, (a, b, rel, tier, score, w) in enumerate(rows)], E)


def simple(spark, *pairs):
    return edges(spark, *[(a, b, "links_to", "EXTRACTED", s, 1.0) for a, b, s in pairs])


def nodes(spark, *rows):
    return spark.createDataFrame([(i, i.upper(), "note", "nimbus", t, c, 1, None) for i, t, c in rows], N)


def test_last_write_wins(spark):
    e = graph.valid_edges(edges(spark, ("a", "b", "links_to", "EXTRACTED", 1.0, 1.0), (" a ", "b\n", "DEPENDS_ON", "INFERRED", 0.5, 1.0), ("a", " ", "x", None, None, None), (None, "b", "x", None, None, None)))
    assert [(r["src"], r["dst"], r["relation"]) for r in e.collect()] == [("a", "b", "depends_on")]
    gone = datetime(2025, 1, 1)
    n = spark.createDataFrame([("a", "A", "note", "n", 1, None, 1, None), ("a", "B", "note", "n", 1, None, 2, None), ("b", "B", "note", "n", 1, None, 1, None), ("b", "B", "note", "n", 1, None, 2, gone), ("c", None, None, None, None, None, 1, None)], N)
    assert sorted((r["id"], r["label"]) for r in graph.valid_nodes(n, "label").collect()) == [("a", "B"), ("c", None)]


def test_stubs_degree_density(spark):
    e = simple(spark, ("new1", "code::x::f", 1.0), ("new1", "new1", 1.0))
    assert sorted(map(tuple, graph.stub_nodes(nodes(spark, ("new1", 1, None)), e).collect())) == [("code::x::f", "f", "code")]
    assert dict(map(tuple, graph.degree(e).collect())) == {"new1": 3, "code::x::f": 1}
    n = nodes(spark, ("a", 1, "c1"), ("b", 1, "c1"), ("c", 1, "c2"))
    stats = {r["community_id"]: tuple(r)[1:] for r in graph.community_stats(n, simple(spark, ("a", "b", 1.0), ("b", "c", 1.0))).collect()}
    assert stats == {"c1": (2, 1, 1, 0.5), "c2": (1, 0, 1, 0.0)}


def test_impact_weakest_link_and_decay(spark):
    start = spark.createDataFrame([("A",)], "root string")
    e = edges(spark, ("A", "B", "x", "EXTRACTED", 0.9, 1.0), ("B", "C", "x", "INFERRED", 0.6, 1.0), ("C", "D", "x", "AMBIGUOUS", 0.1, 1.0))
    got = {r["id"]: (r["depth"], r["path_score"]) for r in traverse.impact(e, start, "downstream", 3, 0.0).collect()}
    assert got == {"B": (1, 0.9), "C": (2, 0.6)}
    got = {r["id"]: round(r["path_score"], 6) for r in traverse.impact(e, start, "downstream", 3, 0.0, None, how="decay").collect()}
    assert got == {"B": 1.0, "C": 0.6, "D": 0.12}
    both = simple(spark, ("C", "A", 1.0), ("A", "B", 1.0))
    assert {r["id"] for r in traverse.impact(both, start, "both", 1).collect()} == {"B", "C"}
    assert {r["id"] for r in traverse.impact(both, start, "upstream", 1).collect()} == {"C"}
    assert traverse.impact(both, spark.createDataFrame([("zz",)], "root string")).count() == 0


def test_shortest_path(spark):
    e = simple(spark, ("a", "b", 1.0), ("c", "b", 1.0), ("c", "d", 1.0), ("a", "d", 0.1))
    d = traverse.distances(e, spark.createDataFrame([("a",)], "root string"), 5, 0.5)
    assert {r["id"]: r["length"] for r in d.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert traverse.path_to(d, "a", "d") == ["a", "b", "c", "d"]
    assert traverse.path_to(d, "a", "zz") is None


def test_budget_walk(spark):
    n = nodes(spark, ("root", 100, None), ("mid", 100, None), ("big", 5000, None), ("leaf", 100, None), ("amb", 1, None))
    e = edges(spark, ("root", "mid", "x", "EXTRACTED", 1.0, 0.5), ("root", "big", "x", "EXTRACTED", 1.0, 0.9), ("mid", "leaf", "x", "INFERRED", 0.7, 1.0), ("mid", "amb", "x", "AMBIGUOUS", 0.1, 1.0))
    assert [r["id"] for r in traverse.budget_walk(n, e, "root", 1000).orderBy("rank").collect()] == ["root", "mid", "leaf"]
    assert [r["id"] for r in traverse.budget_walk(n, e, "root", 150, order="dfs").orderBy("rank").collect()] == ["root"]


class Links(traverse.Neighbours):
    """Links held in memory, in small pages."""

    def __init__(self, links, tokens, page):
        self.links, self.tokens, self.page, self.known, self.loads = links, tokens, page, {}, 0

    def load(self, ids, room, after=None):
        self.loads += 1
        for i in ids:
            rows = sorted((-w, b) for b, w in self.links.get(i, {}).items() if self.tokens[b] <= room)
            rows = [(b, self.tokens[b], -w) for w, b in rows if after is None or (w, b) > (-after[0], after[1])]
            self.known[i] = rows[: self.page]


def _bfs(links, tokens, root, budget, max_depth):
    out, used, queue, seen = [], 0, [(root, 0)], set()
    while queue:
        at, depth = queue.pop(0)
        if at in seen or depth > max_depth or (out and used + tokens[at] > budget):
            continue
        seen.add(at)
        out.append((at, depth))
        used += tokens[at]
        if used >= budget:
            break
        queue += [(b, depth + 1) for _, b in sorted((-w, b) for b, w in links.get(at, {}).items()) if b not in seen]
    return out


def _dfs(links, tokens, root, budget, max_depth):
    out, used, seen = [], [0], set()

    def go(at, depth):
        if at in seen or depth > max_depth or (out and used[0] + tokens[at] > budget):
            return
        seen.add(at)
        out.append((at, depth))
        used[0] += tokens[at]
        if used[0] < budget:
            for _, b in sorted((-w, b) for b, w in links.get(at, {}).items()):
                go(b, depth + 1)

    go(root, 0)
    return out


NODES = st.integers(0, 9)


@given(st.dictionaries(NODES, st.dictionaries(NODES, st.sampled_from([0.5, 1.0]), max_size=6), max_size=10), st.lists(st.integers(0, 30), min_size=10, max_size=10), st.integers(1, 90), st.integers(0, 4), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_walks_by_pages_equal_whole_walks(links, tokens, budget, max_depth, page):
    for walk, whole in ((traverse.walk_bfs, _bfs), (traverse.walk_dfs, _dfs)):
        assert walk(Links(links, tokens, page), 3, tokens[3], budget, max_depth) == whole(links, tokens, 3, budget, max_depth)


def test_walk_from_a_hub(spark):
    n = nodes(spark, *[(f"n{i:03d}", 5 + i % 3 * 50, None) for i in range(300)], ("hub", 1, None), ("deep", 3, None))
    e = edges(spark, *[("hub", f"n{i:03d}", "x", "EXTRACTED", 1.0, 1.0 + i % 7) for i in range(300)], ("n297", "deep", "x", "EXTRACTED", 1.0, 9.0))
    links = traverse.Neighbours(n, e, page=20)
    got = traverse.walk_bfs(links, "hub", 1, 400, 3)
    links.known = {}
    deep = traverse.walk_dfs(links, "hub", 1, 400, 3)
    tokens = {f"n{i:03d}": 5 + i % 3 * 50 for i in range(300)} | {"hub": 1, "deep": 3}
    table: dict = {}
    for r in e.collect():
        for a, b in ((r["src"], r["dst"]), (r["dst"], r["src"])):
            table.setdefault(a, {})[b] = r["weight"]
    assert got == _bfs(table, tokens, "hub", 400, 3) and deep == _dfs(table, tokens, "hub", 400, 3)


def test_pagerank_sums_to_one(spark):
    e = simple(spark, ("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 1.0))
    links = e.selectExpr("src AS a", "dst AS b", "1.0D AS weight").union(e.selectExpr("dst", "src", "1.0D"))
    r = {x["id"]: x["rank"] for x in rank.pagerank(links, spark.createDataFrame([("d", 1.0)], "id string, mass double"), rounds=15).collect()}
    assert abs(sum(r.values()) - 1) < 1e-9 and r["d"] > r["a"]


def test_communities_find_cliques(spark):
    left = [(f"a{i}", f"a{j}", 1.0) for i in range(5) for j in range(i)]
    right = [(f"b{i}", f"b{j}", 1.0) for i in range(5) for j in range(i)]
    e = simple(spark, *left, *right, ("a0", "b0", 1.0))
    m = rank.communities(e, rounds=10)
    got = {r["id"]: r["community"] for r in m.collect()}
    assert len({got[f"a{i}"] for i in range(5)}) == 1 and len({got[f"b{i}"] for i in range(5)}) == 1 and got["a1"] != got["b1"]
    assert rank.modularity(e, m) > 0.4


def test_tier_ranges(spark):
    e = edges(spark, ("a", "b", "x", "EXTRACTED", 0.9, 1.0), ("a", "c", "x", "INFERRED", 0.5, 1.0), ("a", "d", "x", None, 0.5, 1.0), ("a", "e", "x", "INFERRED", None, 1.0))
    assert {r["dst"] for r in graph.tier_violations(e).collect()} == {"b", "d"}
    assert schema.TIER_DECAY["INFERRED"] == 0.6
