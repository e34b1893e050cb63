"""Traversals: frontiers are joined level by level; what depends on order is replayed on a bounded candidate set.

Every level is written to the shared folder, so lineage stays short and a lost
executor costs one level at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis import schema
from trellis.operators.graph import both_ways, passes
from trellis.session import cut, scratch_table


def _decay() -> Column:
    d = F.lit(1.0)
    for tier, by in schema.TIER_DECAY.items():
        d = F.when(F.col("tier") == tier, F.lit(by)).otherwise(d)
    return d


def impact(
    edges: DataFrame, start: DataFrame, direction: str = "upstream", max_depth: int = 3, min_score: float = 0.7,
    tiers: tuple[str, ...] | None = schema.TRUSTED, kinds: tuple[str, ...] | None = None, how: str | Column = "weakest",
) -> DataFrame:
    """What a change reaches: (root, id, depth, path_score) of the least depth, the start left out.

    ``start`` has a column ``root``. ``upstream`` follows edges backwards,
    ``downstream`` forwards, ``both`` either way. ``weakest`` scores a path by its
    weakest edge, ``decay`` by the product of its tiers' decays; of several paths
    of the least depth the best counts. Any other score is a column over ``path_score``, that of the path
    so far (1 at the start), and the edge's ``score`` and ``tier``.
    """
    e = edges.filter(passes(min_score, tiers))
    if kinds is not None:
        e = e.filter(F.col("relation").isin(*kinds))
    cols = (F.coalesce("score", F.lit(1.0)).alias("score"), F.coalesce("tier", F.lit("EXTRACTED")).alias("tier"))
    down = e.select(F.col("src").alias("id"), F.col("dst").alias("next"), *cols)
    up = e.select(F.col("dst").alias("id"), F.col("src").alias("next"), *cols)
    steps = {"downstream": down, "upstream": up, "both": down.unionByName(up)}[direction]
    seen = start.select("root", F.col("root").alias("id"), F.lit(0).alias("depth"), F.lit(1.0).alias("path_score")).distinct()
    front = seen
    score = how if isinstance(how, Column) else F.least("path_score", "score") if how == "weakest" else F.col("path_score") * _decay()
    for depth in range(1, max_depth + 1):
        reached = front.join(steps, "id").select("root", F.col("next").alias("id"), score.alias("path_score")).groupBy("root", "id").agg(F.max("path_score").alias("path_score"))
        front = cut(reached.join(seen.select("root", "id"), ["root", "id"], "left_anti").select("root", "id", F.lit(depth).alias("depth"), "path_score"))
        seen = seen.unionByName(front)
    return seen.filter("depth > 0")


def distances(edges: DataFrame, start: DataFrame, max_length: int = 5, min_score: float = 0.0) -> DataFrame:
    """Shortest undirected path lengths with the least predecessor: (root, id, length, parent)."""
    steps = both_ways(edges.filter(passes(min_score, None))).distinct()
    seen = start.select("root", F.col("root").alias("id"), F.lit(0).alias("length"), F.lit(None).cast("string").alias("parent")).distinct()
    front = seen
    for n in range(1, max_length + 1):
        reached = front.select("root", F.col("id").alias("a")).join(steps, "a").groupBy("root", F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        front = cut(reached.join(seen.select("root", "id"), ["root", "id"], "left_anti").select("root", "id", F.lit(n).alias("length"), "parent"))
        seen = seen.unionByName(front)
    return seen


def path_to(dist: DataFrame, root: str, target: str) -> list[str] | None:
    """One shortest path, read back over the predecessors; null if the target was not reached. As many look-ups as steps."""
    path, at = [target], target
    rows = dist.filter(F.col("root") == root)
    while at != root:
        r = rows.filter(F.col("id") == at).select("parent").head()
        if r is None:
            return None
        at = r[0]
        path.append(at)
    return path[::-1]


class Neighbours:
    """The neighbours of single nodes, fetched when a walk needs them: (id, tokens), the heaviest link first, ties by id.

    The links of both directions lie in a table that is partitioned by the hash of the node they start
    from, so a look-up reads the partitions of the nodes it asks for. A look-up gives at most ``page``
    neighbours a node, and only those that fit into what is left of the budget, so neither a hub nor
    its dear neighbours come to the driver whole; the next page is fetched when the first is used up.
    """

    PARTS, AHEAD = 16, 32

    def __init__(self, nodes: DataFrame, edges: DataFrame, page: int = 500):
        self.page, self.known = page, {}
        both = both_ways(edges.select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("w")), "w").groupBy("a", "b").agg(F.max("w").alias("w"))
        tokens = nodes.select(F.col("id").alias("b"), F.coalesce("tokens", F.lit(0)).cast("long").alias("t"))
        table = both.join(tokens, "b", "left").select("a", "b", "w", F.coalesce("t", F.lit(0)).alias("t"), F.pmod(F.xxhash64("a"), F.lit(self.PARTS)).cast("int").alias("p"))
        # rebalanced, not repartitioned: the partition of a hub may be cut
        self.table = scratch_table(table.hint("rebalance", "p"), "links", "p")

    def load(self, ids: list[str], room: int, after: tuple[float, str] | None = None) -> None:
        # folded to constants, so that only these partitions are read
        parts = reduce(or_, [F.col("p") == F.pmod(F.xxhash64(F.lit(i)), F.lit(self.PARTS)).cast("int") for i in ids])
        hit = self.table.filter(parts & F.col("a").isin(ids) & (F.col("t") <= room))
        if after is not None:
            hit = hit.filter((F.col("w") < after[0]) | ((F.col("w") == after[0]) & (F.col("b") > after[1])))
        k = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "b"))
        pages: dict[str, list] = {i: [] for i in ids}
        for r in hit.withColumn("k", k).filter(F.col("k") <= self.page).orderBy("a", "k").collect():
            pages[r["a"]].append((r["b"], r["t"], r["w"]))
        self.known |= pages

    def of(self, at: str, room: Callable[[], int], ahead: Callable[[], list[str]]) -> Iterator[tuple[str, int]]:
        """The neighbours of a node; those of the nodes that will be asked for next are fetched along with it."""
        if at not in self.known:
            self.load([at, *[i for i in dict.fromkeys(ahead()) if i not in self.known and i != at][: self.AHEAD - 1]], room())
        while True:
            got = self.known[at]
            yield from ((b, t) for b, t, _ in got)
            if len(got) < self.page:
                return
            self.load([at], room(), (got[-1][2], got[-1][0]))


def walk_bfs(links: Neighbours, root: str, cost: int, budget: int, max_depth: int) -> list[tuple[str, int]]:
    """Breadth first under a token budget: what would break it is skipped and not expanded; the root always counts."""
    out, seen, used, level = [(root, 0)], {root}, cost, [root]
    for depth in range(1, max_depth + 1):
        if used >= budget or not level:
            break
        nxt: list[str] = []
        for i, at in enumerate(level):
            for b, t in links.of(at, lambda: budget - used, lambda: level[i + 1 : i + Neighbours.AHEAD]):  # noqa: B023
                if b in seen or used + t > budget:
                    continue
                seen.add(b)
                out.append((b, depth))
                nxt.append(b)
                used += t
                if used >= budget:
                    return out
        level = nxt
    return out


def walk_dfs(links: Neighbours, root: str, cost: int, budget: int, max_depth: int) -> list[tuple[str, int]]:
    """Depth first in pre-order under the same tests; the way back is a stack of neighbours not yet looked at."""
    out, seen, used = [(root, 0)], {root}, cost

    def enter(at: str) -> Iterator[tuple[str, int]]:
        # next after this node come its own siblings
        return links.of(at, lambda: budget - used, lambda: [b for b, _, _ in links.known.get(trail[-1], [])[: 4 * Neighbours.AHEAD] if b not in seen] if trail else [])

    trail: list[str] = []
    stack = [enter(root)] if used < budget and max_depth > 0 else []
    trail += [root] * len(stack)
    while stack:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            trail.pop()
            continue
        b, t = step
        if b in seen or used + t > budget:
            continue
        seen.add(b)
        out.append((b, len(stack)))
        used += t
        if used < budget and len(stack) < max_depth:
            stack.append(enter(b))
            trail.append(b)
    return out


def budget_walk(nodes: DataFrame, edges: DataFrame, root: str, budget: int = 4000, max_depth: int = 10, min_score: float = 0.0, tiers: tuple[str, ...] | None = schema.TRUSTED, order: str = "bfs") -> DataFrame:
    """Traversal under a token budget: (rank, id, depth), in the order of acceptance.

    The order depends on every acceptance before it, so the walk itself runs on the driver; links are
    looked up when it needs them. What comes to the driver is bounded by the accepted nodes (and nodes
    without tokens fit into every budget) and a page of neighbours of each. A root that is no node
    costs nothing.
    """
    links = Neighbours(nodes, edges.filter(passes(min_score, tiers)))
    own = nodes.filter(F.col("id") == root).select(F.coalesce("tokens", F.lit(0))).head()
    got = (walk_bfs if order == "bfs" else walk_dfs)(links, root, own[0] if own else 0, budget, max_depth)
    rows = [(i + 1, a, d) for i, (a, d) in enumerate(got)]
    return nodes.sparkSession.createDataFrame(rows, "rank int, id string, depth int")
