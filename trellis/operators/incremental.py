"""Processing only new or changed records (problem 5).

The ledger of what has been processed is a set of disjoint intervals of sequence
numbers. A run subtracts them from the ranges available to it, processes the
gaps (rows that were committed late fall into gaps behind the front), and
commits its output together with the merged intervals.

Intervals are rows of a table, cut at multiples of 2^SHIFT, so that subtracting,
merging and finding the rows inside of them are windows over blocks of numbers and
nothing of it comes to the driver. ``IntervalLedger`` is the ledger of one live
source. ``replay`` goes through a list of past runs: ``run_gaps`` gives the gaps of every
run, and the rows that fall into them are what the run processes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellis.functions.clock import micros_of
from trellis.session import create_once, cut

Interval = tuple[int, int]
#: Intervals are cut at multiples of 2^SHIFT: a block is what one task puts in order.
SHIFT = 14
INTERVALS = "b bigint, lo bigint, hi bigint"


def merge(parts: Iterable[Interval]) -> list[Interval]:
    """Closed intervals as the least number of disjoint ones, in order; neighbours join."""
    out: list[Interval] = []
    for lo, hi in sorted(p for p in parts if p[0] <= p[1]):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def subtract(available: Iterable[Interval], done: Iterable[Interval]) -> list[Interval]:
    """The parts of ``available`` that no interval of ``done`` covers."""
    out: list[Interval] = []
    taken = merge(done)
    for lo, hi in merge(available):
        at = lo
        for a, b in taken:
            if b < at:
                continue
            if a > hi:
                break
            if a > at:
                out.append((at, a - 1))
            at = b + 1
        if at <= hi:
            out.append((at, hi))
    return out


def block_islands(rows: DataFrame, seq: str, by: list[str] | None = None) -> DataFrame:
    """The runs of consecutive sequence numbers in ``rows`` as (by..., b, lo, hi), cut at the ends of the blocks b."""
    by = list(by or [])
    s = rows.filter(F.col(seq).isNotNull()).select(*by, F.col(seq).cast("long").alias("s")).withColumn("b", F.shiftright("s", SHIFT)).distinct()
    local = s.withColumn("g", F.col("s") - F.row_number().over(Window.partitionBy(*by, "b").orderBy("s")))
    return local.groupBy(*by, "b", "g").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).select(*by, "b", "lo", "hi")


def stitched(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Block-cut intervals (by..., b, lo, hi) as whole ones (by..., lo, hi).

    Only intervals that touch an end of their block can go on in the next one; they
    are at most two a block, and only they are put in order together.
    """
    by = list(by or [])
    first, last = F.shiftleft("b", SHIFT), F.shiftleft("b", SHIFT) + (1 << SHIFT) - 1
    touches = (F.col("lo") == first) | (F.col("hi") == last)
    outer = Window.partitionBy(*by).orderBy("lo") if by else Window.partitionBy(F.lit(0)).orderBy("lo")
    starts = parts.filter(touches).withColumn("new", F.when(F.col("lo") == F.lag("hi").over(outer) + 1, 0).otherwise(1)).withColumn("k", F.sum("new").over(outer))
    joined = starts.groupBy(*by, "k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("k")
    return parts.filter(~touches).select(*by, "lo", "hi").unionByName(joined)


def islands(rows: DataFrame, seq: str, by: list[str] | None = None) -> DataFrame:
    """The runs of consecutive sequence numbers in ``rows`` as (by..., lo, hi)."""
    return stitched(block_islands(rows, seq, by), by)


def merged(*parts: DataFrame) -> DataFrame:
    """Block-cut intervals (b, lo, hi) as the least number of disjoint ones, block by block."""
    every = parts[0].select("b", "lo", "hi")
    for p in parts[1:]:
        every = every.unionByName(p.select("b", "lo", "hi"))
    w = Window.partitionBy("b").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = every.withColumn("new", F.when(F.col("lo") <= reach + 1, 0).otherwise(1))
    return opened.withColumn("k", F.sum("new").over(w)).groupBy("b", "k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("k")


def placed(rows: DataFrame, seq: str, parts: DataFrame) -> DataFrame:
    """``rows`` with the struct ``part``, the row of ``parts`` (b, lo, hi, ...) whose interval holds their number; null if there is none.

    ``parts`` are disjoint and cut at the blocks. An as-of join: starts and rows are put in
    order within their block, and a row's interval is the last one that has started.
    """
    kind = parts.select(F.struct(*parts.columns).alias("part")).schema["part"].dataType
    mine = rows.select(F.struct(*rows.columns).alias("row"), F.col(seq).cast("long").alias("s")).withColumn("b", F.shiftright("s", SHIFT)).withColumn("part", F.lit(None).cast(kind))
    starts = parts.select(F.lit(None).cast(mine.schema["row"].dataType).alias("row"), F.col("lo").alias("s"), "b", F.struct(*parts.columns).alias("part"))
    # of equal numbers the start comes before the rows
    order = Window.partitionBy("b").orderBy("s", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    all_ = starts.unionByName(mine).withColumn("last", F.last("part", ignorenulls=True).over(order)).filter("row IS NOT NULL")
    return all_.select("row.*", F.when(F.col("s") <= F.col("last.hi"), F.col("last")).alias("part"))


class IntervalLedger:
    """Processed sequence numbers of one source, committed together with the output.

    A commit is a manifest ``<root>/manifests/<n>`` that names the folder of the run's
    output and that of the merged intervals; both are written first, and the manifest is
    made last, under a name that must not exist. A run that dies before leaves nothing that
    is read: the next one finds the same gaps.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        jvm, fs = self._fs()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests")
        if not fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit())

    def state(self) -> dict:
        """The last commit: its number, the folder of the intervals and the output folders of all commits."""
        done = self._manifests()
        if not done:
            return {"n": 0, "intervals": None, "outputs": []}
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{done[-1]}").head()[0])

    def _done(self, state: dict) -> DataFrame:
        if state["intervals"] is None:
            return self.spark.createDataFrame([], INTERVALS)
        return self.spark.read.schema(INTERVALS).parquet(state["intervals"])

    def intervals(self) -> DataFrame:
        """The processed numbers as whole disjoint intervals (lo, hi)."""
        return stitched(self._done(self.state()))

    def gaps(self, source: DataFrame, seq: str) -> DataFrame:
        """Available ranges of ``source`` less what has been processed, cut at the blocks: (b, lo, hi)."""
        return block_islands(placed(source.select(seq), seq, self._done(self.state())).filter("part IS NULL"), seq)

    def run(self, source: DataFrame, seq: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Process the rows in the gaps and commit; returns the committed output of this run.

        The gaps are fixed before anything is processed, so a row that arrives meanwhile waits
        for the next run. Rows without a number are never processed.
        """
        state = self.state()
        todo = cut(self.gaps(source, seq))
        picked = placed(source, seq, todo).filter("part IS NOT NULL").select(*source.columns)
        name = uuid.uuid4().hex
        out, done = f"{self.root}/outputs/{name}", f"{self.root}/intervals/{name}"
        work(picked).write.parquet(out)
        merged(self._done(state), todo).write.parquet(done)
        self._publish({"n": state["n"] + 1, "intervals": done, "outputs": [*state["outputs"], out]})
        return self.spark.read.parquet(out)

    def _publish(self, body: dict) -> None:
        """Make the manifest, whole and only if there is none of its number."""
        jvm, fs = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        tmp, at = path(f"{self.root}/tmp-{uuid.uuid4().hex}"), path(f"{self.root}/manifests/{body['n']}")
        stream = fs.create(tmp, False)
        stream.write(bytearray((json.dumps(body) + "\n").encode()))
        stream.close()
        fs.mkdirs(at.getParent())
        if not create_once(self.spark, tmp, at):
            raise RuntimeError(f"commit {body['n']} was made by another run")

    def output(self) -> DataFrame | None:
        """Everything committed so far; null before the first commit."""
        paths = self.state()["outputs"]
        return self.spark.read.parquet(*paths) if paths else None


def successful_runs(runs: DataFrame) -> list[tuple[int, int]]:
    """(run_no, start in microseconds) of the successful runs, in order.

    A run log has a row per run, a few thousand in years, so it may come to the driver.
    """
    ok = runs.filter((F.lower(F.trim(F.regexp_replace("status", r"(?U)^\s+|\s+$", ""))) == "success") & F.col("started_at").isNotNull())
    got = ok.select("run_no", micros_of("started_at").alias("us")).distinct().collect()
    return sorted(((r["run_no"], r["us"]) for r in got), key=lambda x: (x[1], x[0]))


def first_run(us: Column, runs: list[tuple[int, int]]) -> Column:
    """Index (from 0) of the first run that starts after ``us``; null if there is none.

    The starts form a sorted literal array and the index is the number of starts
    that are not later.
    """
    if not runs:
        return F.lit(None).cast("int")
    starts = F.array(*[F.lit(s).cast("long") for _, s in runs])
    n = F.size(F.filter(starts, lambda s: s <= us))
    return F.when(us.isNotNull() & (n < len(runs)), n)


def _numbered(rows: DataFrame, order: list[tuple[int, int]], seq: str, visible_at: str) -> DataFrame:
    """(s, r): the numbers that some run can see and the index of the first one that does."""
    got = rows.select(F.col(seq).cast("long").alias("s"), first_run(micros_of(visible_at), order).alias("r"))
    return got.filter(F.col("s").isNotNull() & F.col("r").isNotNull())


def run_gaps(rows: DataFrame, runs: list[tuple[int, int]], seq: str, visible_at: str) -> DataFrame:
    """For every run the ranges available to it less those of the runs before it: (b, lo, hi, r), disjoint over all runs.

    ``runs`` as from ``successful_runs``; r is the index of the run. A number belongs to the first
    run that sees it; a later row of the same number is not processed again. All runs in
    one pass, one shuffle of numbers by blocks.
    """
    seen = _numbered(rows, runs, seq, visible_at).withColumn("b", F.shiftright("s", SHIFT)).repartition("b")
    one = seen.groupBy("b", "s").agg(F.min("r").alias("r"))
    w = Window.partitionBy("b").orderBy("s")
    goes_on = (F.lag("s").over(w) == F.col("s") - 1) & (F.lag("r").over(w) == F.col("r"))
    parts = one.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("k", F.sum("new").over(w))
    return parts.groupBy("b", "k").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.min("r").alias("r")).select("b", "lo", "hi", "r")


def replay(rows: DataFrame, runs: DataFrame, key: str, seq: str, visible_at: str, state: Column) -> DataFrame:
    """Per successful run the keys whose state is new or changed since the run before.

    ``state`` is null for a deletion. Returns (run_no, rec_key). Each run processes the rows
    whose numbers lie in its gaps; the first successful run is the start of the record and
    reports nothing. Rows without a key, a number or a time are seen by no run; of rows
    with the same time the higher sequence number counts; repeated rows change nothing.

    Two shuffles of the rows, by blocks of numbers and by key: the last row of each key and run
    is picked with a partial aggregation, and the comparison with the run before is a window
    over the same partitioning. State travels as a digest, never as text.
    """
    order = successful_runs(runs)
    seen = rows.select(F.col(key).alias("rec_key"), micros_of(visible_at).alias("us"), F.col(seq).cast("long").alias("s"), state.alias("state")).filter(F.col("rec_key").isNotNull() & F.col("us").isNotNull() & F.col("s").isNotNull())
    mine = placed(seen, "s", run_gaps(rows.filter(F.col(key).isNotNull()), order, seq, visible_at)).filter("part IS NOT NULL").withColumn("r", F.col("part.r"))
    last = mine.groupBy("rec_key", "r").agg(F.max(F.struct("us", "s", "state")).alias("v"))
    w = Window.partitionBy("rec_key").orderBy("r")
    moved = last.select("rec_key", "r", F.col("v.state").alias("state")).withColumn("before", F.lag("state").over(w))
    names = F.array(*[F.lit(n).cast("int") for n, _ in order]) if order else F.array(F.lit(None).cast("int"))
    return moved.filter((F.col("r") > 0) & F.col("state").isNotNull() & ~F.col("state").eqNullSafe(F.col("before"))).select(
        F.element_at(names, F.col("r") + 1).alias("run_no"), "rec_key"
    )


def changed_records(files: DataFrame, tree_nodes: DataFrame, nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """``replay`` over the three record tables: (run_no, rec_table, rec_key)."""
    digest = lambda c: F.unhex(F.sha2(c.cast("binary"), 256))
    body = digest(F.col("content"))
    node_state = F.when(F.col("removed_at").isNull(), digest(F.concat_ws("|", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256), F.coalesce(F.concat(F.lit("="), "source_file"), F.lit("-")))))
    parts = [
        replay(files, runs, "path", "file_seq", "arrived_at", body).select("run_no", F.lit("files").alias("rec_table"), "rec_key"),
        replay(tree_nodes, runs, "id", "node_seq", "arrived_at", body).select("run_no", F.lit("tree_nodes").alias("rec_table"), "rec_key"),
        replay(nodes, runs, "id", "seq", "written_at", node_state).select("run_no", F.lit("nodes").alias("rec_table"), "rec_key"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def run_ledger(rows: DataFrame, runs: DataFrame, seq: str, visible_at: str) -> DataFrame:
    """The intervals each successful run processed: (run_no, lo, hi), disjoint over all runs."""
    order = successful_runs(runs)
    names = F.array(*[F.lit(n).cast("int") for n, _ in order]) if order else F.array(F.lit(None).cast("int"))
    return stitched(run_gaps(rows, order, seq, visible_at), ["r"]).select(F.element_at(names, F.col("r") + 1).alias("run_no"), "lo", "hi")
