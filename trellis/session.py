"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, app: str = "trellis") -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (a single-machine session, as in tests) a folder of our own is set.
    """
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY, None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), f"trellis-{os.getpid()}")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder they start in."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *[k for k in known if k]])


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files.

    Unlike a cached table this survives the loss of an executor, and the plan
    that follows starts at a scan.
    """
    shared_dir(df.sparkSession)
    reach_workers(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """An equi-join that is a sort-merge join whatever the sizes are estimated to be.

    For sides that grow with the data and whose size the planner can't know, such as
    exploded lists and what Python code returns. AQE may still split hot partitions.
    """
    return left.hint("merge").join(right.hint("merge"), on, how)


def spread(df: DataFrame) -> DataFrame:
    """Rows over as many tasks as shuffles have: for work in Python, whose cost the bytes that AQE goes by don't show."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread_few(df: DataFrame) -> DataFrame:
    """``df``, spread over the cores if it is a scan of fewer splits than there are cores: small files, much work a row.

    A table that is large enough to matter has more splits and is read where it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scratch_table(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder, in folders by the column ``by``, and read it back.

    Columnar files keep column pruning and push-down for several readers.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    writer = df.write.mode("errorifexists")
    (writer if by is None else writer.partitionBy(by)).parquet(path)
    return spark.read.schema(schema).parquet(path)


def create_once(spark: SparkSession, tmp, at) -> bool:
    """Give the file ``tmp`` the name ``at`` (both Hadoop paths) unless that exists; whether it was done.

    On a local disk by a hard link, which fails if the name is taken; elsewhere by the file
    system's rename without overwriting.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = at.getFileSystem(conf)
    try:
        if fs.getScheme() == "file":
            os.link(tmp.toUri().getPath(), at.toUri().getPath())
            return True
        none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(tmp, at, none)
        return True
    except (FileExistsError, Py4JJavaError):
        if fs.exists(at):
            return False
        raise
    finally:
        fs.delete(tmp, False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
