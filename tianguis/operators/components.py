"""Connected components as alternating stars, in DataFrame operations only."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINKS_A_TASK = 100_000
#: The session's setting by which a query's shuffles go with its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``; see ``shared_folder``.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors can reach.

    Where it is unset, a session of this machine alone (tests, notebooks) takes a folder of
    this machine, and a cluster raises, since its executors could not read what others wrote.
    """
    sc = spark.sparkContext
    set_to = sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not set_to and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors can reach")
        sc.setCheckpointDir(set_to or tempfile.mkdtemp(prefix="tianguis-checkpoint-"))
    return (set_to or sc.getCheckpointDir()).rstrip("/")


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What frames that are made and run in here have shuffled goes when they have run, and not at some later garbage collection."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Scratch:
    """Tables in the shared folder that some steps hand to each other; ``drop`` when no plan reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        at = f"{self.path}/{self.count}"
        with shuffles_go(self.spark):
            df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return int(row["n"]), int(row["h"] or 0)


def connected_components(
    edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60
) -> DataFrame:
    """``(node, component)`` for every node that an edge names; component = its smallest node.

    Each round connects every node's larger neighbours to the smallest node around it
    (large star), then its smaller neighbours (small star). The number of rounds grows
    with the logarithm of the longest chain. Rounds aggregate before they shuffle and
    join against one row a node, which adaptive execution may split where a node is hot.

    Nulls on either side, self-links and repeated links add nothing; a table without
    links gives a table without rows. Raises if ``max_rounds`` do not suffice.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    current = durable(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    state = _state(current)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        # links only get fewer; a small rest goes through few tasks and files
        few = max(1, -(-state[0] // LINKS_A_TASK))
        both = current.coalesce(few).select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(few)
        large = (
            both.join(nearest, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(few)
        )
        smallest = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(few)
        small = (
            large.join(smallest, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct()
        )
        following = durable(small.coalesce(few))
        now = _state(following)
        current, before, state = following, state, now
        if now == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

