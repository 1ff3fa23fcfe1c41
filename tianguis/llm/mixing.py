"""Interleaving sources to target weights by Pfair scheduling, in DataFrame operations only.

The rows of a source are dealt into blocks. Block k of a source with share w may start in
slot floor((k - 1) / w) and must have run by slot ceil(k / w); in every slot the earliest
deadline among the released blocks runs. Shares are the target weights themselves, as exact
fractions, so that at no slot is a source a whole block from its weight. When a source has no
blocks left, the others go on with their weights scaled up.

The phases between the ends of sources and the blocks' slots follow from the block counts
alone. They are worked out on the driver from one number a source, in memory by the number of
blocks and in time by that and the logarithm of the sources: a block has BLOCK rows, or more
where there would be over BLOCKS of them, and every source has one at least. However many they
are, each source has its own blocks in the schedule. Rows are ranked within their source and
joined to the blocks in parallel.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tianguis.llm.tables import table
from tianguis.operators.components import durable

BLOCK, BLOCKS = 32, 200_000
#: Sources whose slices are broadcast to the rows; those of more are joined by shuffle.
MAX_SOURCES = 1000
#: Rows that one ranking task holds, about, and slices of a source at most.
SLICE, SLICES = 2_000, 100_000


MIXED = ("mix_source", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_position")


def phases(blocks: dict, weights: dict) -> list[dict]:
    """The phases between the ends of sources: first slot, length, blocks done before and taken, and the plan.

    ``plan`` has, slot by slot of the phase, (source, k, release, deadline); k counts a
    source's blocks of the phase from 1. ``before`` and ``taken`` name the plan's sources.
    """
    return list(_phases(blocks, weights))


def _phases(blocks: dict, weights: dict) -> Iterator[dict]:
    left = {s: n for s, n in blocks.items() if n > 0}
    if not left:
        return
    exact = {s: Fraction(weights[s]) for s in left}
    scale = math.lcm(*[w.denominator for w in exact.values()])
    parts = {s: w.numerator * (scale // w.denominator) for s, w in exact.items()}
    done, total, slot, waiting = dict.fromkeys(left, 0), sum(parts.values()), 0, _Waiting(parts)
    while left:
        plan = _earliest_deadlines(parts, left, total, waiting)
        taken = Counter(s for s, *_ in plan)
        yield {"slot": slot, "length": len(plan), "before": {s: done[s] for s in taken}, "taken": dict(taken), "plan": plan}
        slot += len(plan)
        for s, n in taken.items():
            done[s] += n
            left[s] -= n
            if left[s]:
                waiting.add(s)
            else:
                total -= parts[s]
                del left[s]


class _Waiting:
    """Sources whose first block of a phase has not run: ``first`` finds the earliest deadline among them, by name where several have it.

    Sources stand by their share, so that those of one deadline are neighbours; a tree of minima
    over the names finds the first of them. A phase only touches what it runs, so that many
    short phases of many sources take no more time than one long one.
    """

    def __init__(self, parts: dict):
        self.sources = sorted(parts, key=lambda s: -parts[s])
        self.falling = [-parts[s] for s in self.sources]
        self.at = {s: i for i, s in enumerate(self.sources)}
        self.names = sorted(parts, key=str)
        self.rank = {s: i for i, s in enumerate(self.names)}
        self.none, self.size = len(parts), 1 << (len(parts) - 1).bit_length()
        self.least = [self.none] * self.size + [self.rank[s] for s in self.sources] + [self.none] * (self.size - len(parts))
        for i in range(self.size - 1, 0, -1):
            self.least[i] = min(self.least[2 * i], self.least[2 * i + 1])

    def _put(self, s, rank: int) -> None:
        i = self.at[s] + self.size
        self.least[i] = rank
        while i > 1:
            i >>= 1
            self.least[i] = min(self.least[2 * i], self.least[2 * i + 1])

    def add(self, s) -> None:
        self._put(s, self.rank[s])

    def remove(self, s) -> None:
        self._put(s, self.none)

    def first(self, total: int) -> tuple | None:
        """``(deadline, name, k, source)``, or None where no source is left."""
        if self.least[1] == self.none:
            return None
        i = 1
        while i < self.size:  # the largest share
            i = 2 * i if self.least[2 * i] < self.none else 2 * i + 1
        deadline = -(total // self.falling[i - self.size])
        # all whose share is large enough for this deadline stand before this end
        low, high, best = i, self.size + bisect_right(self.falling, total // -deadline), self.none
        while low < high:
            if low & 1:
                best = min(best, self.least[low])
                low += 1
            if high & 1:
                high -= 1
                best = min(best, self.least[high])
            low, high = low >> 1, high >> 1
        s = self.names[best]
        return deadline, str(s), 1, s


def _earliest_deadlines(parts: dict, left: dict, total: int, fresh: _Waiting) -> list[tuple]:
    """``(source, k, release, deadline)`` by slot, until the first source has run all its blocks.

    ``fresh`` has all sources of ``left`` when it begins, and those that did not run when it ends.
    """
    waiting: list = []
    ready: list = []
    out: list[tuple] = []
    begin = fresh.first(total)
    while True:
        while waiting and waiting[0][0] <= len(out):
            heapq.heappush(ready, heapq.heappop(waiting)[1])
        if begin and (not ready or begin < ready[0]):
            deadline, _, k, s = begin
            fresh.remove(s)
            begin = fresh.first(total)
        else:
            deadline, _, k, s = heapq.heappop(ready)
        out.append((s, k, (k - 1) * total // parts[s], deadline))
        if k == left[s]:
            return out
        heapq.heappush(waiting, (k * total // parts[s], (-(-(k + 1) * total // parts[s]), str(s), k + 1, s)))


def ranked(docs: DataFrame, id_col: str, counts: dict) -> DataFrame:
    """Adds ``_rank``, the row's place from 0 within its ``_source`` in an order spread by hash of the id.

    A source is cut into slices by the hash's range, as many as its rows need; the slices'
    counts give each slice its offset, so that no task holds a whole source.
    """
    spark = docs.sparkSession
    slices = pa.array([min(SLICES, max(1, -(-n // SLICE))) for n in counts.values()], pa.int32())
    cuts = spark.createDataFrame(pa.table({"_source": pa.array(counts, pa.string()), "_slices": slices}))
    # the top bits order the slices and the whole hash orders the rows in them
    h = F.xxhash64(F.col(id_col).cast("long"))
    spread = docs.withColumn("_h", h).join(F.broadcast(cuts) if len(counts) <= MAX_SOURCES else cuts, "_source")
    spread = spread.withColumn("_slice", F.floor((F.shiftrightunsigned("_h", 33).cast("double") / F.lit(float(1 << 31))) * F.col("_slices")).cast("int"))
    sizes = spread.groupBy("_source", "_slice").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_offset", F.sum("_n").over(Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    inside = Window.partitionBy("_source", "_slice").orderBy(F.shiftrightunsigned("_h", 1), "_h", F.col(id_col))
    return (
        spread.withColumn("_in", F.row_number().over(inside) - 1)
        .join(offsets.select("_source", "_slice", "_offset"), ["_source", "_slice"])
        .withColumn("_rank", F.col("_in") + F.col("_offset"))
        .drop("_h", "_slices", "_slice", "_in", "_offset")
    )


def mix_sources(
    docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", block: int | None = None, alpha: float = 0.5
) -> DataFrame:
    """``docs`` with ``mix_source, mix_block, mix_slot, mix_release, mix_deadline, mix_position``.

    ``mix_position`` is the row's place in the mixture, from 0 and without gaps. Without
    ``weights`` a source's target weight is its row count to the power ``alpha``. Every row
    stays and stands in the mixture once; releases and deadlines are slots of the mixture.
    The last block of a source may be short. ``block`` is by default as the module says.

    A null source is the source "". Sources that ``weights`` does not name raise, as do
    weights that are not positive. Repeated ids are separate rows; null ids are allowed. An
    empty table gives an empty table. Columns of ``docs`` keep their values, whatever they are
    named, but for those named like an output column, which give way to it.
    """
    spark, source = docs.sparkSession, F.col("_s")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in MIXED]
    docs = docs.select(F.struct(*kept).alias("row"), F.col(id_col).alias("_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_s"))
    sizes = docs.groupBy(source.alias("s")).agg(F.count("*").alias("n"))
    weight = F.col("n").cast("double") ** alpha
    if weights is not None:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "s string, w double")
        sizes, weight = sizes.join(given, "s", "left"), F.col("w")
    sizes = durable(sizes.withColumn("weight", weight))
    whole = sizes.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.count_if(F.coalesce(F.col("weight") > 0, F.lit(False))).alias("good")).first()
    if whole["good"] < whole["k"]:
        raise ValueError("weights must be positive, and name every source")
    every = sizes.select("s", "n", "weight").toArrow()
    counts = dict(zip(every["s"].to_pylist(), every["n"].to_pylist()))
    targets = dict(zip(counts, every["weight"].to_pylist())) if weights is None else weights
    block = block or max(BLOCK, -(-(whole["n"] or 0) // BLOCKS))
    columns: dict[str, list] = {k: [] for k in ("_source", "mix_block", "mix_slot", "mix_release", "mix_deadline", "_first")}
    missing = 0
    for ph in _phases({s: -(-n // block) for s, n in counts.items()}, targets):
        start = ph["slot"]
        for at, (s, k, release, deadline) in enumerate(ph["plan"], start):
            for c, v in zip(columns.values(), (s, ph["before"][s] + k - 1, at, start + release, start + deadline, at * block - missing)):
                c.append(v)
        # a phase ends with the last, perhaps short block of the source that ends it
        missing += -counts[s] % block
    kinds = pa.schema([("_source", pa.string()), *[(c, pa.int64()) for c in list(columns)[1:]]])
    blocks = spark.createDataFrame(pa.table(columns, schema=kinds))
    out = ranked(docs.withColumn("_source", source), "_id", counts).withColumn("mix_block", F.floor(F.col("_rank") / block))
    return out.join(blocks, ["_source", "mix_block"]).select(
        "row.*", source.alias("mix_source"), "mix_block", "mix_slot", "mix_release", "mix_deadline",
        (F.col("_first") + F.col("_rank") % block).alias("mix_position"),
    )


def in_mixture_order(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with its columns, in the mixture's order: files and the rows in them follow it.

    Places are worked out on ids and sources alone; texts move twice, to their place's row and
    into order. Rows that repeat an id and a source share out its places in the order of
    their columns, which may have any name.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("own"), F.col(source_col).alias("own_source"))
    placed = mix_sources(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source")), id_col="id")
    on = F.col("own").eqNullSafe(F.col("id")) & F.col("own_source").eqNullSafe(F.col("source"))
    if not rows.groupBy("own", "own_source").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        placed = placed.withColumn("nth", F.row_number().over(Window.partitionBy("id", "source").orderBy("mix_position")))
        rows = rows.withColumn("same", F.row_number().over(Window.partitionBy("own", "own_source").orderBy(F.to_json("row"))))
        on = on & (F.col("same") == F.col("nth"))
    return rows.join(placed, on).sort("mix_position").select("row.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_sources(docs).drop("mix_source")
