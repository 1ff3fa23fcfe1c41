"""Near-duplicate embeddings within a label, through an inverted multi-index.

Unit vectors are cut in halves, each half has its own codebook, and the two codes name a cell
of the product grid. A vector visits cells in the order of the summed distances of its halves
to the cells' centroids (multi-sequence order) and is compared in double precision with what
lies in them. How many cells it visits is calibrated: on pairs placed exactly at the
threshold, the most distant that count, the visited cells hold the partner with the target
recall. As either vector may find the other, the recall of links is higher.

Codebooks and calibration use a bounded sample; every vector is indexed and queries. Identical
vectors of a label are one class. A task holds a block of at most MEMBERS indexed vectors and
streams at most about PROBES querying ones past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tianguis.llm.tables import table
from tianguis.operators.components import connected_components, durable

SAMPLE_ROWS, SAMPLE_VALUES = 20_000, 8_000_000
RECALL = 0.98
MEMBERS, PROBES = 4096, 32_768


def kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's rounds from evenly drawn rows; an empty cluster keeps its centre."""
    rng = np.random.default_rng(7)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].astype(np.float64)
    for _ in range(rounds):
        label = distances(x, c).argmin(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, label, x)
        n = np.bincount(label, minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :], 0)


class MultiIndex:
    """Two codebooks and the number of cells that a query visits."""

    def __init__(self, sample: np.ndarray, codes: int, threshold: float, recall: float = RECALL):
        self.half = sample.shape[1] // 2
        self.books = [kmeans(sample[:, : self.half], codes), kmeans(sample[:, self.half :], codes)]
        self.visits = 1
        # partners at the threshold, in random directions
        rng = np.random.default_rng(11)
        x = sample[rng.integers(0, len(sample), 2000)]
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
        y = threshold * x + np.sqrt(1 - threshold**2) * away
        a, b = self.cell_distances(x)
        i, j = self.cells(y)
        own = a[np.arange(len(x)), i] + b[np.arange(len(x)), j]
        nearer = np.array([(np.add.outer(p, q) < o).sum() for p, q, o in zip(a, b, own)])
        self.visits = int(np.quantile(nearer, recall)) + 1

    def cell_distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.books[0]), distances(x[:, self.half :], self.books[1])

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.cell_distances(x)
        return a.argmin(axis=1), b.argmin(axis=1)

    def nearest(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each vector the codes of its nearest cells.

        Of the cell at places r and s of the two sorted codebooks, (r + 1) (s + 1) cells are at
        least as near, so only the staircase (r + 1) (s + 1) <= visits can be visited.
        """
        a, b = self.cell_distances(x)
        r, s = np.meshgrid(np.arange(a.shape[1]), np.arange(b.shape[1]), indexing="ij")
        stair = (r + 1) * (s + 1) <= self.visits
        r, s = r[stair], s[stair]
        for p, q in zip(a, b):
            first, second = np.argsort(p), np.argsort(q)
            total = p[first[r]] + q[second[s]]
            best = np.argpartition(total, min(self.visits, len(total)) - 1)[: self.visits]
            yield first[r[best]], second[s[best]]


def _unit(batch: pa.RecordBatch, column: int) -> np.ndarray:
    x = np.array(batch.column(column).to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _indexed(shared):
    """Each class as a member of its cell, and as one probe for every first code it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: MultiIndex = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                x = _unit(batch, 2)
                own_i, own_j = index.cells(x)
                rows, kind, first, second = [], [], [], []
                for k, (i, j) in enumerate(index.nearest(x)):
                    rows.append(k)
                    kind.append(0)
                    first.append(own_i[k])
                    second.append([own_j[k]])
                    order = np.argsort(i, kind="stable")
                    codes, begin = np.unique(i[order], return_index=True)
                    for code, js in zip(codes, np.split(j[order], begin[1:])):
                        rows.append(k)
                        kind.append(1)
                        first.append(code)
                        second.append(js)
                taken = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [taken.column(0), taken.column(1), pa.array(kind, pa.int32()), pa.array(first, pa.int32()), pa.array(second, pa.list_(pa.int32())), taken.column(2)],
                    names=["rep", "label", "kind", "i", "js", "v"],
                )

    return run


def _compared(threshold: float):
    """Runs of one block each, members first; yields the links of probes and members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, codes, held = None, [], [], []
        table_: dict[int, tuple[np.ndarray, np.ndarray]] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch, 4)
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            reps, js = batch.column(2).to_numpy(), batch.column(3).to_pylist()
            edge = np.flatnonzero(np.diff(blocks, prepend=blocks[0]) | np.diff(kinds, prepend=kinds[0]))
            for lo, hi in zip([0, *edge[edge > 0]], [*edge[edge > 0], batch.num_rows]):
                if blocks[lo] != block:
                    block, ids, codes, held, table_ = blocks[lo], [], [], [], None
                if kinds[lo] == 0:
                    ids.append(reps[lo:hi])
                    codes.append(np.array([c[0] for c in js[lo:hi]]))
                    held.append(x[lo:hi])
                    continue
                if not ids:
                    continue
                if table_ is None:
                    all_ids, all_codes, all_x = np.concatenate(ids), np.concatenate(codes), np.concatenate(held)
                    table_ = {c: (all_ids[all_codes == c], all_x[all_codes == c]) for c in np.unique(all_codes)}
                widths = [len(c) for c in js[lo:hi]]
                row, code = np.repeat(np.arange(lo, hi), widths), np.concatenate([np.array(c) for c in js[lo:hi]])
                for c, (there, y) in table_.items():
                    mine = row[code == c]
                    for part in np.array_split(mine, len(mine) // 2048 + 1):
                        p, m = np.nonzero(x[part] @ y.T >= threshold)
                        a, b = reps[part][p], there[m]
                        if len(a):
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[a != b]), pa.array(np.maximum(a, b)[a != b])], names=["a", "b"])

    return run


def _valid(v):
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda c: c != 0), F.lit(False))


def fit(classes: DataFrame, dim: int, count: int, threshold: float) -> MultiIndex | None:
    """Codebooks on at most SAMPLE_ROWS vectors and SAMPLE_VALUES numbers, drawn by hash; few vectors share one cell."""
    rows = max(2, min(SAMPLE_ROWS, SAMPLE_VALUES // max(1, dim)))
    drawn = classes.where(F.shiftrightunsigned(F.xxhash64("rep", F.lit("codebook")), 11).cast("double") / float(1 << 53) < rows / max(1, count))
    sample = [r["v"] for r in drawn.select("v").limit(2 * rows).collect()]
    if not sample:
        sample = [r["v"] for r in classes.select("v").limit(1).collect()]
    x = np.array(sample, dtype=np.float64).reshape(len(sample), dim)
    return MultiIndex(x / np.linalg.norm(x, axis=1, keepdims=True), min(512, max(1, int(count**0.5 / 4))), threshold)


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``vectors``.

    Rows are linked when their labels are equal and not null and their cosine, in double
    precision, is at least ``threshold``. Links below it are never reported; of those above,
    the index finds at least the target recall. Identical vectors are always linked.

    Null vectors, zero vectors and vectors with null or non-finite components are linked with
    nothing, as are rows with a null label or id. Vectors of different lengths are not linked;
    each length has an index of its own, and of vectors of one number the sign is all that
    their cosine tells. Rows that repeat an id count as rows. An empty table gives an empty
    table; other columns are neither read nor returned.
    """
    v = F.col(vector_col).cast("array<double>")
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    # zeros have one sign here, so that equal vectors are equal keys
    keyed = slim.withColumn("v", F.when(F.col("id").isNotNull() & F.col("label").isNotNull() & _valid(F.col("v")), F.transform("v", lambda c: F.when(F.size("v") == 1, F.signum(c)).otherwise(c) + F.lit(0.0))))
    # the rows of a class are named by the least id, and where ids repeat by the vector
    classes = keyed.where(F.col("v").isNotNull()).groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = durable(classes.withColumn("rep", F.xxhash64("label", "v")))
    links = classes.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where("false")
    for size in classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).where("n > 1 and dim > 1").orderBy("dim").collect():
        alike = classes.where(F.size("v") == size["dim"])
        shared = vectors.sparkSession.sparkContext.broadcast(fit(alike, size["dim"], size["n"], threshold))
        links = links.union(_links(alike, shared, threshold))
    links = durable(links)
    both = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(links.select("b", "a"))
    near = both.join(classes.select(F.col("rep").alias("other"), "n"), "other").groupBy("rep").agg(F.sum("n").alias("near"))
    found = connected_components(links)
    parts = found.select(F.col("node").alias("rep"), F.col("component").alias("part")).join(classes.select("rep", "least"), "rep")
    names = parts.join(parts.groupBy("part").agg(F.min("least").alias("component")), "part").select("rep", "component")
    known = (
        classes.join(near, "rep", "left").join(names, "rep", "left")
        .select("label", "v", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "least").alias("component"))
    )
    out = keyed.join(known, ["label", "v"], "left")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(usual: DataFrame, shared, threshold: float) -> DataFrame:
    """The links of classes, each once, with the smaller class first."""
    rows = usual.select("rep", "label", "v").mapInArrow(_indexed(shared), "rep long, label string, kind int, i int, js array<int>, v array<double>")
    rows = durable(rows)
    sizes = rows.groupBy("label", "i").agg(
        F.ceil(F.count_if(F.col("kind") == 0) / MEMBERS).cast("int").alias("ms"), F.ceil(F.count_if(F.col("kind") == 1) / PROBES).cast("int").alias("ps")
    ).where("ms > 0 and ps > 0")
    own = F.pmod(F.xxhash64("rep", F.lit("block")), F.when(F.col("kind") == 0, F.col("ms")).otherwise(F.col("ps"))).cast("int")
    across = F.when(F.col("kind") == 0, F.col("ps")).otherwise(F.col("ms"))
    dealt = rows.join(sizes, ["label", "i"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), across - 1)))
    m = F.when(F.col("kind") == 0, F.col("own")).otherwise(F.col("other"))
    p = F.when(F.col("kind") == 0, F.col("other")).otherwise(F.col("own"))
    blocks = dealt.select(F.xxhash64("label", "i", m, p).alias("block"), "kind", "rep", "js", "v")
    return blocks.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_compared(threshold), "a long, b long").distinct()


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
