"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

The sketch follows Dahlgaard, Knudsen and Thorup (2017): in round r every shingle is hashed
into one of t bins with the value (r, hash); after t such rounds, round t + j puts every
shingle into bin j. Each bin keeps its least value and a set stops when all its bins are
full, so that every coordinate is filled, two sets agree in a coordinate with probability
equal to their Jaccard similarity, and the agreement is concentrated as with t hashes.

Plan: one scan gives each text its set size, a 128-bit digest of its set and its band keys.
Texts with equal sets become one class. Classes that share a band key are joined to the
bucket's smallest class (a star, so rows grow with the classes and not with the pairs), and
the components of those stars are the clusters inside which links can be. Only texts of
clusters are read again; each cluster, or each block pair of a cluster above ``CAP``, is one
bounded task that joins the full shingle sets exactly and returns a spanning forest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tianguis.llm.shingles import WIDTH, mix, shingle_set
from tianguis.llm.tables import table
from tianguis.operators.components import connected_components, durable

BANDS = 36
#: Shingles and texts (each text counts as WEIGHT more) that one verification task holds.
CAP, WEIGHT = 2_000_000, 100
#: Chance that two classes exactly at the threshold share no band.
MISS = 2e-5
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def rows_of_band(percent: int) -> int:
    """The most selective band that still misses a pair at the threshold with chance <= MISS."""
    rows = 1
    while (1 - (percent / 100) ** (rows + 1)) ** BANDS <= MISS:
        rows += 1
    return rows


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of ``bins`` coordinates for each non-empty set."""
    items = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    return sketched(items, np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets), bins)


def sketched(items: np.ndarray, owner: np.ndarray, count: int, bins: int) -> np.ndarray:
    """The same from the sets' items, which may repeat, and the set from 0 to ``count`` - 1 that each belongs to."""
    out = np.full((count, bins), _EMPTY, dtype=np.uint64)
    flat = out.reshape(-1)
    for r in range(2 * bins):
        if not len(items):
            break
        # the items are hashes, so that the first round can take them as they are
        h = mix(items + np.uint64(r * 0xD1342543DE82EF95 % (1 << 64))) if r else items
        where = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32) if r < bins else np.uint64(r - bins)
        # the bin follows from the uppermost bits, the value from those below
        value = h & np.uint64((1 << 48) - 1)
        if r:
            value |= np.uint64(r << 48)
        np.minimum.at(flat, owner * bins + where.astype(np.int64) if r < bins else owner * bins + (r - bins), value)
        unfilled = (out == _EMPTY).any(axis=1)
        rest = unfilled[owner]
        if not rest.all():
            items, owner = items[rest], owner[rest]
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """BANDS 64-bit keys for each sketch row; keys of different bands never mean the same."""
    grouped = sketch.reshape(len(sketch), BANDS, rows)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), grouped.shape[:2])
    for j in range(rows):
        key = mix(key * np.uint64(0x2545F4914F6CDD1D) + grouped[:, :, j])
    return key


def _sketched(rows: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            at = 0
            while at < len(ids):
                sets, held, begin = [], 0, at
                while at < len(ids) and held < 500_000:
                    sets.append(shingle_set(texts[at].as_py(), width))
                    held += len(sets[-1])
                    at += 1
                full = np.array([len(s) > 0 for s in sets])
                keys = np.empty((len(sets), BANDS), dtype=np.int64)
                keys[full] = band_keys(sketches([s for s in sets if len(s)], BANDS * rows), rows).view(np.int64)
                digest = np.array([_digest(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[begin:at],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digest[:, 0]),
                        pa.array(digest[:, 1]),
                        pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32), pa.array(keys[full].ravel())),
                    ],
                    names=["id", "n", "d1", "d2", "bands"],
                )

    return run


def _shingled(width: int):
    """The sets of wanted classes; of the texts that share an id only those of the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(2).cast(pa.large_binary())
                sets = [shingle_set(t.as_py(), width) for t in texts]
                own = pa.array([_digest(s)[0] == node for s, node in zip(sets, batch.column(0).to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).filter(own), batch.column(1).filter(own), pa.array([s.tobytes() for s in sets], pa.binary()).filter(own)], names=["rep", "tasks", "set"]
                )

    return run


def _digest(members: np.ndarray) -> np.ndarray:
    """128 bits of a sorted set, as two 64-bit numbers."""
    return np.frombuffer(hashlib.blake2b(members.tobytes(), digest_size=16).digest(), np.int64)


def forest(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect exactly what all links of at least ``percent`` connect.

    An exact set join: sets by size, their shingles by rarity, candidates from an index of
    the rarest shingles that any link must share (prefix filter), intersections counted in
    full. Candidates that are connected already are not compared again.
    """
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), dtype=np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    shared = count > 1
    parent = np.arange(len(ids))
    mark = np.zeros(len(count), dtype=bool)
    index: dict[int, list[int]] = {}
    links = []

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(ids)):
        mine = code[bounds[i] : bounds[i + 1]]
        n = int(sizes[i])
        prefix = mine[np.argsort(rank[mine])[: n - -(-percent * n // 100) + 1]]
        prefix = prefix[shared[prefix]].tolist()
        lists = [index[x] for x in prefix if x in index]
        if lists:
            found = np.unique(np.concatenate([np.array(x) for x in lists]))
            found = found[100 * sizes[found] >= percent * n]
            top = parent[found]
            while (top != parent[top]).any():
                top = parent[top]
            found = found[top != root(i)]
            if len(found):
                mark[mine] = True
                widths = sizes[found]
                starts = np.concatenate([[0], np.cumsum(widths)[:-1]])
                each = np.repeat(bounds[found] - starts, widths) + np.arange(widths.sum())
                inter = np.add.reduceat(mark[code[each]].astype(np.int64), starts)
                mark[mine] = False
                for j in found[100 * inter >= percent * (n + widths - inter)].tolist():
                    a, b = root(i), root(j)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        links.append((ids[i], ids[j]))
        for x in prefix:
            index.setdefault(x, []).append(i)
    return links


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done():
            links = forest(list(sets), list(sets.values()), percent) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        task, sets = None, {}
        for batch in batches:
            for t, i, s in zip(*(batch.column(k) for k in range(3))):
                if t.as_py() != task:
                    if len(sets) > 1:
                        yield done()
                    task, sets = t.as_py(), {}
                sets[i.as_py()] = np.frombuffer(s.as_py(), np.uint64)
        yield done()

    return run


def _tasks(members: DataFrame, percent: int) -> DataFrame:
    """``(rep, tasks)``: the bounded verification tasks that a class takes part in.

    A cluster within CAP is one task. A larger one is dealt into cells by size class (links
    join equal or neighbouring classes only) and salt; each pair of cells that can hold a
    link is a task.
    """
    weight = F.col("n") + F.lit(WEIGHT)
    ratio = -math.log(percent / 100 - 0.001)
    sized = members.withColumn("k", F.floor(F.log("n") / F.lit(ratio)))
    total = sized.groupBy("cluster").agg(F.sum(weight).alias("total"))
    small = sized.join(total.where(F.col("total") <= CAP), "cluster").select("rep", F.array(F.xxhash64("cluster")).alias("tasks"))
    large = sized.join(total.where(F.col("total") > CAP).select("cluster"), "cluster")
    cells = large.groupBy("cluster", "k").agg(F.ceil(F.sum(weight) / F.lit(CAP / 2)).cast("int").alias("g"))
    around = cells
    for name, step in (("below", 1), ("above", -1)):
        around = around.join(cells.select("cluster", (F.col("k") + step).alias("k"), F.col("g").alias(name)), ["cluster", "k"], "left")
    salted = large.join(around, ["cluster", "k"]).withColumn("i", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))

    def pairs(count, make):
        return F.when(F.coalesce(count, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), count - 1), make)).otherwise(F.array().cast("array<bigint>"))

    k, i = F.col("k"), F.col("i")
    return small.union(
        salted.select(
            "rep",
            F.concat(
                pairs(F.col("g"), lambda j: F.xxhash64("cluster", k, F.least(i, j), k, F.greatest(i, j))),
                pairs(F.col("below"), lambda j: F.xxhash64("cluster", k - 1, j, k, i)),
                pairs(F.col("above"), lambda j: F.xxhash64("cluster", k, i, k + 1, j)),
            ).alias("tasks"),
        )
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = WIDTH) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row for each row of ``docs``.

    Two texts are linked when 100 * common shingles >= percent * all their shingles. Banding
    misses a pair at the threshold with a chance of at most MISS, more similar pairs with
    less; every link that counts is confirmed on the full shingle sets.

    Null and empty texts and texts without words have no shingles, are linked with nothing
    and stay. Fewer words than ``width`` make one shingle. Repeated texts are one class, which
    half of a set's 128-bit digest names. Rows with a null id are linked with nothing and
    stay, with a null component. Rows that share an id are each linked by their own text, and
    their id is among those that ``component_id`` is the smallest of, for each of them. An
    empty table gives an empty table; other columns are neither read nor returned.
    """
    rows = rows_of_band(percent)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = durable(slim.mapInArrow(_sketched(rows, width), "id long, n long, d1 long, d2 long, bands array<bigint>"))
    classes = signed.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands")).withColumn("rep", F.col("d1"))
    buckets = classes.select("rep", F.explode("bands").alias("key"))
    pivots = buckets.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("other")).where("pivot < other").select("key", "pivot")
    clusters = connected_components(buckets.join(pivots, "key").select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
    members = durable(clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(classes.select("rep", "n", "least"), "rep"))
    wanted = _tasks(members, percent).join(members.select("rep", F.col("least").alias("id")), "rep")
    sets = slim.where("id is not null").join(wanted, "id").select("rep", "tasks", "text").mapInArrow(_shingled(width), "rep long, tasks array<bigint>, set binary")
    grouped = sets.select(F.explode("tasks").alias("task"), "rep", "set").repartition("task").sortWithinPartitions("task")
    joined = connected_components(grouped.mapInArrow(_verified(percent), "a long, b long"))
    # what the links connect goes by classes; a component's name is the smallest id of its texts
    parts = joined.select(F.col("node").alias("rep"), F.col("component").alias("part")).join(members.select("rep", "least"), "rep")
    names = parts.join(parts.groupBy("part").agg(F.min("least").alias("component")), "part").select("rep", "component")
    named = classes.select("d1", "d2", "rep", "least").join(names, "rep", "left").select("d1", "d2", F.coalesce("component", "least").alias("component"))
    out = signed.select("id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_one_of_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` without the rows that are not kept, with all its columns, whatever they are named.

    A similarity of 0.8 is what the corpus pipeline takes. Rows that share an id go together,
    once one of their texts is near to one of a smaller id; rows with a null id stay.
    """
    found = near_duplicates(docs, id_col, text_col, percent)
    gone = found.where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("own"))
    return rows.join(gone, F.col("own") == F.col("gone"), "left_anti").select("row.*")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
