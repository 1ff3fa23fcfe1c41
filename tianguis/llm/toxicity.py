"""Toxicity as an ordinal grade: a cumulative-link model on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w . x), with one weight vector for all thresholds; the
severity is the expected grade, the sum of P(grade >= k). Features are whole words, beginnings
and ends of words; those that go with labelled toxicity are chosen over the sample by a
distributed count, so that word families count even where the single form is new.

Labels of 0 and 1 are not graded. Positive rows then get the grades 1 to 3 by the terciles of
how many of their words carry a chosen feature.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tianguis.llm.tables import table

#: Labelled rows of each class that a model is fitted on, about; twice that at most.
SAMPLE = 2000
FEATURES = 2048
#: Least standard score and document count of a chosen feature.
SCORE, LEAST = 5.0, 5
#: How many times as frequent a chosen feature is in toxic rows, at least.
RATIO = 20
#: How much a row without toxicity weighs against one with it.
CLEAN_WEIGHT = 3.0
WORDS_KEPT = 400_000
PIECE = 1 << 20
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> Counter:
    """Lower-cased words with their counts, from a text read whole, piece by piece."""
    out: Counter = Counter()
    text, at = text or "", 0
    while at < len(text):
        end = text.find(" ", at + PIECE)
        end = len(text) if end < 0 else end
        out.update(_WORD.findall(text[at:end].lower()))
        at = end
    return out


def features(word: str) -> list[str]:
    """The word, its beginnings of 3 to 6 letters and its ends of 4 and 5, where shorter than it."""
    n = len(word)
    return ["=" + word, *("^" + word[:k] for k in (3, 4, 5, 6) if k <= n), *("$" + word[-k:] for k in (4, 5) if k < n)]


@dataclass
class Model:
    """``index`` numbers the chosen features; ``weights`` go with them; ``cuts`` ascend."""

    index: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray

    def hits(self, counted: Counter, known: dict[str, tuple]) -> tuple[Counter, int]:
        """How often each chosen feature occurs, and how many words carry one."""
        out: Counter = Counter()
        carriers = 0
        if len(known) > WORDS_KEPT:
            known.clear()
        for word, n in counted.items():
            found = known.get(word)
            if found is None:
                found = known[word] = tuple(self.index[f] for f in features(word) if f in self.index)
            if found:
                carriers += n
                for f in found:
                    out[f] += n
        return out, carriers

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each k, by row."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -60, 60)))


def fit_cumulative(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts by full-batch Adam on the weighted likelihood."""
    top = int(grade.max())
    w = np.zeros(x.shape[1])
    share = np.array([np.average(grade < k, weights=weight) for k in range(1, top + 1)]).clip(1e-3, 1 - 1e-3)
    cuts = np.log(share / (1 - share))
    raw = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])  # gaps stay positive
    state = np.concatenate([w, raw])
    m, v = np.zeros_like(state), np.zeros_like(state)
    total = weight.sum()
    for step in range(1, rounds + 1):
        w, raw = state[: len(w)], state[len(w) :]
        gaps = np.exp(raw[1:])
        cuts = np.concatenate([raw[:1], raw[0] + np.cumsum(gaps)])
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        score = x @ w
        upper = 1 / (1 + np.exp(-np.clip(edge[grade + 1] - score, -40, 40)))
        lower = 1 / (1 + np.exp(-np.clip(edge[grade] - score, -40, 40)))
        upper[grade == top], lower[grade == 0] = 1.0, 0.0
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        by_score = weight * (dl - du) / total  # slope of the log-likelihood
        g_cuts = np.array([(weight * (du * (grade == k) - dl * (grade == k + 1))).sum() / total for k in range(top)])
        g_raw = np.concatenate([[g_cuts.sum()], [g_cuts[j:].sum() * gaps[j - 1] for j in range(1, top)]])
        grad = np.concatenate([x.T @ by_score - ridge * w, g_raw])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        state = state + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    w, raw = state[: len(w)], state[len(w) :]
    return w, np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])


def _occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = sorted({f for w in words(text.as_py()) for f in features(w)})
            yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(found), pa.int32()), pa.array(found, pa.string())], names=["grade", "feature"])


def _counted(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = Model(index.value, np.zeros(0), np.zeros(0)), {}
        for batch in batches:
            rows = [model.hits(words(t.as_py()), known) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for _, n in rows], pa.int64()), pa.array([list(h) for h, _ in rows], pa.list_(pa.int32())), pa.array([list(h.values()) for h, _ in rows], pa.list_(pa.int32()))],
                names=["grade", "carriers", "at", "n"],
            )

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits on about ``sample`` labelled rows without and as many with toxicity, drawn by hash of the id."""
    spark = docs.sparkSession
    graded = labels.select(F.col(id_col).cast("long").alias("id"), F.col(grade_col).cast("int").alias("grade")).where("id is not null and grade >= 0").groupBy("id").agg(F.max("grade").alias("grade"))
    size = {r["toxic"]: r["n"] for r in graded.groupBy((F.col("grade") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return Model({}, np.zeros(0), np.array([20.0]))
    share = F.when(F.col("grade") > 0, min(1.0, sample / size[True])).otherwise(min(1.0, sample / size[False]))
    drawn = graded.where(F.shiftrightunsigned(F.xxhash64("id", F.lit("toxicity")), 11).cast("double") / float(1 << 53) < share).limit(4 * sample)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(drawn), "id").select("grade", "text")
    n = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("grade") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model({}, np.zeros(0), np.array([20.0]))
    a, b = F.count_if(F.col("grade") > 0), F.count_if(F.col("grade") == 0)
    pooled = (F.col("a") + F.col("b")) / (n[True] + n[False])
    score = (F.col("a") / n[True] - F.col("b") / n[False]) / F.sqrt(pooled * (1 - pooled) * (1 / n[True] + 1 / n[False]) + 1e-12)
    chosen = (
        rows.mapInArrow(_occurring, "grade int, feature string").groupBy("feature").agg(a.alias("a"), b.alias("b"))
        .where(F.col("a") + F.col("b") >= LEAST).withColumn("score", score)
        .where((F.col("score") >= SCORE) & (F.col("a") / n[True] >= RATIO * F.col("b") / n[False]))
        .orderBy(F.desc("score"), "feature").limit(FEATURES).collect()
    )
    if not chosen:
        return Model({}, np.zeros(0), np.array([20.0]))
    index = {r["feature"]: k for k, r in enumerate(chosen)}
    got = rows.mapInArrow(_counted(spark.sparkContext.broadcast(index)), "grade int, carriers long, at array<int>, n array<int>").collect()
    got.sort(key=lambda r: (r["grade"], r["carriers"], r["at"], r["n"]))
    x = np.zeros((len(got), len(index)), dtype=np.float32)
    for k, r in enumerate(got):
        x[k, r["at"]] = np.log1p(np.array(r["n"], dtype=np.float32))
    grade, carriers = np.array([r["grade"] for r in got]), np.array([r["carriers"] for r in got])
    weight = np.where(grade > 0, 1 / n[True], CLEAN_WEIGHT / n[False])
    if grade.max() == 1:
        cut = np.quantile(carriers[grade > 0], [1 / 3, 2 / 3])
        grade = np.where(grade > 0, 1 + (carriers[:, None] > cut[None, :]).sum(axis=1), 0)
    _, grade = np.unique(grade, return_inverse=True)  # grades without gaps
    return Model(index, *fit_cumulative(x, grade, weight))


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for k, text in enumerate(batch.column(1)):
                hit, _ = model.hits(words(text.as_py()), known)
                if hit:
                    score[k] = model.weights[list(hit)] @ np.log1p(np.array(list(hit.values()), dtype=np.float64))
            exceed = model.exceed(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(exceed.sum(axis=1)), pa.array(exceed[:, 0]), pa.array((exceed >= 0.5).sum(axis=1), pa.int32()), pa.array(exceed[:, 0] >= 0.5)],
                names=["doc_id", "severity", "p_toxic", "grade", "toxic"],
            )

    return run


def grade_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, severity, p_toxic, grade, toxic)``, one row for each row of ``docs``.

    ``severity`` is the expected grade, ``p_toxic`` P(grade >= 1), ``grade`` the median one and
    ``toxic`` whether it is above 0. Null and empty texts have no features and get the grade
    of a text without any. Long texts are read whole. Repeated and null ids are separate rows;
    an empty table gives an empty table; other columns are neither read nor returned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_scored(shared), "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grade_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
