"""Language identification by nearest centroid over character n-gram TF-IDF vectors.

Training rows are a bounded sample of labelled rows, drawn evenly over the languages by a
hash of the id. Each language gets several centroids (spherical k-means). A text takes the
language of the centroid with the largest cosine. It is rejected when that cosine is below the
centroid's radius, a part of a low quantile of the cosines of its training texts, with slack
for short texts; or when too many of its trigrams are in no training text, since a long text
of any language comes near to all centroids in few buckets. How many may be unknown follows
from the training texts, each held against the others, again with slack for short ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tianguis.llm.shingles import mix
from tianguis.llm.tables import table

DIM = 4096
ORDERS = (1, 2, 3)
#: Rows that a model is fitted on, at most, over all languages.
SAMPLE = 1000
CENTROIDS = 3
#: Bits of the hash by which the trigrams of training texts are known.
KNOWN_BITS = 20
#: Texts that the limits leave out at most, as a share, before they are widened.
LOW = 0.01
#: Trigrams of a text that halve the least cosine; the share of unknown ones that no text may exceed.
SLACK, MOST_UNKNOWN = 64, 0.9
#: Characters that are turned into n-grams at once.
PIECE = 1 << 20


def _hashes(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes) of the n-grams of a lower-cased text, in pieces; digits, marks and white space are one space."""
    for begin in range(0, max(1, len(text)), PIECE):
        # pieces overlap by what the longest n-gram needs
        part = text[max(0, begin - max(ORDERS) + 1) : begin + PIECE].lower()
        code = np.frombuffer(part.encode("utf-32-le", "replace"), dtype=np.uint32)
        if not len(code):
            continue
        letter = _letters(code)
        code = np.where(letter, code, 32)
        keep = np.ones(len(code), dtype=bool)
        keep[1:] = letter[1:] | letter[:-1]  # one space for many
        code = np.concatenate([[32], code[keep], [32]]).astype(np.uint64)
        for n in ORDERS:
            if len(code) >= n:
                h = np.full(len(code) - n + 1, np.uint64(n))
                for k in range(n):
                    h = h * np.uint64(0x110000) + code[k : len(code) - n + 1 + k]
                yield n, mix(h)


def read(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed counts of the n-grams of a text, and its longest n-grams one by one as KNOWN_BITS-bit hashes."""
    out, longest = np.zeros(DIM, dtype=np.float32), [np.empty(0, np.int64)]
    for n, h in _hashes(text):
        out += np.bincount((h >> np.uint64(52)).astype(np.int64), minlength=DIM)
        if n == max(ORDERS):
            longest.append((h >> np.uint64(64 - KNOWN_BITS)).astype(np.int64))
    return out, np.concatenate(longest)


def counts(text: str) -> np.ndarray:
    """Hashed counts of the n-grams of a text."""
    return read(text)[0]


_LETTER = np.zeros(0x110000, dtype=bool)


def _letters(code: np.ndarray) -> np.ndarray:
    if not _LETTER.any():
        _LETTER[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return _LETTER[code]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """Unit centroids as rows, each with its language and the least cosine that counts; idf weights; known trigrams and how large a share may be unknown."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    radius: np.ndarray
    known: np.ndarray
    unknown: float

    def outside(self, best: np.ndarray, cosine: np.ndarray, grams: list[np.ndarray]) -> np.ndarray:
        """Which texts are to be rejected, by their nearest centroids, cosines and trigrams."""
        size = np.array([max(1, len(g)) for g in grams])
        new = np.array([np.count_nonzero(~self.known[g]) for g in grams]) / size
        return (cosine < self.radius[best] * size / (size + SLACK)) | (new > np.minimum(self.unknown + 1 / np.sqrt(size), MOST_UNKNOWN))

    def vectors(self, raw: np.ndarray) -> np.ndarray:
        v = np.log1p(raw, dtype=np.float32) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def nearest(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosine = self.vectors(raw) @ self.centroids.T
        best = cosine.argmax(axis=1)
        return best, np.clip(cosine[np.arange(len(best)), best], 0, 1)


def _clusters(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from seeds that are far apart."""
    centre = v[[int(np.argmax(v @ v.mean(axis=0)))]]
    while len(centre) < min(k, len(v)):
        centre = np.vstack([centre, v[int(np.argmin((v @ centre.T).max(axis=1)))]])
    for _ in range(12):
        label = (v @ centre.T).argmax(axis=1)
        centre = np.vstack([v[label == j].mean(axis=0) if (label == j).any() else centre[j] for j in range(len(centre))])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return centre


def fit(rows: list[tuple[str, bytes, bytes]]) -> Model:
    """From (language, counts of a text as 16-bit numbers, its trigrams' hashes and their counts as 32-bit numbers) of the sample."""
    rows = sorted(rows)
    raw = np.frombuffer(b"".join(r[1] for r in rows), np.uint16).reshape(len(rows), DIM)
    idf = (np.log((1 + len(rows)) / (1 + (raw > 0).sum(axis=0))) + 1).astype(np.float32)
    model = Model(idf, np.empty((0, DIM), np.float32), [], np.empty(0), np.zeros(1 << KNOWN_BITS, dtype=bool), 0.0)
    if not rows:
        return model
    v = model.vectors(raw)
    names = np.array([r[0] for r in rows])
    for lang in sorted(set(names)):
        centre = _clusters(v[names == lang], CENTROIDS)
        model.centroids = np.vstack([model.centroids, centre.astype(np.float32)])
        model.langs += [lang] * len(centre)
    grams = [np.frombuffer(r[2], np.int32).reshape(2, -1) for r in rows]
    size = np.array([max(1, int(n.sum())) for _, n in grams])
    best, cosine = model.nearest(raw)
    # what the text's length gives is taken off, so that short texts don't set the limit of long ones
    level = cosine * (size + SLACK) / size
    each = [level[best == j] for j in range(len(model.langs))]
    model.radius = np.array([0.5 * min(1.0, float(np.quantile(x if len(x) else level, LOW, method="lower"))) for x in each])
    seen = np.zeros(1 << KNOWN_BITS, dtype=np.int32)
    for g, _ in grams:
        seen[g] += 1
    model.known = seen > 0
    new = np.array([int(n[seen[g] < 2].sum()) for g, n in grams]) / size
    model.unknown = float(2 * np.quantile(np.maximum(new - 1 / np.sqrt(size), 0), 1 - LOW) + 0.05)
    return model


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [read(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([np.minimum(c, 65535).astype(np.uint16).tobytes() for c, _ in texts], pa.binary()),
                pa.array([np.array(np.unique(g, return_counts=True), dtype=np.int32).tobytes() for _, g in texts], pa.binary()),
            ],
            names=["lang", "whole", "grams"],
        )


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` rows with a language and a letter, spread evenly over the languages."""
    rows = labelled.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    size = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not size:
        return fit([])
    each = max(1, sample // len(size))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, each / n))) for k, n in size.items()])
    drawn = rows.where(F.shiftrightunsigned(F.xxhash64("id", F.lit("langid")), 11).cast("double") / float(1 << 53) < share)
    got = drawn.select("lang", "text").mapInArrow(_sampled, "lang string, whole binary, grams binary").limit(2 * sample).collect()
    return fit([(r["lang"], bytes(r["whole"]), bytes(r["grams"])) for r in got])


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [x.as_py() for x in part.column(1)]
                known = np.array([has_letter(t) for t in texts])
                pred, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
                if known.any() and model.langs:
                    both = [read(t) for t, k in zip(texts, known) if k]
                    best, cosine = model.nearest(np.array([c for c, _ in both]))
                    score[known], rejected[known] = cosine, model.outside(best, cosine, [g for _, g in both])
                    for i, j in zip(np.flatnonzero(known).tolist(), best.tolist()):
                        pred[i] = model.langs[j]
                yield pa.RecordBatch.from_arrays([*part.columns[:1], *part.columns[2:], pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)], names=[*part.schema.names[:1], *part.schema.names[2:], "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)``, one row for each row of ``docs``.

    ``lang_pred`` is the language of the nearest centroid, "und" for null texts, texts without
    a letter and models without languages; ``score`` its cosine from 0 to 1, 0 with "und".
    ``rejected`` marks "und", texts outside the radius and texts of unknown trigrams. Long texts are read whole, in
    pieces. Repeated and null ids are separate rows; an empty table gives an empty table;
    other columns are neither read nor returned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_predicted(shared), "doc_id long, lang_pred string, score double, rejected boolean")


def train_fold(docs: DataFrame) -> DataFrame:
    """The rows that predictions may learn from."""
    return docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    out = identify(docs, train(train_fold(docs)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the rows that language identification rejects, with all its columns, whatever they are named."""
    model = train(train_fold(docs))
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns
    whole = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    kinds = whole.schema["_row"].dataType.simpleString()
    out = whole.mapInArrow(_predicted(shared), f"_id long, _row {kinds}, lang_pred string, score double, rejected boolean")
    return out.where(~F.col("rejected")).select(*[F.col("_row")[c].alias(c) for c in names])
