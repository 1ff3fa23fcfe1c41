"""Listing and rate files, and several sources read as one with a status each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tianguis.operators.components import durable
from tianguis.operators.matching import match, pairs, prepare_observations, prepare_targets, relevant
from tianguis.schema import OBSERVATION, SOURCE_STATUS, as_observations, loose_double, loose_timestamp

_LOOSE = T.StructType([T.StructField(f.split(" ")[0], T.StringType()) for f in [*OBSERVATION.split(", "), "product string"] if not f.startswith("raw ")])


def read_listings(spark: SparkSession, path: str, source_id: str | None = None, source_name: str | None = None, since=None, until=None) -> DataFrame:
    """Listings of a ``.jsonl`` or ``.json`` file, or of a folder's files, as observations.

    A line of ``.jsonl`` is one record; a ``.json`` file is a list of records or an object with
    the list ``observations``. Broken JSON is an error. The file's stem is the default source
    and the first part of default ids. Records outside ``since`` and ``until`` (both
    inclusive) go; those without a capture time stay.
    """
    lines = path.rstrip("/").endswith(".jsonl")
    whole = path.rstrip("/").endswith(".json")
    if not (lines or whole):
        frames = []
        for pattern, multi in (("*.jsonl", False), ("*.json", True)):
            try:
                frames.append(_records(spark.read.option("pathGlobFilter", pattern), path, multi))
            except Exception as e:  # a folder may hold one kind alone
                if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
        records = frames[0].unionByName(frames[1]) if len(frames) == 2 else frames[0]
    else:
        records = _records(spark.read, path, whole)
    stem = F.regexp_replace(F.element_at(F.split("_file", "/"), -1), r"\.jsonl?$", "")
    records = records.withColumn("_stem", stem)
    given = F.lit(source_id).cast("string") if source_id else F.coalesce(F.nullif(F.trim("source_id"), F.lit("")), F.col("_stem"))
    named = records.withColumn("source_id", given).withColumn("observation_id", F.coalesce("observation_id", F.concat_ws(":", "_stem", F.col("_at").cast("string"))))
    if source_name:
        named = named.withColumn("source_name", F.coalesce("source_name", F.lit(source_name)))
    out = as_observations(named.withColumn("raw", F.col("_raw")).drop("_raw", "_file", "_stem", "_at"))
    at = F.col("captured_at")
    if since is not None:
        out = out.where(at.isNull() | (at >= F.lit(since).cast("timestamp")))
    if until is not None:
        out = out.where(at.isNull() | (at <= F.lit(until).cast("timestamp")))
    return out


def _records(reader, path: str, whole: bool) -> DataFrame:
    """One row a record with its text in ``_raw``, its file, and its place in a whole file."""
    text = reader.option("wholetext", whole).text(path).select(F.col("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    if whole:
        doc = F.parse_json("value")
        listed = F.coalesce(F.try_variant_get(doc, "$.observations", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>"))
        rows = text.select("_file", F.posexplode(listed).alias("_at", "_v")).select("_file", "_at", F.to_json("_v").alias("_raw"))
    else:
        rows = _numbered(text.where(F.trim("value") != ""))
    return rows.select("*", F.from_json("_raw", _LOOSE, {"mode": "FAILFAST"}).alias("_r")).select("_file", "_at", "_raw", "_r.*")


def _numbered(lines: DataFrame) -> DataFrame:
    """``(_file, _at, _raw)``: lines with their number in their file, from 0.

    A file is read in blocks, whose rows follow each other in one task; the blocks' sizes
    give each block the number that it begins with, so that no task holds a file.
    """
    dealt = lines.withColumn("_id", F.monotonically_increasing_id())
    blocks = dealt.groupBy("_file", "_block").agg(F.min("_id").alias("_least"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    begun = blocks.select("_file", "_block", (before - F.col("_least")).alias("_shift"))
    return dealt.join(begun, ["_file", "_block"]).select("_file", (F.col("_id") + F.col("_shift")).alias("_at"), F.col("value").alias("_raw"))


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """Rate records ``{from|from_currency, to|to_currency, rate, as_of, source}`` from a file like read_listings'."""
    names = ["from_currency", "to_currency", "from", "to", "rate", "as_of", "source"]
    loose = T.StructType([T.StructField(n, T.StringType()) for n in names])
    text = spark.read.option("wholetext", not path.endswith(".jsonl")).text(path)
    if not path.endswith(".jsonl"):
        doc = F.parse_json("value")
        listed = F.coalesce(F.try_variant_get(doc, "$.rates", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>"))
        text = text.select(F.explode(listed).alias("v")).select(F.to_json("v").alias("value"))
    r = text.where(F.trim("value") != "").select(F.from_json("value", loose, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return r.select(
        F.upper(F.coalesce("from_currency", "from")).alias("from_currency"), F.upper(F.coalesce("to_currency", "to")).alias("to_currency"),
        loose_double(F.col("rate")).alias("rate"), loose_timestamp(F.col("as_of")).alias("as_of"), F.coalesce("source", F.lit("no_especificada")).alias("source"),
    )


@dataclass
class Source:
    """Something that loads observations between two times.

    ``load(spark, since, until)``; a source that can search by product takes the target table
    as well, by ``load_for(spark, targets, since, until)``, and may return less than it has.
    """

    source_id: str
    load: Callable[[SparkSession, object, object], DataFrame] | None = None
    source_name: str | None = None
    load_for: Callable[[SparkSession, DataFrame, object, object], DataFrame] | None = None

    def read(self, spark: SparkSession, targets: DataFrame, since, until) -> DataFrame:
        """What the source gives; rows outside the times go whether or not it looked at them, those without one stay."""
        rows = self.load_for(spark, targets, since, until) if self.load_for else self.load(spark, since, until)
        at = F.col("captured_at")
        for bound, inside in ((since, lambda t: at >= t), (until, lambda t: at <= t)):
            if bound is not None and "captured_at" in rows.columns:
                rows = rows.where(at.isNull() | inside(F.lit(bound).cast("timestamp")))
        return rows


def fetch_all(spark: SparkSession, sources: list[Source], target: DataFrame, since=None, until=None, source_ids: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """All sources' relevant observations as one table, and a status row a source.

    Each source is read in full before the next, so that one that fails, at planning or at
    run time, is an ``error`` row and nothing more. ``target`` has one row a target; a row
    stays if it is relevant to any. A source that found nothing is ``vacia``.
    """
    prepared = prepare_targets(target)
    frames, status = [], []
    for s in sources:
        if source_ids is not None and s.source_id not in source_ids:
            continue
        try:
            rows = durable(s.read(spark, target, since, until))
            found = relevant(match(pairs(prepared, prepare_observations(rows)))).select("row_uid").distinct()
            kept = durable(rows.join(found, "row_uid", "left_semi"))
            n, ids = kept.agg(F.count("*"), F.array_sort(F.collect_set("source_id"))).first()
            total, last = rows.agg(F.count("*"), F.max("row_uid")).first()
            frames.append((kept, 0 if last is None else (last >> 33) + 1))
            status.append((s.source_id, s.source_name, "ok" if total else "vacia", None, n, ids, total - n))
        except Exception as e:
            status.append((s.source_id, s.source_name, "error", f"{type(e).__name__}: {str(e).splitlines()[0][:300]}", 0, [], 0))
    empty = spark.createDataFrame([], OBSERVATION + ", row_uid long")
    # a row's number has its partition above 33 bits; those of one source follow those of the one before
    out, before = empty, 0
    for f, partitions in frames:
        out = out.unionByName(f.withColumn("row_uid", F.col("row_uid") + F.lit(before << 33)))
        before += partitions
    columns = "source_id string, source_name string, status string, error string, observations_returned int, source_ids_returned array<string>, discarded_by_prefilter int"
    stated = spark.createDataFrame(status, columns).withColumn("fetched_at", F.current_timestamp())
    return out, stated.select(*[c.split(" ")[0] for c in SOURCE_STATUS.split(", ")])
