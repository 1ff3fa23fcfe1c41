"""Replicated listings: strong keys, their transitive closure, the row that stays, weak groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tianguis.operators.components import Scratch, connected_components, durable

# Why two rows are the same listing.
REASONS = ["misma URL", "mismo identificador de anuncio", "misma imagen y vendedor", "mismo vendedor, texto, precio y moneda (publicación replicada)"]
BY_CHAIN = "agrupado por transitividad con otro duplicado"
WEAK_REASON = "mismo texto y precio con vendedor distinto o desconocido (señal débil; no eliminado)"


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equality of columns in which a null equals a null."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def strong_keys(scope: list[str], seller: str = "seller_norm") -> Column:
    """Up to four keys of a prepared row as ``(kind, hash, check)``; rows of a scope that share one are one listing.

    A key is 96 bits of two hashes of the scope, the kind and its parts, so that no text is shuffled.
    """
    s, price = F.col(seller), F.col("price")

    def key(kind, *parts):
        # hashes pass over nulls, which are therefore told besides
        every = [x for p in (*[F.col(c) for c in scope], *parts) for x in (p.isNull(), p.cast("string"))]
        return F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), *every).alias("hash"), F.hash(F.lit(kind), *every).alias("check"))

    return F.array_compact(
        F.array(
            F.when(F.col("url_norm").isNotNull(), key(0, F.col("url_norm"))),
            F.when(F.col("listing_id").isNotNull(), key(1, F.col("source_id"), F.col("listing_id"))),
            F.when(F.col("image_id").isNotNull() & s.isNotNull(), key(2, F.col("image_id"), s)),
            F.when(s.isNotNull() & price.isNotNull(), key(3, s, F.col("title_norm"), price, F.col("currency_norm"))),
        )
    )


def deduplicate(rows: DataFrame, scope: list[str]) -> DataFrame:
    """``(*scope, row_uid, is_canonical, canonical_uid, canonical_id, duplicate_reasons)`` of prepared rows.

    Each scope (say target and period) is on its own, all in one pass. The latest capture of
    a component stays, of equal ones the smallest ``row_uid``, which is unique in a scope.
    """
    here = Scratch(rows.sparkSession)
    slim, found = _replicated(rows, scope, here)
    found = found.select("node", *ADDED).withColumn("_found", F.lit(True))
    alone = {"is_canonical": F.lit(True), "canonical_uid": F.col("row_uid"), "canonical_id": F.col("observation_id"), "duplicate_reasons": F.array().cast("array<string>")}
    out = durable(slim.drop("keys").join(found, "node", "left").select(*scope, "row_uid", *[F.when(F.col("_found"), F.col(c)).otherwise(alone[c]).alias(c) for c in ADDED]))
    here.drop()
    return out


def replicated(rows: DataFrame, scope: list[str], scratch: Scratch) -> DataFrame:
    """As ``deduplicate``, of those rows only that share a key with another one; all others stay. It reads tables in ``scratch``."""
    return _replicated(rows, scope, scratch)[1].drop("node")


#: What deduplication tells of a row.
ADDED = ["is_canonical", "canonical_uid", "canonical_id", "duplicate_reasons"]


def _replicated(rows: DataFrame, scope: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    slim = scratch.keep(
        rows.select(*scope, "row_uid", "observation_id", "captured_at", strong_keys(scope).alias("keys")).withColumn("node", F.monotonically_increasing_id())
    )
    keyed = slim.select("row_uid", "node", F.explode("keys").alias("key")).select("row_uid", "node", "key.*")
    on = ["hash", "check", "kind"]
    first = keyed.groupBy(*on).agg(F.min("row_uid").alias("first_uid"), F.min_by("node", "row_uid").alias("first_node"), F.count("*").alias("n")).where("n > 1")
    linked = durable(keyed.join(first, on).where(F.col("row_uid") > F.col("first_uid")).select("node", "first_node", "kind"))
    parts = connected_components(linked, "node", "first_node").withColumnRenamed("component", "part")
    why = linked.groupBy("node").agg(F.array_sort(F.collect_set(F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("kind") + 1))).alias("why"))
    full = scratch.keep(slim.drop("keys").join(parts.join(why, "node", "left"), "node"))
    order = F.struct(F.coalesce("captured_at", F.timestamp_seconds(F.lit(0))).alias("at"), (-F.col("row_uid")).alias("back"))
    kept = full.groupBy("part").agg(F.max_by(F.struct("row_uid", "observation_id", "why"), order).alias("kept"))
    none = F.array().cast("array<string>")
    reasons = F.array_sort(F.array_union(F.coalesce("why", none), F.coalesce("kept.why", none)))
    is_kept = F.col("row_uid") == F.col("kept.row_uid")
    out = full.join(kept, "part").select(
        "node", *scope, "row_uid", is_kept.alias("is_canonical"), F.col("kept.row_uid").alias("canonical_uid"), F.col("kept.observation_id").alias("canonical_id"),
        F.when(is_kept, none).when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit(BY_CHAIN))).alias("duplicate_reasons"),
    )
    return slim, out


def weak_duplicates(unique: DataFrame, scope: list[str], columns: list[str] | None = None, id_col: str = "observation_id") -> DataFrame:
    """Groups of unique rows with one text, price and currency; they are marked, never removed."""
    on = [*scope, *(columns or ["title_norm", "price", "currency_norm"])]
    return unique.where(F.col("price").isNotNull() if "price" in on else F.lit(True)).groupBy(*on).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(id_col)).alias("ids")).where("n > 1").withColumn("reason", F.lit(WEAK_REASON))
