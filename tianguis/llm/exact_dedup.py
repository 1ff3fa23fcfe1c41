"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

Every text is cut where its content says so, so equal passages give equal chunks wherever
they stand. A chunk's identifier is its 64-bit hash plus a variant number. Distinct chunks
are gathered once, combined on the map side, and any hash that stands for several chunks
gets variants by comparing the chunks themselves; identifiers are therefore exact. From then
on only recipes, the ordered lists of identifiers, are compared and moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tianguis.llm.tables import table
from tianguis.operators.components import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A chunk ends at the first anchor after LEAST characters, or after MOST without one.
LEAST, MOST = 512, 4096
#: A line end, or white space before one of a few letters: about one word in six.
ANCHOR = r"\n|[\x20\t](?=[acmp])"


def normalised(text: Column) -> Column:
    """Null counts as empty; only A-Z are lower-cased."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def chunks(text: Column) -> Column:
    """The content-defined chunks, in order; together they are the text. Empty text: none."""
    cut = rf"(?s).{{{LEAST},{MOST}}}?(?:{ANCHOR})|.{{1,{MOST}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def _hash(chunk: Column, bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if bits >= 64 else F.shiftrightunsigned(h, 64 - bits)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row for each row of ``docs``.

    Rows are equal when their texts are identical after lower-casing A-Z only. Of equal rows
    the one with the largest id stays. Null counts as empty, so null and empty texts are one
    group. Rows that repeat an id with equal text share its fate; a null id never stays
    unless all ids of its group are null. An empty table gives an empty table; other columns
    are neither read nor returned. ``hash_bits`` below 64 is for tests of the variants.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    parts = slim.select(F.explode(chunks(F.col("norm"))).alias("chunk")).select(_hash(F.col("chunk"), hash_bits).alias("h"), "chunk")
    distinct = parts.groupBy("h", "chunk").agg(F.lit(1).alias("one"))
    clashing = durable(distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    recipes = slim.select(
        "doc_id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.transform(chunks(F.col("norm")), lambda c: _hash(c, hash_bits)).alias("recipe"),
        *([F.col("norm")] if not clashing.isEmpty() else []),
    )
    if "norm" in recipes.columns:
        recipes = _with_variants(recipes, distinct, clashing, hash_bits)
    else:
        recipes = recipes.withColumn("variants", F.lit("").cast("string"))
    key = ["digest", "recipe", "variants"]
    recipes = recipes.withColumn("digest", F.xxhash64("recipe", "variants"))
    groups = recipes.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return recipes.join(groups, [recipes[k].eqNullSafe(groups[k]) for k in key]).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256"
    )


def _with_variants(recipes: DataFrame, distinct: DataFrame, clashing: DataFrame, bits: int) -> DataFrame:
    """Adds ``variants``: the text's chunk variants as far as their hashes are shared, in order."""
    numbered = (
        distinct.join(clashing, "h").select("h", "chunk")
        .withColumn("variant", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
    )
    recipes = durable(recipes.withColumn("row", F.monotonically_increasing_id()))
    each = recipes.select("row", F.posexplode(chunks(F.col("norm"))).alias("at", "chunk")).withColumn("h", _hash(F.col("chunk"), bits))
    found = (
        each.join(numbered, ["h", "chunk"])
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "variant"))).alias("v"))
        .select("row", F.to_json("v").alias("variants"))
    )
    return recipes.drop("norm").join(found, "row", "left").drop("row")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
